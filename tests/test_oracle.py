"""Every market query against its SQL, over the smallest tables."""

import math
import os

import pytest

from kadastra import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.load()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.3g}"
    return str(value)


def ordered(rows):
    """Rows in an order that floats decide last, and coarsely."""
    return sorted(rows, key=lambda r: ([plain(v) for v in r if not isinstance(v, float)], [plain(v) for v in r if isinstance(v, float)]))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)
    return plain(a) == plain(b)


#: A trained model and walks that depend on an order have no SQL; fixtures test them (test_market.py, test_dedup.py, test_canonical.py).
NO_SQL = {"dm_liquidity_model", "dm_listing_duplicates", "st_canonical_assignment"}


def test_every_query_has_sql():
    assert QUERIES.keys() - NO_SQL == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered([tuple(r) for r in df.select(*columns).collect()])
    found = duck.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = ordered([tuple(r[i] for i in at) for r in found.fetchall()])
    assert len(got) == len(want)
    assert [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))] == []
