"""The velocity of views is rounded half up from its decimal value, in the query and in its SQL."""

import os

import duckdb

from kadastra.plans import scores

SF = "/root/testdata/sf0.001"


def test_velocity_of_23_views_in_40_days(spark, tmp_path):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        os.symlink(f"{SF}/{name}", tmp_path / name)
    key = con.execute(f"SELECT min(l_orderkey) FROM (SELECT l_orderkey FROM '{SF}/lineitem.parquet' GROUP BY 1 HAVING count(*) = 2 AND min(l_shipdate) < max(l_shipdate))").fetchone()[0]
    os.unlink(tmp_path / "lineitem.parquet")
    later = f"l_shipdate > (SELECT min(l_shipdate) FROM '{SF}/lineitem.parquet' WHERE l_orderkey = {key})"
    con.execute(
        f"""COPY (SELECT * REPLACE (CASE WHEN l_orderkey <> {key} THEN l_quantity WHEN {later} THEN 24.0 ELSE 1.0 END AS l_quantity,
         CASE WHEN l_orderkey = {key} AND {later} THEN (SELECT min(l_shipdate) FROM '{SF}/lineitem.parquet' WHERE l_orderkey = {key}) + INTERVAL 40 DAY ELSE l_shipdate END AS l_shipdate) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'"""
    )
    for name in ("customer", "lineitem", "nation", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    told = con.execute(f"SELECT views_velocity FROM ({scores.ORACLE['dm_outcome_labels']}) WHERE id = {key}").fetchone()[0]
    assert scores.QUERIES["dm_outcome_labels"](spark, str(tmp_path)).filter(f"id = {key}").first().views_velocity == told == 0.58
