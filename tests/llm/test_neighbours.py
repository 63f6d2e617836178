import numpy as np

from kadastra.llm import neighbours as nn


def slow(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted((-float(sum(a * b for a, b in zip(v, w))), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def run(spark, rows, k=20, kind="float"):
    table = spark.createDataFrame([(i, v, 1, "r") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, rank string").repartition(4)
    got = {}
    for r in nn.nearest(table, table_query(), k).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [own[i] for i in range(1, len(own) + 1)] for q, own in got.items()}


def table_query():
    from pyspark.sql import functions as F

    return F.col("vec_id") % 20 == 0


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 8)).astype(np.float32)
    x[30:70] = x[5]  # ties and copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(500, None), (520, [0.0] * 8), (540, [None] + [1.0] * 7), (560, [float("nan")] * 8), (580, [float("inf")] * 8), (None, [1.0] * 8), (620, [])]
    short = [(600, [1.0] * 5)]  # as if zeros followed
    got, want = run(spark, rows + odd + short), slow(rows + [(600, [1.0] * 5 + [0.0] * 3)], 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-9)


def test_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 32))
    x = centres[rng.integers(0, 30, 3000)] + 0.6 * rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got, want = run(spark, rows), slow(rows, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert all(len(v) == 20 for v in got.values()) and hits / (20 * len(want)) >= 0.9


def test_values_beyond_single_precision_and_a_common_offset(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16))
    for rows in ([(i, v.tolist()) for i, v in enumerate(1e60 * x)], [(i, v.tolist()) for i, v in enumerate(x + 50)]):
        got, want = run(spark, rows, kind="double"), slow(rows, 20)
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits / (20 * len(want)) >= 0.95


def test_rows_that_share_an_id(spark):
    got = run(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0])])
    assert got == {0: [(1, 4.0), (1, 3.0)]}


def test_fewer_than_asked_for_and_empty(spark):
    assert run(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (40, [1.0, 2.0])]) == {0: [(40, 5.0), (1, 4.0)], 40: [(0, 5.0), (1, 4.0)]}
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0])]) == {}
