import hashlib
import math
from collections import Counter

import pytest

from kadastra.llm import mixing

SCHEMA = "taken long, doc_id long, text string, source string, copies int"


def level(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Targets by filling up sources one after another."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if rate * weight[s] > most * sizes[s]]
        if not full:
            target |= {s: rate * weight[s] for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def run(spark, rows):
    return mixing.mix_plan(spark.createDataFrame([(5, d, t, s, 7) for d, t, s in rows], SCHEMA).repartition(3)).collect()


def words(n):
    return " ".join(["w"] * n)


def test_targets_and_copies(spark):
    rows = [(i, words(1 + i % 40), "abcdefg"[i % 3]) for i in range(600)] + [(1000 + i, words(5), None) for i in range(20)]
    rows += [(2000, None, "a"), (2001, "", "empty"), (2002, " \t", "empty"), (2003, words(3000), "long"), (None, words(9), "b"), (7, words(9), "b"), (2004, "a b c\x1cd", "Z")]
    plan = run(spark, rows)
    sizes = Counter()
    for r in plan:
        sizes[r.source] += r.size
    want = level(sizes)
    largest, taken = Counter(), Counter()
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.copies <= 2 * r.size
        largest[r.source] = max(largest[r.source], r.size)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1
    assert len(plan) == len(rows)
    assert sorted(map(str, plan)) == sorted(map(str, run(spark, rows)))


def test_copies_follow_systematic_sampling(spark):
    rows = [(i, words(1 + (i * 7) % 13), "ab"[i % 2]) for i in range(200)]
    got = {r.doc_id: r for r in run(spark, rows)}
    for s in "ab":
        own = sorted((r for r in got.values() if r.source == s), key=lambda r: (r.size, r.doc_id))
        rate = own[0].target / own[0].source_size
        u = int(hashlib.md5(f"mix-1|{s}".encode()).hexdigest()[:8], 16) / 2**32
        for k, r in enumerate(own):
            assert r.copies == math.floor(u + rate * (k + 1)) - math.floor(u + rate * k)


def test_emit_repeats_rows_with_all_columns(spark):
    docs = spark.createDataFrame([(5, i, words(2 + i % 5), "ab"[i % 2], 7) for i in range(60)] + [(6, 3, words(5), "b", 8)], SCHEMA)
    plan = mixing.mix_plan(docs)
    out = mixing.emit(docs, plan)
    assert out.columns == docs.columns
    want = Counter()
    for r in plan.collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert [r.taken for r in run(spark, [(1, "", "a"), (2, None, None)])] == [0, 0]
