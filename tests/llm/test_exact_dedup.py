import hashlib

import pytest

from kadastra.llm import exact_dedup as ed

SCHEMA = "kept boolean, doc_id long, text string, group_size long, n int"


def slow(rows):
    groups = {}
    for d, t in rows:
        norm = "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((-len(t or ""), d is None, d or 0))
    out = []
    for norm, own in groups.items():
        own.sort()
        keep = None if own[0][1] else own[0][2]
        for i, (_, none, d) in enumerate(own):
            out.append((-1 if none else d, -1 if keep is None else keep, len(own), i == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows):
    got = ed.exact_dedup(spark.createDataFrame([(True, d, t, 9, 1) for d, t in rows], SCHEMA).repartition(5)).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got)


@pytest.mark.parametrize("slots", [1, 64])
def test_matches_brute_force(spark, monkeypatch, slots):
    monkeypatch.setattr(ed, "HOT_DIGESTS", slots)
    rows = [(i, "hot text") for i in range(300)] + [(400 + i, f"t {i % 37}") for i in range(120)]
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, "a b"), (604, "ab"), (605, "a b"), (606, "é 🙂"), (607, "é🙂"), (None, "ho ttext"), (None, "alone"), (608, "x " * 60000), (609, "x" * 60000)]
    assert run(spark, rows) == slow(rows)


def test_ids_at_the_ends_of_their_range(spark):
    rows = [(-(2**63), "a b"), (2**63 - 1, "ab"), (0, "a b"), (-(2**63), "c"), (None, "c")]
    assert run(spark, rows) == slow(rows)


def test_repeated_rows_keep_one(spark):
    got = run(spark, [(1, "a b"), (1, "a b"), (2, "ab")])
    assert [r[3] for r in got].count(True) == 1 and {r[1] for r in got} == {1} and {r[2] for r in got} == {3}


def test_empty_table(spark):
    assert run(spark, []) == []
