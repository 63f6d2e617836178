import re

import numpy as np
import pyarrow as pa
import pytest

from kadastra.llm import jaccard
from kadastra.llm.queries import op11_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def shingles(text, width=5):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {" ".join(words)} if len(words) < width else {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_force(rows, percent=80):
    """{doc_id: (n, component)} by comparing every two sets that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, own in sets.items():
        for s in own:
            where.setdefault(s, []).append(i)
    tried = set()
    for ids in where.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def family(draw, base, copies, edits):
    """Copies of a text with some words replaced, put in or left out."""
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(int(draw.integers(0, edits + 1))):
            at = int(draw.integers(len(words)))
            words[at : at + int(draw.integers(0, 2))] = [f"w{draw.integers(5000)}"] * int(draw.integers(0, 2))
        out.append(" ".join(words))
    return out


def invented(seed):
    draw = np.random.default_rng(seed)
    word = lambda n: [f"w{i}" for i in draw.integers(0, 5000, n)]
    passage = word(60)
    texts = [t for size in (6, 12, 40, 150, 400) for t in family(draw, word(size), 40, max(1, size // 25))]
    texts += [" ".join(word(int(draw.integers(5, 60))) + passage + word(int(draw.integers(1, 60)))) for _ in range(150)]
    texts += ["", None, " \t\n", "one", "One", "one two", "two one", "a b c d", "A  b\tc\nd", "ÄB c d e f", "äB c d e f"]
    order = draw.permutation(len(texts))
    return [(int(i) * 3 + 1, texts[i]) for i in order]


@pytest.mark.parametrize("tile", [7, 1024])
def test_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "PAIRS", 50 * tile)
    rows = invented(tile)
    assert result(jaccard.linked_groups(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)


def test_order_of_what_stands_out_loses_nothing(spark, monkeypatch):
    rows = invented(5)
    classes = np.random.default_rng(2).integers(0, 4, jaccard.BINS).astype(np.uint8)
    monkeypatch.setattr(jaccard, "standing_out", lambda *_: classes)
    assert result(jaccard.linked_groups(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)


def test_bins_of_frequent_shingles_stand_out(spark):
    rows = [(i, f"the same five words here {i} and {i * i} own ones {-i}") for i in range(400)]
    classes = jaccard.standing_out(spark.createDataFrame(rows, SCHEMA).repartition(3), "text", 5)
    (common,) = jaccard.shingle_sets(pa.array(["the same five words here"]), 5)
    assert classes[jaccard._bin(common)][0] > 0
    assert (classes > 0).sum() == 1


def test_pair_exactly_at_the_bound(spark):
    base = [f"w{i}" for i in range(40)]  # 36 shingles; 4 replaced at an end leave 32 of 40 common
    near, below = base[:36] + ["a", "b", "c", "d"], base[:35] + ["a", "b", "c", "d", "e"]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (11, " ".join(f"v{w}" for w in base)), (12, " ".join(f"v{w}" for w in base[:35]) + " a b c d e"), (20, " ".join(below))]
    got = result(jaccard.linked_groups(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute_force(rows)
    assert got[2] == (36, 1) and got[12] == (36, 12)


def test_bitmaps_never_bound_too_low():
    draw = np.random.default_rng(4)
    for _ in range(300):
        pool = draw.integers(0, 2**63, int(draw.integers(2, 900)), dtype=np.uint64)
        a, b = (np.unique(draw.choice(pool, int(draw.integers(1, len(pool) + 1)))) for _ in range(2))
        common = len(np.intersect1d(a, b))
        widths = [jaccard.bitmap_width(int(jaccard.band(np.array([len(x)]), 80)[0]), 80) for x in (a, b)]
        rows = [jaccard._folded([jaccard._bits(x, w)], min(widths))[0] for x, w in zip((a, b), widths)]
        if 100 * common >= 80 * (len(a) + len(b) - common):
            assert jaccard.may_link(len(a), rows[0], len(b), rows[1], 80)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(200_000))
    rows = [(5, "a b c d e f g", 1, "k"), (5, "p q r s t u v", 1, "k"), (7, "p q r s t u v", 1, "k"), (3, "A b c d e f g", 1, "k"), (3, "A b c d e f g", 1, "k"), (None, "a b c d e f g", 1, "k"), (None, "alone", 1, "k"), (None, None, 1, "k"), (9, long, 1, "k"), (8, long + " end", 1, "k"), (6, "", 1, "k")]
    df = jaccard.linked_groups(spark.createDataFrame(rows, SCHEMA + ", n int, key string"))
    got = sorted((tuple(r) for r in df.collect()), key=str)
    want = [(5, 3, 3), (5, 3, 3), (7, 3, 3), (3, 3, 3), (3, 3, 3), (None, 3, 3), (None, 1, None), (None, 0, None), (9, 199_996, 8), (8, 199_997, 8), (6, 0, 6)]
    assert got == sorted(want, key=str)
    assert jaccard.linked_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    df = op11_jaccard_join(spark, path)
    assert result(df) == brute_force(rows)
    assert df.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]


def test_a_pair_is_told_by_one_of_its_tiles(spark):
    rows = [(key, 3, no, no // 2) for no in range(40) for key in range(30) if (no + key) % 5]
    met = spark.createDataFrame(rows, "key long, band int, no long, root long")
    alike = spark.createDataFrame([(no, 20, bytes(8 + no % 3 // 2 * 8)) for no in range(40)], "no long, n long, bits binary")
    told = [tuple(r) for r in jaccard._tile_pairs(met, alike, 80).collect()]
    assert sorted(told) == [(a, b) for a in range(40) for b in range(a + 1, 40) if a // 2 != b // 2]
    none = jaccard._tile_pairs(met.withColumn("key", met.key * 1000 + met.no), alike, 80)
    assert none.count() == 0
