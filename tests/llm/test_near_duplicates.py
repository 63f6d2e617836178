"""The pipeline's near-dedup stage against brute force over shingle sets."""

import random

from kadastra.llm import simhash

COLUMNS = "doc_id long, text string"


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def kept(spark, rows):
    return sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, COLUMNS)).collect())


def leaders(rows):
    """Smallest ids of the groups that pairs of similarity 0.8 make."""
    sets, root = [(d, shingles(t)) for d, t in rows], {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[i + 1 :]:
            if jaccard(s, t) >= 0.8:
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return sorted(d for d in root if find(d) == d)


def changed(rng, words, times):
    words = list(words)
    for i, k in enumerate(rng.sample(range(len(words) // 12), times)):
        words[12 * k + 5] = f"new{rng.random()}{i}"
    return " ".join(words)


def at_least(rng, low, high, n=204):
    """Two texts whose similarity lies between low and high."""
    while True:
        words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        other = changed(rng, words, rng.randint(2, 8))
        if low <= jaccard(shingles(" ".join(words)), shingles(other)) < high:
            return " ".join(words), other


def test_pairs_just_above_are_found(spark):
    rng = random.Random(1)
    rows = [(2 * i + k, text) for i in range(150) for k, text in enumerate(at_least(rng, 0.80, 0.84))]
    assert kept(spark, rows) == [2 * i for i in range(150)]


def test_what_is_less_alike_stays(spark):
    rng = random.Random(2)
    rows = [(2 * i + k, text) for i in range(100) for k, text in enumerate(at_least(rng, 0.70, 0.79))]
    filler = "w " * 120
    rows += [(1000 + i, filler + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(12)]
    assert kept(spark, rows) == sorted(d for d, _ in rows)


def test_two_families_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(3)
    base = [f"t{i}" for i in range(204)]
    other = base[:180] + [f"o{i}" for i in range(24)]
    rows = [(2 * i + k, changed(rng, words, 2)) for i in range(60) for k, words in enumerate((base, other))]
    rows += [(500 + i, changed(rng, changed(rng, base, 3).split(), 3)) for i in range(40)]
    rng.shuffle(rows)
    assert kept(spark, rows) == leaders(rows)


def test_parts_of_a_bucket_all_meet(spark, monkeypatch):
    """Members that are far from the bucket's first, each near one other that is dealt to any part."""
    monkeypatch.setattr(simhash, "BUCKET", 4)
    sketch = simhash.sketches(spark.createDataFrame([(0, "far " * 3 + " ".join(f"a{i}" for i in range(99)))] + [(1 + i, f"x{i // 2} " * 2 + " ".join(f"b{i // 2}-{k}" for k in range(99))) for i in range(40)], COLUMNS), 5)
    members = sketch.selectExpr("doc_id as no", "n", "fp", "table", "doc_id as root", "0L as first", "41L as times", "7L as key")
    assert sorted((r.a, r.b) for r in simhash._across(members, 0.8).collect()) == [(1 + i, 2 + i) for i in range(0, 40, 2)]
