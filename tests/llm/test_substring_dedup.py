import numpy as np
import pytest

from kadastra.llm import substring_dedup as sd


def slow(rows, window=13):
    split = [((t or "").encode().split()) for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, split):
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, split):
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((-1 if d is None else d, len(w), len(gone), left))
    return sorted(out)


def run(spark, rows, parts=6):
    docs = spark.createDataFrame([(t, d, 1, "k") for d, t in rows], "text string, doc_id long, n_words int, kept string").repartition(parts)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in sd.remove_repeats(docs).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    word = lambda n, v: [f"w{i}" for i in rng.integers(0, v, n)]
    shared = [word(int(n), 1000) for n in (12, 13, 14, 30, 60, 100)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(int(rng.integers(0, 5))):
            parts += word(int(rng.integers(0, 40)), 1000)
            p = shared[int(rng.integers(0, len(shared)))]
            a = int(rng.integers(0, 5))
            parts += p[a:] if rng.random() < 0.5 else p[: len(p) - a]
        rows.append((d, "\n".join(parts) if d % 3 else "  ".join(parts)))
    rows += [(500 + i, rows[i][1]) for i in range(0, 60, 7)]
    rows += [(900, " ".join(["a"] * 300)), (901, " ".join(["a"] * 20)), (902, " ".join(["a"] * 12)), (903, " ".join(["a", "b"] * 200)), (904, " ".join(["b", "a"] * 9))]
    rows += [(910, None), (911, ""), (912, " \t "), (913, "x\x1cy\x85z " * 40), (914, "x\x1cy\x85z " * 14)]
    assert run(spark, rows) == slow(rows)


def test_null_and_equal_ids(spark):
    text, other = " ".join(f"v{i}" for i in range(40)), " ".join(f"u{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, text), (5, other), (7, other + " " + text), (9, "q " + text[:100]), (9, other)]
    assert run(spark, rows) == slow(rows)


def test_hot_passage_and_long_text(spark):
    hot = " ".join(f"h{i}" for i in range(60))
    rows = [(i, f"own{i} {hot} end{i}") for i in range(400)] + [(1000, " ".join(f"z{i % 7919}" for i in range(120000)))]
    assert run(spark, rows) == slow(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_edges_of_a_hot_passage_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 20)
    rng = np.random.default_rng(5)
    own = lambda: " ".join(f"o{i}" for i in rng.integers(0, 10**6, 15))
    hot = " ".join(f"h{i}" for i in range(20))
    rows = [(i, f"{own()} {hot} {own()}") for i in range(300)]
    seen, of = [], sd._stretches
    monkeypatch.setattr(sd, "_stretches", lambda *a: seen.append(of(*a)) or seen[-1])
    assert run(spark, rows) == slow(rows)
    sizes = {}
    for r in seen[0].filter("kind = 0").collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + sum(1 for _ in sd._unpack(bytes(r["rows"])))
    assert len(sizes) == 16 and max(sizes.values()) <= 2 * sum(sizes.values()) / 16
