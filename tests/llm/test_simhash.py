import numpy as np
import pytest
import xxhash

from kadastra.llm import simhash

DOCS = "doc_id long, text string, lang string, fp string"


def slow_fingerprint(text, width):
    words = [w for w in (text or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    runs = [words[i : i + width] for i in range(len(words) - width + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, width=3, bits=3):
    fps = [slow_fingerprint(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((-1 if d is None else d, f"{fps[i]:016x}", low.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def run(spark, rows):
    got = simhash.near_groups(spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DOCS)).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got)


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = list(rng.choice(vocabulary, 120))
        rows.append((i, " ".join(words)))
        for k in range(3):
            near = list(words)
            near[int(rng.integers(120))] = "CHANGED"
            rows.append((1000 + i * 3 + k, "\n".join(near)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one two"), (5004, "ONE two"), (5004, "ONE two"), (None, "one two"), (5005, "é É x"), (6000, "w " * 50000)]
    assert run(spark, rows) == slow_groups(rows)


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for i in range(1, 300):
        if rng.random() < 0.7:
            fps[i] = fps[rng.integers(i)] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False)))
    a, b = simhash.forest(fps[:, None], simhash.pivot_table(fps[:, None]), 3)
    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist()):
        assert int(fps[x] ^ fps[y]).bit_count() <= 3 and find(x) != find(y)
        root[find(x)] = find(y)
    assert all(find(i) == find(j) for i in range(300) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("blocks", simhash.BLOCKS)
def test_keys_lose_no_link(blocks):
    rng = np.random.default_rng(blocks)
    a = rng.integers(0, 2**63, 200, dtype=np.uint64)
    b = a.copy()
    for i in range(200):
        for bit in rng.choice(64, 3, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    import pyarrow as pa

    def keys(x):
        out = [set() for _ in x]
        where = {int(v): i for i, v in enumerate(x)}
        for batch in simhash._keys(blocks, 3)([pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.nulls(len(x), pa.binary())], names=["fp", "table"])]):
            for fp, _, key, choice in zip(*(c.to_pylist() for c in batch.columns)):
                out[where[fp % 2**64]].add((key, choice))
        return out

    assert all(p & q for p, q in zip(keys(a), keys(b)))


def test_large_buckets_are_keyed_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(40):
            x = int(b)
            for bit in rng.choice(20, int(rng.integers(1, 4)), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        assert ((r.a ^ r.b) % 2**64).bit_count() <= 3
        root[find(r.a % 2**64)] = find(r.b % 2**64)
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                assert find(x) == find(y)
