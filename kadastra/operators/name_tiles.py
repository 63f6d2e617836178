"""Alike names, tile by tile: Spark deals names to the tiles of their rarest trigrams, a tile's names are compared where they meet.

Pairs are never shuffled. A pair meets in each tile of a trigram that both begin with, in the order of all, and is told in the tile of the
first trigram that they share, so that it is told once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Numbers that a block of one side holds at most, its names in a row for each trigram of its tile.
BLOCK = 1 << 22
#: What an earlier shared trigram takes from the count of those shared: more than names have.
EARLIER = 4096.0


class _Grams:
    """Which name of either side has which trigram, as far as both sides have it; trigrams are numbered in their order."""

    def __init__(self, left: pa.Table, right: pa.Table, column: str):
        flat, self.rows, self.sizes = [], [], []
        for side in (left, right):
            lists = side.column(column).combine_chunks()
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat.append(lists.flatten())
            self.rows.append(np.repeat(np.arange(len(sizes)), sizes))
            self.sizes.append(sizes)
        known = [f.dictionary_encode() for f in flat]
        codes, names = [k.indices.to_numpy(zero_copy_only=False) for k in known], [np.array(k.dictionary.to_pylist(), object) for k in known]
        self.names = np.array(sorted(set(names[0]) & set(names[1])), object)
        at = {name: i for i, name in enumerate(self.names)}
        for i in (0, 1):
            code = np.array([at.get(n, -1) for n in names[i]], np.int64)[codes[i]] if len(codes[i]) else np.zeros(0, np.int64)
            self.rows[i], codes[i] = self.rows[i][code >= 0], code[code >= 0]
        self.codes = codes

    def block(self, side: int, low: int, high: int) -> np.ndarray:
        a, b = np.searchsorted(self.rows[side], (low, high))
        out = np.zeros((high - low, len(self.names)), np.float32)
        out[self.rows[side][a:b] - low, self.codes[side][a:b]] = 1
        return out

    def alike(self, shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shared trigrams over all, for names a and b."""
        every = self.sizes[0][a] + self.sizes[1][b] - shared
        return np.divide(shared, every, out=np.zeros(len(a)), where=every > 0)


def _blocks(n: int, width: int) -> Iterator[tuple[int, int]]:
    step = max(1, min(4096, BLOCK // max(1, width)))
    yield from ((low, min(low + step, n)) for low in range(0, n, step))


def told(left: pa.Table, right: pa.Table, least: float, same_base: float, schema: pa.Schema) -> pa.Table:
    """(l_id, r_id, similarity, translit, phase, line) of the tile's names (tile, latin, first, id, grams, plain, base, phase, product, changed) that are alike.

    grams are what the tile compares by; in tiles of Latin letters pairs count that these change, and that are not alike by the plain ones. phase and
    line are 1 where they fit, 2 where they clash. `first` is the tile's trigram."""
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    latin, first = left.column("latin")[0].as_py(), left.column("first")[0].as_py()
    column = lambda name: [t.column(name).combine_chunks() for t in (left, right)]
    grams, base = _Grams(left, right, "grams"), _Grams(left, right, "base")
    plain = _Grams(left, right, "plain") if latin else None
    before = np.searchsorted(grams.names, first)
    changed = [c.to_numpy(zero_copy_only=False) for c in column("changed")]
    phases = [c.fill_null(-1).to_numpy(zero_copy_only=False) for c in column("phase")]
    products = [np.array([-1 if p is None else hash_of.setdefault(p, len(hash_of)) for p in c.to_pylist()]) for hash_of in [{}] for c in column("product")]
    found = []
    for low, high in _blocks(left.num_rows, len(grams.names)):
        one = grams.block(0, low, high)
        one[:, :before] *= -EARLIER
        for start, end in _blocks(right.num_rows, len(grams.names)):
            shared = one @ grams.block(1, start, end).T
            may = shared >= (grams.sizes[0][low:high, None] + grams.sizes[1][None, start:end]) * (least / (1 + least)) - 0.01
            if latin:
                may &= changed[0][low:high, None] | changed[1][None, start:end]
            x, y = np.nonzero(may)
            if not len(x):
                continue
            also = lambda g: (g.block(0, low, high) @ g.block(1, start, end).T)[x, y].astype(np.int64)  # noqa: B023, E731
            a, b = x + low, y + start
            sim = grams.alike(shared[x, y].astype(np.int64), a, b)
            fine = sim >= least
            if latin:
                fine &= plain.alike(also(plain), a, b) < least
            p, q = phases[0][a], phases[1][b]
            lone = (p < 0) != (q < 0)
            if (lone & fine).any():
                lone &= base.alike(also(base), a, b) >= same_base
            fits, both = (lone & (np.maximum(p, q) == 1)) | ((p >= 0) & (p == q)), (p >= 0) & (q >= 0)
            phase = np.where(fits, 1, np.where(lone | (both & (p != q)), 2, 0))
            s, t = products[0][a], products[1][b]
            line = np.where((s < 0) & (t < 0), 0, np.where(s == t, 1, 2))
            found.append(tuple(c[fine] for c in (a, b, sim, phase, line)))
    if not found:
        return schema.empty_table()
    a, b, sim, phase, line = (np.concatenate(c) for c in zip(*found, strict=True))
    ids = column("id")
    return pa.Table.from_arrays([ids[0].take(pa.array(a)), ids[1].take(pa.array(b)), pa.array(sim), pa.array(np.full(len(a), latin)), pa.array(phase, pa.int32()), pa.array(line, pa.int32())], schema=schema)
