"""Words of many texts at once: each distinct one is handled once, and a worker remembers what it has handled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def white_space_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts in a row, and the number of each text's words; null has none."""
    return without_empty(pc.ascii_split_whitespace(texts))


def chunks(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of at most so many bytes together; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        began = at
        at = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right")))
        yield began, at - began


def without_empty(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The strings of all lists that aren't empty, and how many each list has."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    ends = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(sizes)])]
    return flat.filter(pa.array(full)), np.diff(ends)


class Memory:
    """Numbers distinct words in the order in which a worker met them, up to `most`; then only those at hand keep a number."""

    def __init__(self, most: int):
        self.most = most
        self.known = pa.array([], pa.string())

    def place(self, words: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray | None]:
        """(number of each word, words that are new, in the order of their numbers, the old numbers that remain if others were
        forgotten, in the order of their new ones)."""
        coded = words.dictionary_encode()
        each = coded.dictionary
        at = pc.index_in(each, value_set=self.known) if len(self.known) else pa.nulls(len(each), pa.int32())
        number = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        fresh, kept = number < 0, None
        if len(self.known) + int(fresh.sum()) > self.most:
            kept = number[~fresh]
            self.known = each.filter(pa.array(~fresh))
            number[~fresh] = np.arange(len(kept))
        new = each.filter(pa.array(fresh))
        number[fresh] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        return number[coded.indices.to_numpy()], new.to_pylist(), kept


class Ragged:
    """Lists of numbers, one for each word, that grow together with a Memory."""

    def __init__(self, dtype: type):
        self.dtype = dtype
        self.clear()

    def keep(self, words: np.ndarray) -> None:
        """Forget all lists but those of these words."""
        flat, sizes = self.take(words)
        self.clear()
        self.extend(flat, sizes)

    def clear(self) -> None:
        self.flat, self.start, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = self.n = 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """One list for each size, their numbers in a row."""
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(self.used // 2, len(flat)), self.dtype)])
        if self.n + len(sizes) > len(self.start):
            more = np.zeros(max(self.n // 2, len(sizes)), np.int64)
            self.start, self.size = np.concatenate([self.start[: self.n], more]), np.concatenate([self.size[: self.n], more])
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[self.n : self.n + len(sizes)] = sizes
        self.start[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def take(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the lists of these words in a row, size of each)."""
        sizes = self.size[words]
        at = np.repeat(self.start[words] - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at], sizes


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the values of each text's words, added in their order."""
    return np.bincount(np.repeat(np.arange(len(counts)), counts), weights=values, minlength=len(counts))
