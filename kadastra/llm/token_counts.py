"""Token counts by trie-shared dynamic programming.

Distinct pre-tokens go into one trie per worker. Each node holds the best unigram score of the letters that lead to it
and the number of pieces that score takes: a node's forward score is the best, over pieces that end there, of the score
where the piece begins plus the piece's own; ties take fewer pieces. It is computed once, when the node is made, so a
prefix that many pre-tokens share costs nothing again; a pre-token's count is read at its last node. A document's count is
the sum over its pre-tokens. Nothing is shuffled, and a worker's trie begins anew at NODES nodes.

Defined results: null and empty texts have no pre-tokens and no tokens. Rows with null or repeated ids are each counted.
An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadastra.llm.pieces import Pieces, all_pre_tokens, letter_bytes, load
from kadastra.llm.words import Memory, chunks, per_text
from kadastra.shipping import ship

NODES = 1_500_000
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 1_000_000
#: Bytes of text that are counted together; a longer text is counted alone.
CHUNK_BYTES = 8_000_000


class Trie:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.forward = [0.0]
        self.count = [0]

    def _make(self, node: int, word: str, end: int, path: list[int]) -> int:
        """The node that the first `end` letters of the word lead to; path has the nodes of its shorter prefixes."""
        scores, best, fewest = self.pieces.scores, float("-inf"), 0
        for begin in range(max(0, end - self.pieces.longest), end):
            score = scores.get(word[begin:end])
            if score is not None:
                at = path[begin]
                score += self.forward[at]
                if score > best or (score == best and self.count[at] + 1 < fewest):
                    best, fewest = score, self.count[at] + 1
        letter = word[end - 1]
        if letter not in scores:
            n = len(letter_bytes(letter))
            score = self.forward[node] + n * self.pieces.byte_score
            if score > best or (score == best and self.count[node] + n < fewest):
                best, fewest = score, self.count[node] + n
        made = self.next[node, letter] = len(self.forward)
        self.forward.append(best)
        self.count.append(fewest)
        return made

    def __getitem__(self, word: str) -> tuple[int, float]:
        """(pieces, score) of a pre-token."""
        if len(self.forward) + len(word) > NODES:
            self.clear()
        node, path = 0, [0]
        for i, letter in enumerate(word, 1):
            after = self.next.get((node, letter))
            node = self._make(node, word, i, path) if after is None else after
            path.append(node)
        return self.count[node], self.forward[node]


class Counts:
    """Counts of whole texts; remembers those of each distinct pre-token."""

    def __init__(self, pieces: Pieces):
        self.trie, self.memory = Trie(pieces), Memory(REMEMBERED)
        self.terminal = np.zeros((2, 0))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pre-tokens, tokens, score) of each text."""
        words, parts = all_pre_tokens(texts)
        number, new, kept = self.memory.place(words)
        if kept is not None:
            self.terminal = self.terminal[:, kept]
        found = np.array([self.trie[w] for w in new], float).reshape(-1, 2).T
        self.terminal = np.concatenate([self.terminal, found], axis=1)
        tokens, scores = self.terminal[:, number]
        return parts, per_text(tokens, parts).astype(np.int64), per_text(scores, parts)


_COUNTS: dict[str, Counts] = {}


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_pretokens, n_tokens, log_prob (of the best segmentation)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _COUNTS:
            _COUNTS[model_path] = Counts(load(model_path))
        for batch in batches:
            for at, n in chunks(batch.column(1), CHUNK_BYTES):
                parts, tokens, scores = _COUNTS[model_path](batch.column(1).slice(at, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(parts, pa.int64()), pa.array(tokens), pa.array(scores)], names=["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, log_prob double")
