"""Pieces of a SentencePiece vocabulary with unigram scores, and the pre-tokens of a text.

The vocabulary is public and is never trained. A BPE vocabulary orders its pieces by how early they were merged; as a
unigram model they get the Zipf-Mandelbrot log-probability of that order, -log(rank + SHIFT) less its normaliser.
A character that is no piece of its own falls back to its UTF-8 bytes, each with the score of the last rank.

A text is read as SentencePiece reads it with an identity rule: one space is put before it and spaces become the meta
symbol. No piece but runs of the symbol itself has it after its first letter, so the text parts before each run of
symbols, and at line feeds (which are in no piece): a lattice of the whole text is the chain of its pre-tokens' lattices.
A text's own meta symbols stand as LITERAL, which no piece holds, and so become the bytes of the symbol: decoding gives
every text back, but for one that holds LITERAL itself, a code point that is no character.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kadastra.llm.words import without_empty

SPACE = "▁"
LITERAL = "\ufdd0"
SHIFT = 2.7
_PARTS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall


#: Parts the text where it is cut; texts that hold it are cut by pattern.
_CUT = "\x00"


def pre_tokens(text: str | None) -> list[str]:
    """An empty text has none."""
    return _PARTS(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)) if text else []


def all_pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of all texts in a row, and the number of each text's."""
    marked = pc.replace_substring(texts, SPACE, LITERAL)
    if pc.any(pc.match_substring(texts, _CUT)).as_py():
        each = [pre_tokens(t) for t in texts.to_pylist()]
        return pa.array([w for own in each for w in own], pa.string()), np.array([len(own) for own in each], np.int64)
    # a cut before each run of symbols, and on both sides of a line feed
    marked = pc.binary_join_element_wise(SPACE, pc.replace_substring(marked, " ", _CUT + SPACE), "")
    marked = pc.replace_substring(pc.replace_substring(marked, SPACE + _CUT, SPACE), "\n", _CUT + "\n" + _CUT)
    empty = pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0)
    return without_empty(pc.split_pattern(pc.if_else(empty, "", marked), _CUT))


def letter_bytes(letter: str) -> bytes:
    """What a letter without a piece falls back to."""
    return (SPACE if letter == LITERAL else letter).encode("utf-8", "surrogatepass")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.GetPieceSize()
        self.byte_ids = [0] * 256
        self.texts: dict[int, bytes] = {}
        normal = []
        for i in range(self.size):
            if model.IsByte(i):
                byte = int(model.IdToPiece(i)[3:5], 16)
                self.byte_ids[byte] = i
                self.texts[i] = bytes([byte])
            elif not (model.IsControl(i) or model.IsUnknown(i) or model.IsUnused(i)):
                normal.append(model.IdToPiece(i))
                self.texts[i] = normal[-1].replace(SPACE, " ").encode()
        norm = math.log(sum(1 / (r + SHIFT) for r in range(len(normal) + 256)))
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i in sorted(self.texts):
            if not model.IsByte(i):
                piece = model.IdToPiece(i)
                self.scores[piece] = -math.log(len(self.ids) + SHIFT) - norm
                self.ids[piece] = i
        self.byte_score = -math.log(len(normal) + SHIFT) - norm
        self.longest = max(map(len, self.ids))
        self.spelled = pa.array([self.texts.get(i, b"") for i in range(self.size)], pa.binary())

    def decode(self, ids) -> str:
        """The text of ids; bytes that make no character become U+FFFD."""
        return b"".join([self.texts[i] for i in ids]).decode("utf-8", "replace")[1:]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of lists of ids, which stand in a row."""
        flat = self.spelled.take(pa.array(ids))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(), dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])]
        raw = flat.buffers()[2].to_pybytes() if len(flat) else b""
        return pa.array([raw[a:b].decode("utf-8", "replace")[1:] for a, b in zip(ends, ends[1:], strict=False)], pa.string())


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]
