"""Alignment of two tokenizers' tokens over every text, each distinct text once.

Texts are shuffled in full, and each distinct one is tokenised and aligned once; what it adds to the corpus is weighted by the
documents that hold it, and its measures are joined to their ids by the text's SHA-256.

Tokenizer A is byte-level BPE and reads space + text; B is a SentencePiece model, which puts the space itself. Both give the bytes
of space + text back, or the text has no tokens. Between two neighbouring token ends of either lies exactly one pair of
tokens whose byte ranges overlap: a link. Where both tokenizers' tokens end, groups are cut.

Neither tokenizer has a token across a single space or line feed between two letters or marks, so texts are cut into units there, and a
worker remembers what the short ones gave. That rule is read from the tokenizers' files; where it doesn't hold, a text is one unit.

How many documents hold a pair linked is summed from the distinct texts' pairs. A text meets the counts of its pairs in a
broadcast table up to PAIRS pairs, and in an ordinary join beyond.

Defined results: texts that are null, empty, or not given back by a tokenizer have zeros and '' in every column, and no pair. A null id
keeps its row; rows that repeat are counted and returned as often as they occur; an empty table gives an empty result. Other columns
are never read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadastra.llm.common import held
from kadastra.llm.words import Memory, Ragged, chunks, without_empty
from kadastra.shipping import ship

#: Rows up to which the table of pair counts is broadcast: three numbers each.
PAIRS = 1 << 20
#: Units that a worker remembers, and the bytes of the longest of them.
UNITS, LONGEST = 200_000, 64
#: Bytes of text that are aligned at a time.
_BYTES = 2 << 20
_SPACE = "▁"
#: Parts a text where it is cut.
_CUT = "\x00"
#: White space of either kind, as RE2 writes it.
_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Texts in which white space stands beside a space or line feed, or at an end.
_UNEVEN = f"{_WHITE}[ \\n]|[ \\n]{_WHITE}|^{_WHITE}|{_WHITE}$|{_CUT}"
_PLACES = re.compile(r"(?<=\S)(?=[ \n]\S)")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level BPE writes for each byte: itself if it is visible, else the next letter from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """The tokens of units under both tokenizers, and how they lie."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        spelled_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            spelled_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.IdToPiece(i) for i in range(self.b.GetPieceSize())]
        spelled_b = [bytes([int(p[3:5], 16)]) if self.b.IsByte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.spelled_a, self.spelled_b = pa.array(spelled_a, pa.binary()), pa.array(spelled_b, pa.binary())
        self.size_a, self.size_b = (pc.binary_length(s).to_numpy().astype(np.int64) for s in (self.spelled_a, self.spelled_b))
        self.n_b, self.space = len(pieces), self.b.PieceToId(_SPACE)
        rules = json.load(open(path_a, encoding="utf-8"))["pre_tokenizer"]
        self.cuts = (
            rules is not None
            and (rules["type"], rules["add_prefix_space"], rules["use_regex"]) == ("ByteLevel", False, True)
            and not any(_SPACE in p.lstrip(_SPACE) or ("\n" in p) for p in pieces)
            and self.b.encode("\nx", out_type=str)[:1] == [_SPACE]
        )
        self.memory, self.links = Memory(UNITS), Ragged(np.int64)
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A, tokens of B, groups, good
        self.groups = pa.array([], pa.string())

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of space + text of all texts in a row, and how many each has. Texts aren't empty."""
        if not self.cuts:
            return pc.binary_join_element_wise(" ", texts, ""), np.ones(len(texts), np.int64)
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", _CUT + " "), "\n", _CUT + "\n")
        lists = pc.split_pattern(pc.binary_join_element_wise(" ", pc.if_else(uneven, "x", marked), ""), _CUT)
        if not pc.any(uneven).as_py():
            return without_empty(lists)
        own = [_PLACES.split(" " + t) if odd else u for t, odd, u in zip(texts.to_pylist(), uneven.to_pylist(), lists.to_pylist(), strict=True)]
        return pa.array([u for units in own for u in units], pa.string()), np.fromiter(map(len, own), np.int64, len(own))

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A in a row, how many each unit has, the same of B)."""
        first = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        second = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        # B puts a space before a unit that has none of its own
        second = [ids if u[0] == " " else ids[1:] if ids[:1] == [self.space] else [] for u, ids in zip(units, second, strict=True)]
        flat = lambda lists: (np.fromiter((i for ids in lists for i in ids), np.int64), np.fromiter(map(len, lists), np.int64, len(lists)))
        return *flat(first), *flat(second)

    def align(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """For each unit: (tokens of A, tokens of B, groups, good), links as a * n_b + b in a row, how many each has, its groups in writing."""
        n = len(units)
        a, n_a, b, n_b = self._encoded(units.to_pylist())
        raw = pc.cast(units, pa.binary())
        offsets = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        joined = lambda spelled, ids, counts: pc.binary_join(pa.ListArray.from_arrays(offsets(counts), spelled.take(pa.array(ids))), b"")
        good = pc.and_(pc.equal(joined(self.spelled_a, a, n_a), raw), pc.equal(joined(self.spelled_b, b, n_b), raw)).to_numpy(zero_copy_only=False)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
        # the good units are one text: both tokenizers' tokens end where a unit does
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        unit_ends = np.cumsum(pc.binary_length(raw).to_numpy() * good)
        per_unit = lambda places: np.bincount(np.searchsorted(unit_ends, places), minlength=n) if len(places) else np.zeros(n, np.int64)
        # each group in writing: ids of A with commas, a bar, ids of B with commas, and a semicolon before the unit's next
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last = np.isin(both, unit_ends)
        mark_a = np.where(np.isin(end_a, both), "|", ",")
        mark_b = np.where(np.isin(end_b, both), np.where(last[group_b] if len(b) else True, "", ";"), ",")
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written = pc.binary_join_element_wise(pc.cast(pa.array(np.concatenate([a, b])), pa.string()), pa.array(np.concatenate([mark_a, mark_b]).astype(object), pa.string()), "")
        groups = pc.binary_join(pa.ListArray.from_arrays(offsets(n_a + n_b), written.take(pa.array(order))), "")
        counts = np.stack([n_a, n_b, per_unit(both), good.astype(np.int64)], axis=1)
        return counts, a[at_a] * self.n_b + b[at_b], per_unit(ends), groups

    def known(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """align() for units of which the short ones may be known already."""
        numbers, new, kept = self.memory.place(units)
        if kept is not None:
            self.links.keep(kept)
            self.numbers, self.groups = self.numbers[kept], self.groups.take(pa.array(kept))
        if new:
            counts, links, sizes, groups = self.align(pa.array(new, pa.string()))
            self.links.extend(links, sizes)
            self.numbers, self.groups = np.concatenate([self.numbers, counts]), pa.concat_arrays([self.groups, groups])
        return self.numbers[numbers], *self.links.take(numbers), self.groups.take(pa.array(numbers))

    def measures(self, texts: pa.Array) -> pa.RecordBatch:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct), times of texts that aren't empty."""
        flat, per_text = self.units(texts)
        coded = flat.dictionary_encode()
        each = coded.dictionary
        short = pc.less_equal(pc.binary_length(each), LONGEST).to_numpy(zero_copy_only=False)
        place = np.empty(len(each), np.int64)  # short units come first from here on
        place[short], place[~short] = np.arange(short.sum()), short.sum() + np.arange((~short).sum())
        parts = [f(each.filter(pa.array(own))) for f, own in ((self.known, short), (self.align, ~short)) if own.any()]
        counts, links, sizes = (np.concatenate([p[i] for p in parts]) for i in range(3))
        groups = pa.concat_arrays([p[3] for p in parts])
        at = place[coded.indices.to_numpy()]
        text_of = np.repeat(np.arange(len(texts)), per_text)
        good = np.bincount(text_of, weights=counts[at, 3] == 0, minlength=len(texts)) == 0
        sums = [np.bincount(text_of, weights=counts[at, i], minlength=len(texts)).astype(np.int64) * good for i in range(3)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()), groups.take(pa.array(at)))
        written = pc.binary_join(lists, ";")
        digests = [hashlib.sha256(w.as_buffer()).hexdigest() if fine else "" for w, fine in zip(written, good.tolist(), strict=True)]
        starts = np.cumsum(sizes) - sizes
        held_links = sizes[at]
        where = np.repeat(starts[at] - (np.cumsum(held_links) - held_links), held_links) + np.arange(held_links.sum())
        of_text = np.repeat(text_of, held_links)
        fine = good[of_text]
        of_text, pairs = of_text[fine], links[where[fine]]
        order = np.lexsort((pairs, of_text))
        of_text, pairs = of_text[order], pairs[order]
        first = np.flatnonzero(np.concatenate([[True], (of_text[1:] != of_text[:-1]) | (pairs[1:] != pairs[:-1])])) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([first, [len(pairs)]]))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of_text[first], minlength=len(texts)))]), pa.int32())
        n_links = sums[0] + sums[1] - sums[2]  # each end but a group's last adds one
        columns = [*map(pa.array, sums), pa.array(n_links), pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pairs[first])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
        return pa.RecordBatch.from_arrays(columns, names=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


_LOADED: dict[tuple[str, str], Aligner] = {}


def load(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def aligned_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(digest, copies, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of (text, digest, copies), texts not empty; a pair is
    a * number of B's pieces + b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(path_a, path_b)
        for batch in batches:
            for at, number in chunks(batch.column(0), _BYTES):
                own = batch.slice(at, number)
                found = aligner.measures(pa.concat_arrays([own.column(0)]))
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), *found.columns], names=["digest", "copies", *found.schema.names])

    ship(texts.sparkSession)
    return texts.select("text", "digest", "copies").mapInArrow(run, "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).GetPieceSize()
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    distinct = rows.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", digest)
    found = held(aligned_texts(distinct, path_a, path_b), "aligned-texts")
    counts = held(found.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("docs")), "pair-counts")
    first = F.expr(f"pair div {n_b}L")
    best = counts.groupBy(first.alias("a")).agg(F.max("docs").alias("most"))
    table = counts.withColumn("a", first).join(best, "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))
    if counts.count() <= PAIRS:
        table = F.broadcast(table)
    linked = found.select("digest", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("digest", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    weighed = linked.join(table, "pair").groupBy("digest").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    measures = found.select("digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(weighed, "digest", "left")
    named = rows.select("doc_id", F.when(F.col("text") != "", digest).alias("digest")).join(measures, "digest", "left")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return named.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
