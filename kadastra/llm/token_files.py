"""Token ids of a corpus in binary files of patched frame-of-reference blocks.

Layout. The files lie in the shared folder, one per range of ids, and hold segments of whole documents in ascending id
order (TARGET_IDS ids or a little more each; a longer document is a segment of its own). A segment is one binary image:

    magic "PFR1" | u4 ids | u4 documents | u4 blocks
    documents x u4: length of each document
    blocks x (u4 start of the block in the payload, u4 minimum, u1 width, u1 exceptions, u2 zero)
    payload: for each block its BLOCK ids minus the minimum, the low `width` bits of each, one plane of bits after another;
             then its exceptions: u1 position, u4 high part

The width of a block is the least that holds the given PERCENTILE of its values; larger values are the exceptions and
keep their high part in the list. The index of block starts lets a reader unpack any block alone. Images travel as a
binary column beside their range number, sequence number, first position and document ids, so Spark's own writers place
and commit the files and a lost executor leaves none half written.

Defined results: null text counts as empty; every document ends with END_ID, so that none has no ids; null ids come
first; equal ids keep their rows. An empty table writes no segment. Other columns are never read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.llm.words import Memory, Ragged, chunks, white_space_words
from kadastra.shipping import ship

END_ID = 2
BLOCK = 128
PERCENTILE = 90
TARGET_IDS = 65_536
MAGIC = b"PFR1"
#: Distinct words whose ids a worker remembers before it starts again.
REMEMBERED = 1_000_000
#: Letters below this code point have no combining forms, and keep their class in all versions of Unicode.
LATIN = 0x250
LAST = chr(LATIN)
#: Bytes of text that are encoded together; a longer text is encoded alone.
CHUNK_BYTES = 8_000_000

_INDEX = np.dtype([("start", "<u4"), ("low", "<u4"), ("width", "u1"), ("patches", "u1"), ("zero", "<u2")])
_PATCH = np.dtype([("at", "u1"), ("high", "<u4")])


# ---- blocks


def pack(ids: np.ndarray, lengths: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """The image of one segment."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = MAGIC + np.array([n, len(lengths), blocks], "<u4").tobytes() + np.asarray(lengths, "<u4").tobytes()
    if not n:
        return head
    values = np.full(blocks * BLOCK, ids[-1], dtype=np.uint32)
    values[:n] = ids
    values = values.reshape(blocks, BLOCK)
    low = values.min(axis=1)
    values = values - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    common = np.partition(values, rank, axis=1)[:, rank]
    width = np.where(common > 0, np.floor(np.log2(np.maximum(common, 1))).astype(np.int64) + 1, 0).astype(np.uint8)
    outside = values >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    patches = outside.sum(axis=1)
    index = np.zeros(blocks, _INDEX)
    index["low"], index["width"], index["patches"] = low, width, patches
    sizes = width.astype(np.int64) * (BLOCK // 8) + patches * _PATCH.itemsize
    starts = np.concatenate([[0], np.cumsum(sizes)])
    index["start"] = starts[:-1]
    payload = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            own = values[rows].astype(np.uint16 if w <= 16 else np.uint32)  # what exceeds the width is in the list
            planes = np.empty((len(rows), w, BLOCK // 8), np.uint8)
            for bit in range(w):
                planes[:, bit] = np.packbits((own >> bit).astype(np.uint8) & 1, axis=1, bitorder="little")
            payload[starts[rows][:, None] + np.arange(w * (BLOCK // 8))] = planes.reshape(len(rows), -1)
    block, at = np.nonzero(outside)
    if len(block):
        listed = np.zeros(len(block), _PATCH)
        listed["at"], listed["high"] = at, values[block, at] >> width[block]
        payload[_patch_places(index, starts[:-1])[:, None] + np.arange(_PATCH.itemsize)] = listed.view(np.uint8).reshape(len(block), -1)
    return head + index.tobytes() + payload.tobytes()


def unpack(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, length of each document) of a segment."""
    if image[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, documents, blocks = (int(x) for x in np.frombuffer(image, "<u4", 3, 4))
    lengths = np.frombuffer(image, "<u4", documents, 16)
    index = np.frombuffer(image, _INDEX, blocks, 16 + 4 * documents)
    payload = np.frombuffer(image, np.uint8, offset=16 + 4 * documents + _INDEX.itemsize * blocks)
    return _blocks(index, payload).reshape(-1)[:n], lengths


def unpack_block(image: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by the index of block starts."""
    n, documents, blocks = (int(x) for x in np.frombuffer(image, "<u4", 3, 4))
    index = np.frombuffer(image, _INDEX, blocks, 16 + 4 * documents)
    payload = np.frombuffer(image, np.uint8, offset=16 + 4 * documents + _INDEX.itemsize * blocks)
    return _blocks(index[block : block + 1], payload)[0][: min(BLOCK, n - block * BLOCK)]


def _patch_places(index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each exception of each block lies in the payload."""
    counts = index["patches"].astype(np.int64)
    rank = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts + index["width"].astype(np.int64) * (BLOCK // 8), counts) + rank * _PATCH.itemsize


def _blocks(index: np.ndarray, payload: np.ndarray) -> np.ndarray:
    values = np.zeros((len(index), BLOCK), np.uint32)
    starts = index["start"].astype(np.int64)
    for w in np.unique(index["width"]).tolist():
        rows = np.flatnonzero(index["width"] == w)
        if w:
            planes = payload[starts[rows][:, None] + np.arange(w * (BLOCK // 8))].reshape(len(rows), w, BLOCK // 8)
            own = np.zeros((len(rows), BLOCK), np.uint16 if w <= 16 else np.uint32)
            for bit in range(w):
                own |= np.unpackbits(planes[:, bit], axis=1, bitorder="little").astype(own.dtype) << own.dtype.type(bit)
            values[rows] = own
    counts = index["patches"].astype(np.int64)
    if counts.any():
        listed = payload[_patch_places(index, starts)[:, None] + np.arange(_PATCH.itemsize)].reshape(-1).view(_PATCH)
        block = np.repeat(np.arange(len(index)), counts)
        values[block, listed["at"]] |= listed["high"] << index["width"][block].astype(np.uint32)
    return values + index["low"][:, None]


# ---- encoding


#: What the short cut below presumes of the tokenizer's file. Fixed values.
SHORT_CUT = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
_MARKS = r"[!-&(-/:;=-@\[-`{-~]*"  # ASCII marks but the apostrophe, which begins endings, and "<", which begins special tokens
_LETTERS = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*"
_PLAIN = re.compile(f"({_MARKS})({_LETTERS})({_MARKS})").fullmatch


class WordEncoder:
    """Texts to ids, by distinct words where the tokenizer's file allows it.

    A tokenizer with the rules in SHORT_CUT drops white space and never joins what white space parts, so that a text's ids are
    those of its words in turn. A word of Latin letters with marks around it is a pre-token of marks, one of letters and one
    of marks, which the library's model splits directly; all other words go through the whole tokenizer. What a word gave is
    remembered, up to REMEMBERED words. A tokenizer with other rules encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.by_words = all(rules[k] == v for k, v in SHORT_CUT.items()) and all(t["content"].startswith("<") and not re.search(r"\s", t["content"]) for t in rules["added_tokens"])
        self.model = self.tokenizer.model
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({c: to_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x80, LATIN)) if c.isalpha()})
        self.memory, self.ids, self.parts = Memory(REMEMBERED), Ragged(np.uint32), {}

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token, in lower case."""
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.letters))]
            found = self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def word(self, word: str) -> bytes:
        """Its ids, each as a little-endian u4."""
        plain = _PLAIN(word)
        if plain is None:
            return self._whole(word)
        before, letters, after = plain.groups()
        low = letters.lower()
        if not letters.isascii() and not (letters.isalpha() and low.isalpha() and max(low) < LAST):
            return self._whole(word)
        return b"".join([self._part(part) for part in (before, low, after) if part])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text), END_ID included; null is empty."""
        if not self.by_words:
            each = [x.ids for x in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            counts = np.array([len(x) + 1 for x in each], np.int64)
            return np.array([i for own in each for i in (*own, END_ID)], np.uint32), counts
        words, n_words = white_space_words(texts)
        number, new, kept = self.memory.place(words)
        if kept is not None:
            self.ids.keep(kept)
        found = [self.word(w) for w in new]
        self.ids.extend(np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4)
        ids, sizes = self.ids.take(number)
        counts = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n_words)])])
        return np.insert(ids, np.cumsum(counts), np.uint32(END_ID)), counts + 1


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


_SEGMENT = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("image", pa.binary())])
_SEGMENT_SQL = "part int, seq int, first long, n_ids long, doc_ids array<long>, image binary"


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document and write the files under path, in ascending id order."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        seq = first = size = 0
        waiting: list[tuple[int, np.ndarray]] = []

        def close():
            nonlocal seq, first, size, waiting
            ids = np.concatenate([x for _, x in waiting])
            image = pack(ids, np.array([len(x) for _, x in waiting]))
            row = {"part": part, "seq": seq, "first": first, "n_ids": len(ids), "doc_ids": [d for d, _ in waiting], "image": image}
            seq, first, size, waiting = seq + 1, first + len(ids), 0, []
            return pa.RecordBatch.from_pylist([row], schema=_SEGMENT)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for began, n in chunks(batch.column(1), CHUNK_BYTES):
                ids, counts = encoder.encode(batch.column(1).slice(began, n))
                for doc_id, own in zip(doc_ids[began : began + n], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    waiting.append((doc_id, own))
                    size += len(own)
                    if size >= TARGET_IDS:
                        yield close()
        if waiting:
            yield close()

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(segments, _SEGMENT_SQL).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), ids (array), one row per document."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = unpack(row["image"])
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths + row["start"]
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts), values], names=["doc_id", "start", "ids"])

    return _placed(spark, path).mapInArrow(documents, "doc_id long, start long, ids array<long>")


def describe_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document as read from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian u4)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = unpack(row["image"])
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths + row["start"]), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return _placed(spark, path).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The segments with their first position in the corpus. There is one offset for each range of ids: its number of
    rows is that of the writing job's partitions, whatever the corpus holds, so it is broadcast."""
    ship(spark)
    stored = spark.read.schema(_SEGMENT_SQL).parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return stored.join(F.broadcast(offsets), "part").select("doc_ids", (F.col("first") + F.col("offset")).alias("start"), "image")
