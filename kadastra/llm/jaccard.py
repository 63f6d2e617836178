"""Join of documents on the Jaccard similarity of their n-gram sets: size-banded tiles, hashed bitmaps, exact intersection.

A document's set is its distinct shingles of `width` words, named by 64-bit hashes; documents with equal sets are one from then on.

1. Order. Every set is ordered by how much its shingles' bins stand out in the corpus, then by hash. Any order that is the same
   everywhere loses nothing; this one leaves passages that very many documents share to the end.
2. Prefixes. Two sets of the similarity have their first common shingle among the first n - ceil(similarity * n) + 1 of either.
   Only prefix shingles that two documents share go on.
3. Stars. In each (shingle, size band) the document that shares most of its prefix leads; each document is compared with the leader
   that it meets most often. That brings most members of large groups together, so that they need no comparing.
4. Tiles. What is still apart from most of its shingle's documents is compared with all of them: documents of a shingle fall into
   bands of size, of which only neighbours can hold pairs, and bands into parts of at most about TILE documents; a tile is a
   part of those apart against a part of all, and is one unit of work.
5. Bitmaps. Each set has a bitmap of hashed shingles, with a width that grows with its band. Every bit in which two bitmaps differ
   is a shingle that only one of them has, which bounds the overlap from above; pairs whose bound is too low are discarded.
6. Survivors' sorted arrays are intersected, which decides. Components of the links give the classes.

Defined results: A-Z count as a-z, other letters stay; words are [^\\x20\\x09-\\x0D]+. With fewer words than `width` all of them are
one shingle; null and empty texts, or such without words, have no shingle, and are linked with nothing. Rows that share an id
are one document, linked if any of its texts is. Rows without an id take the class of rows with the same set, else null, and link
nothing. A text without words stays apart even if its id has another. Repeated rows are returned as often as they occur; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadastra.llm.common import bitmap, cut, held, in_bitmap
from kadastra.llm.components import components
from kadastra.llm.words import chunks, white_space_words
from kadastra.shipping import ship

#: Bins of the table of shingles that stand out: a byte each is what tasks hold.
BINS = 1 << 20
#: Bins that travel together.
_BLOCK = 1 << 14
#: Ratio of a band's sizes, a hair above 1 / similarity, so that rounding never puts a pair further apart than neighbours.
_HAIR = 1.0001
#: Documents of a part of a band.
TILE = 1024
#: Shingles of a document that its rows carry, so that a pair is told by one of the tiles that it meets in.
EARLY = 16
#: Pairs that are compared at a time.
PAIRS = 1 << 20
#: Bytes of text whose shingles are at hand at a time.
_BYTES = 4 << 20
_MIX = np.array([xxhash.xxh64_intdigest(b"place %d" % i) | 1 for i in range(64)], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _runs(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of texts: hashes of all words in a row, of the run of `width` words from each on, and how many words each text has."""
    for first, number in chunks(texts, _BYTES):
        words, sizes = white_space_words(pc.ascii_lower(texts.slice(first, number)))
        coded = words.dictionary_encode()
        each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        hashes = each[coded.indices.to_numpy()]
        runs = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for place in range(width):
            runs += hashes[place : place + len(runs)] * _MIX[place]
        yield hashes, _mixed(runs), sizes


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for hashes, runs, sizes in _runs(texts, width):
        end = 0
        for size in sizes.tolist():
            begin, end = end, end + size
            if size >= width:
                yield np.unique(runs[begin : end - width + 1])
            elif size:
                few = (hashes[begin:end] * _MIX[:size]).sum(dtype=np.uint64)
                yield _mixed(np.array([few + _MIX[63] * np.uint64(size)], np.uint64))
            else:
                yield runs[:0]


def standing_out(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """For each bin of shingle hashes 0, or how often its count doubles twice the mean: all shingles of all documents are counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            for _, runs, sizes in _runs(batch.column(0), width):
                inside = np.arange(len(runs)) + width <= np.repeat(np.cumsum(sizes), sizes)[: len(runs)]
                counts += np.bincount(_bin(runs[inside]), minlength=BINS)
        small = counts.astype(np.uint8 if counts.max() < 256 else np.uint16 if counts.max() < 65536 else np.int64).reshape(-1, _BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(small)), pa.int32()), pa.array([r.tobytes() for r in small], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 8: np.int64}[len(raw) // _BLOCK])
                sums[block] = sums.get(block, 0) + own.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"])

    ship(docs.sparkSession)
    blocks = docs.select(text_col).mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary")
    total = np.zeros((BINS // _BLOCK, _BLOCK), np.int64)
    for block, raw in blocks.collect():  # BINS numbers, whatever the number of documents
        total[block] = np.frombuffer(raw, np.int64)
    total = total.reshape(-1)
    usual = 2 * total.mean() + 64
    return np.maximum(0, np.floor(np.log2(np.maximum(total, 1) / usual)) + 1).astype(np.uint8)


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def band(sizes: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(sizes) / np.log(_HAIR * 100 / percent)).astype(np.int32)


def bitmap_width(band_no: int, percent: int) -> int:
    """Bits: a power of two of 2 to 4 times the band's least size, at least 64."""
    least = (_HAIR * 100 / percent) ** band_no
    return max(64, 1 << int(np.ceil(np.log2(2 * least))))


def _bits(hashes: np.ndarray, width: int) -> bytes:
    on = np.zeros(width, bool)
    on[(hashes & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


def _folded(rows: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of one width; wider ones are folded, which keeps what a hash's low bits say."""
    out = np.zeros((len(rows), width // 64), np.uint64)
    for i, raw in enumerate(rows):
        out[i] = np.bitwise_or.reduce(np.frombuffer(raw, np.uint64).reshape(-1, width // 64), axis=0)
    return out


def marks(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, classes: np.ndarray) -> DataFrame:
    """(doc_id, sid, n, band, prefix, bits): the digest and size of each set, its band, prefix and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, number in chunks(batch.column(1), _BYTES):
                sids, sizes, bands, prefixes, bits = [], [], [], [], []
                for own in shingle_sets(batch.column(1).slice(at, number), width):
                    n = len(own)
                    sids.append(xxhash.xxh3_128_digest(own.tobytes()))
                    sizes.append(n)
                    bands.append(int(band(np.array([max(n, 1)]), percent)[0]))
                    if n:
                        first = n + (-percent * n) // 100 + 1
                        order = np.argsort(classes[_bin(own)], kind="stable")[:first]
                        prefixes.append(own[order].view(np.int64))
                        bits.append(_bits(own, bitmap_width(bands[-1], percent)))
                    else:
                        prefixes.append(np.zeros(0, np.int64))
                        bits.append(b"")
                columns = [batch.column(0).slice(at, number), pa.array(sids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sid", "n", "band", "prefix", "bits"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, sid binary, n long, band int, prefix array<long>, bits binary")


def may_link(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bound of the overlap that sizes and bitmaps give allows the similarity."""
    apart = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    most = np.minimum((n_a + n_b - apart) // 2, np.minimum(n_a, n_b))
    return 100 * most >= percent * (n_a + n_b - most)


def _bounded(pairs: DataFrame, distinct: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that bitmaps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for n_a, bits_a, n_b, bits_b in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                width = 8 * min(len(bits_a), len(bits_b))
                fine.append(bool(may_link(np.int64(n_a), _folded([bits_a], width)[0], np.int64(n_b), _folded([bits_b], width)[0], percent)))
            at = pa.array(np.flatnonzero(np.array(fine, bool)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    side = lambda x: distinct.select(F.col("no").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the similarity: sorted arrays are intersected. rows: (doc_id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, number in chunks(batch.column(1), _BYTES):
                own = [s.tobytes() for s in shingle_sets(batch.column(1).slice(at, number), width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, number), pa.array(own, pa.binary())], names=["no", "set"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for raw_a, raw_b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(raw_a, np.uint64), np.frombuffer(raw_b, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                fine.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
            at = pa.array(np.flatnonzero(np.array(fine, bool)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    pairs = cut(pairs)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct()
    told = in_bitmap(rows.withColumn("_h", F.xxhash64("doc_id")), "_h", bitmap(needed.select(F.xxhash64("no").alias("h"))))
    known = held(told.filter("maybe").select("doc_id", "text").mapInArrow(sets, "no long, set binary"), "compared-sets")
    left, right = known.select(F.col("no").alias("a"), F.col("set").alias("s")), known.select(F.col("no").alias("b"), F.col("set").alias("t"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(meet, "a long, b long").distinct()


def _star_pairs(met: DataFrame) -> DataFrame:
    """(a, b): each document of (key, band, no, weight) with the leader that it meets most often."""
    lead = met.groupBy("key", "band").agg(F.max(F.struct("weight", (-F.col("no")).alias("no"))).alias("l")).select("key", "band", (-F.col("l.no")).alias("b"))
    often = met.select("key", "band", "no").join(lead, ["key", "band"]).filter("no <> b").groupBy("no", "b").agg(F.count(F.lit(1)).alias("times"))
    best = often.groupBy("no").agg(F.max(F.struct("times", (-F.col("b")).alias("b"))).alias("m")).select("no", (-F.col("m.b")).alias("other"))
    return best.select(F.least("no", "other").alias("a"), F.greatest("no", "other").alias("b")).distinct()


def _tile_pairs(met: DataFrame, distinct: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different roots that share a prefix shingle and that bitmaps allow, from (key, band, no, root).

    Shingles go by 32 bits here, which joins some tiles and parts none. Documents that share many shingles meet in many tiles; the tile of
    their least common one tells them, as far as the EARLY least shingles of each show that there is a lesser one: a pair is never left out."""

    def linked(key, no, n, root, side, tile, bits, early):
        """Pairs of whole tiles, whose rows stand together, those of the apart first."""
        wide = np.array([len(b) for b in bits])
        first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        rights = np.add.reduceat((side > 0).astype(np.int64), first)
        ends = np.concatenate([first[1:], [len(tile)]])
        left = np.flatnonzero(side == 0)
        at = np.searchsorted(first, left, side="right") - 1
        many, begin = rights[at], (ends - rights)[at]
        total = np.cumsum(many)
        for low in range(0, int(total[-1]) if len(total) else 0, PAIRS):
            some = slice(np.searchsorted(total, low, side="right"), np.searchsorted(total, low + PAIRS, side="right"))
            x = np.repeat(left[some], many[some])
            y = np.arange(len(x)) + np.repeat(begin[some] - (np.cumsum(many[some]) - many[some]), many[some])
            # two that are both apart are met from both sides
            fine = (root[x] != root[y]) & ((side[y] == 1) | (no[x] < no[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[fine], y[fine]
            width = np.minimum(wide[x], wide[y])
            for w in np.unique(width):
                own_x, own_y = x[width == w], y[width == w]
                rows, place = np.unique(np.concatenate([own_x, own_y]), return_inverse=True)
                folded = _folded([bits[i] for i in rows], 8 * int(w))
                for part in range(0, len(own_x), max(1, (8 << 20) // int(w))):
                    to = slice(part, part + max(1, (8 << 20) // int(w)))
                    px, py = own_x[to], own_y[to]
                    hit = may_link(n[px], folded[place[: len(own_x)][to]], n[py], folded[place[len(own_x) :][to]], percent)
                    px, py = px[hit], py[hit]
                    told = np.zeros(len(px), bool)
                    for turn in range(EARLY):
                        own = early[px, turn]
                        told |= (own < key[px]) & (own[:, None] == early[py]).any(axis=1)
                    if not told.all():
                        a, b = no[px[~told]], no[py[~told]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the last tile, of which more may come: two parts, about twice TILE at most
        for batch in batches:
            numbers = [batch.column(c).to_numpy() for c in (0, 1, 2, 3, 5, 6)]
            lists = batch.column(7)
            at = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            early = np.full((len(lists), EARLY), 1 << 40)  # more than any shingle
            early[at, np.arange(len(at)) - np.searchsorted(at, at)] = lists.flatten().to_numpy()
            numbers.append(early)
            bits = np.array(batch.column(4).to_pylist() + [None], object)[:-1]
            if rest is not None:
                numbers, bits = [np.concatenate(c) for c in zip(rest[0], numbers, strict=True)], np.concatenate([rest[1], bits])
            new = np.zeros(len(bits), bool)
            new[1:] = numbers[0][1:] != numbers[0][:-1]
            last = int(np.flatnonzero(new)[-1]) if new.any() else 0
            no, n, root, side, key, early = numbers[1:]
            if last:
                yield from linked(key[:last], no[:last], n[:last], root[:last], side[:last], np.cumsum(new[:last]), bits[:last], early[:last])
            rest = [c[last:] for c in numbers], bits[last:]
        if rest is not None and len(rest[1]):
            no, n, root, side, key, early = rest[0][1:]
            yield from linked(key, no, n, root, side, np.zeros(len(no), np.int64), rest[1], early)

    met = met.select(F.hash("key").alias("key"), "band", "no", "root")
    by_root = met.groupBy("key", "root").agg(F.count(F.lit(1)).alias("times"))
    major = by_root.groupBy("key").agg(F.max(F.struct("times", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("key", F.col("m.root").alias("major"))
    mixed = met.join(major, "key").withColumn("apart", F.col("root") != F.col("major"))
    parts = lambda n: F.ceil(n / F.lit(TILE)).cast("int")
    ends = lambda c: (F.min(c), F.max(c))
    low, high = ends("root")
    apart_low, apart_high = ends(F.when(F.col("apart"), F.col("root")))
    bands = mixed.groupBy("key", "band").agg(
        F.struct(parts(F.count(F.lit(1))).alias("parts"), low.alias("low"), high.alias("high")).alias("all"), F.struct(parts(F.count_if("apart")).alias("parts"), apart_low.alias("low"), apart_high.alias("high")).alias("apart")
    )
    layout = bands.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("all", F.col("apart").alias("some"))))).alias("layout"))  # bands are few
    placed = held(mixed.select("key", "band", "no", "root", "apart").join(layout, "key"), "tile-rows")
    near = F.sequence(F.col("band") - 1, F.col("band") + 1)
    # parts of a band that hold a root besides the row's own
    count = lambda b, side: F.coalesce(F.when((F.col("layout")[b][side]["low"] != F.col("root")) | (F.col("layout")[b][side]["high"] != F.col("root")), F.col("layout")[b][side]["parts"]), F.lit(0))
    numbers = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    own = lambda side: F.pmod(F.xxhash64("no"), F.greatest(F.col("layout")[F.col("band")][side]["parts"], F.lit(1))).cast("int")
    left = placed.filter("apart").select(
        "key", F.col("band").alias("i"), own("some").alias("p"), F.explode(F.flatten(F.transform(near, lambda b: F.transform(numbers(count(b, "all")), lambda q: F.struct(b.alias("j"), q.alias("q")))))).alias("t"), "no", "root", F.lit(0).alias("side")
    )
    right = placed.select(
        "key", F.col("band").alias("j"), own("all").alias("q"), F.explode(F.flatten(F.transform(near, lambda b: F.transform(numbers(count(b, "some")), lambda p: F.struct(b.alias("i"), p.alias("p")))))).alias("t"), "no", "root", F.when(F.col("apart"), 2).otherwise(1).alias("side")
    )
    # a tile goes by the hash of its place; should two tiles have one, they are compared together, and no pair is lost
    tile = F.xxhash64("key", "i", "p", "j", "q").alias("tile")
    dealt = left.select("key", "i", "p", "t.j", "t.q", "no", "root", "side").unionByName(right.select("key", "t.i", "t.p", "j", "q", "no", "root", "side")).select(tile, "no", "root", "side", "key")
    early = placed.groupBy("no").agg(F.slice(F.sort_array(F.collect_set("key")), 1, EARLY).alias("early"))
    tiles = dealt.join(distinct.select("no", "n", "bits").join(early, "no"), "no").select("tile", "no", "n", "root", "bits", "side", "key", "early")
    return tiles.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(compare, "a long, b long")


def linked_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id that its links reach), where two documents are linked
    if 100 * intersection >= percent * union."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.filter("doc_id is not null")
    marked = held(marks(docs, id_col, text_col, width, percent, standing_out(docs, text_col, width)), "shingle-marks")
    # equal sets are one; empty ones are linked with nothing
    own = marked.filter("n > 0 and doc_id is not null")
    full = held(own.groupBy("sid").agg(F.min("doc_id").alias("no"), *[F.first(c).alias(c) for c in ("n", "band", "prefix", "bits")]), "shingle-sets")
    keys = full.select("no", "band", F.explode("prefix").alias("key"))
    shared = held(keys.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key"), "shared-shingles")
    met = held(in_bitmap(keys, "key", bitmap(shared)).filter("maybe").select("no", "band", "key").join(shared, "key"), "met-shingles")
    weights = met.groupBy("no").agg(F.count(F.lit(1)).alias("weight"))
    distinct = held(full.select("no", "n", "bits").join(weights, "no"), "shingle-bitmaps")
    links = cut(_exact(_bounded(_star_pairs(met.join(distinct.select("no", "weight"), "no")), distinct, percent), known, width, percent))
    roots = components(links).withColumnRenamed("node", "no")
    now = met.join(roots, "no", "left").withColumn("root", F.coalesce("root", "no"))
    links = links.union(_exact(_tile_pairs(now, distinct, percent).distinct(), known, width, percent))
    # texts that share an id are one document
    named = own.select("doc_id", "sid").join(full.select("sid", "no"), "sid").select("doc_id", "no")
    several = named.groupBy("doc_id").agg(F.min("no").alias("least"), F.max("no").alias("most")).filter("least < most").select("doc_id", "least")
    groups = components(links.union(named.join(several, "doc_id").select(F.col("no").alias("a"), F.col("least").alias("b"))))
    classes = full.select("sid", "no").join(groups, F.col("no") == F.col("node"), "left").select("sid", F.coalesce("root", "no").alias("component_id"))
    placed = marked.select("doc_id", "sid", "n").join(classes, "sid", "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
