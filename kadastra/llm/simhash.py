"""SimHash fingerprints and their links, with pivot distance tables.

Fingerprints are computed in one pass over the texts. Copies share a fingerprint, so links are sought between distinct
fingerprints. Two fingerprints that differ in at most `bits` bits agree in at least blocks - bits of `blocks` equal
stretches; every choice of so many stretches is a bucket key. Only keys that two fingerprints share go on.

The pivot table is computed once for each distinct fingerprint, and travels with it: its Hamming distances to PIVOTS
reference fingerprints. As distances obey the triangle inequality, a pair whose coordinates differ by more than `bits`
anywhere can't be a link. In a bucket, candidates are the members in an interval of the first coordinate; pairs that
any other coordinate parts are discarded, and the survivors' Hamming distances are verified. A bucket yields a
spanning forest of its links, never all its pairs. A bucket of more than BUCKET members is keyed again with finer stretches,
down to keys that leave at most 2^12 different fingerprints, so that no bucket is unbounded and no link is lost.

Defined results: null text counts as empty; texts without words have fingerprint 0 and are linked like any other; a null
id takes part in its fingerprint's group and ranks after every other id. Repeated rows are returned as often as they
occur. An empty table gives an empty result. Columns other than id and text are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadastra.llm.common import bitmap, cut, freed, held, in_bitmap
from kadastra.llm.components import components
from kadastra.shipping import ship

#: Reference fingerprints of the pivot table.
PIVOTS = 24
#: Members of a bucket up to which it is searched in one task.
BUCKET = 2048
#: Stretches of the successive keyings; the last leaves 12 bits open for 3 differing bits.
BLOCKS = (6, 8, 16)

_POWERS = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, A-Z lower-cased; of all words, if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), 42)], dtype=np.uint64)
    runs = zip(*(words[i:] for i in range(width)), strict=False)
    return np.fromiter((digest(x, 42) for x in map(b" ".join, runs)), dtype=np.uint64, count=len(words) - width + 1)


def fingerprint(text: str | None, width: int) -> int:
    """The bits that are set in over half of the shingle hashes."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((_POWERS * (counts * 2 > len(hashes))).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freed(run), "doc_id long, fp long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances to the reference fingerprints, one column each."""
    words = fps.shape[1]
    pivots = np.array([[xxhash.xxh64_intdigest(f"{i}/{w}".encode(), 7) for w in range(words)] for i in range(PIVOTS)], dtype=np.uint64)
    return np.stack([np.bitwise_count(fps ^ p).sum(axis=1) for p in pivots], axis=1).astype(np.int16)


def forest(fps: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (left, right) of links that connect what is within `bits` bits of each other, one for each member but the
    first of its group. fps has one row of 64-bit words for each member. What is linked isn't compared again."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    first, open_, left, right = table[:, 0], np.ones(len(fps), bool), [], []
    for start in range(len(fps)):
        if not open_[start]:
            continue
        open_[start], waiting = False, [start]
        while waiting:
            i = waiting.pop()
            low, high = np.searchsorted(first, first[i] - bits), np.searchsorted(first, first[i] + bits, side="right")
            js = low + np.flatnonzero(open_[low:high])
            for at in range(1, PIVOTS, 8):
                if not len(js):
                    break
                js = js[(np.abs(table[js, at : at + 8] - table[i, at : at + 8]) <= bits).all(axis=1)]
            js = js[np.bitwise_count(fps[js] ^ fps[i]).sum(axis=1) <= bits]
            if len(js):
                left.append(np.full(len(js), i))
                right.append(js)
                waiting += js.tolist()
                open_[js] = False
    none = np.zeros(0, np.int64)
    return order[np.concatenate([none, *left])], order[np.concatenate([none, *right])]


def tabled(distinct: DataFrame) -> DataFrame:
    """(fp, table): each fingerprint's row of the pivot table, a byte for each reference fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pivot_table(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)[:, None]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["fp", "table"])

    return distinct.mapInArrow(freed(run), "fp long, table binary")


def _keys(blocks: int, bits: int):
    """A function from fingerprints to their bucket keys: one row for each choice of blocks - bits stretches."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [sum(1 << i for i in range(edges[b], edges[b + 1])) for b in range(blocks)]
    choices = [np.uint64(sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - bits)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for number, mask in enumerate(choices):
                    key = pa.array((fps & mask).view(np.int64))
                    yield pa.RecordBatch.from_arrays([*part.columns, key, pa.array(np.full(len(fps), number, np.int32))], names=["fp", "table", "key", "choice"])

    return keyed


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): links between fingerprints, enough of them to connect all that is connected."""

    def in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (fp, key, choice, table) come sorted by bucket."""
        kept, now = [], None

        def close():
            fps = np.array([fp for fp, _ in kept], dtype=np.int64)
            table = np.frombuffer(b"".join(t for _, t in kept), np.uint8).reshape(len(kept), PIVOTS).astype(np.int16)
            a, b = forest(fps.view(np.uint64)[:, None], table, bits)
            return fps[a], fps[b]

        def send(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            found = []
            fps, keys, choices, tables = (c.to_pylist() for c in batch.columns)
            for fp, key, t in zip(fps, zip(keys, choices, strict=True), tables, strict=True):
                if key != now:
                    if len(kept) > 1:
                        found.append(close())
                    kept, now = [], key
                kept.append((fp, t))
            if found:
                yield send(found)
        if len(kept) > 1:
            yield send([close()])

    ship(distinct.sparkSession)
    found, todo = None, cut(tabled(distinct))
    for level, blocks in enumerate(BLOCKS):
        keyed = todo.mapInArrow(_keys(blocks, bits), "fp long, table binary, key long, choice int")
        sizes = keyed.groupBy("key", "choice").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = cut(keyed.join(sizes, ["key", "choice"]))
        last = level == len(BLOCKS) - 1
        small = shared if last else shared.filter(F.col("n") <= BUCKET)
        part = small.select("fp", "key", "choice", "table").repartition("key", "choice").sortWithinPartitions("choice", "key").mapInArrow(freed(in_bucket), "a long, b long")
        found = part if found is None else found.union(part)
        if last:
            break
        todo = shared.filter(F.col("n") > BUCKET).select("fp", "table").distinct()
        if todo.isEmpty():
            break
    return found


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id (smallest id that its links reach)."""
    marked = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = components(links(distinct.select("fp"), bits))
    named = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(lowest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near duplicates of a given similarity

#: 64-bit words of the long fingerprints.
LONG = 4
#: Bands of least shingle hashes, and the hashes of each. Two sets of Jaccard similarity 0.8 share none of the bands with a
#: chance of (1 - 0.8^BAND)^BANDS = 0.000005, however many documents there are.
BANDS, BAND = 40, 6
#: Standard deviations that the fingerprints' filter allows above the mean distance of a pair of the similarity asked for.
DEVIATIONS = 4.5
#: Sets of up to so many shingles pass the fingerprints' filter, as majorities of so few hashes say too little.
FEW = 8


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Each distinct shingle hash once, in order."""
    return np.unique(shingle_hashes(text, width))


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """Of (doc_id, text): (doc_id, sid, n, fp, table, keys): hash and size of the set of distinct shingles, its fingerprint of LONG words,
    from as many mixes of each shingle hash, its row of the pivot table, and the keys of its bands."""
    mixes = np.array([xxhash.xxh64_intdigest(str(w).encode(), 3) | 1 for w in range(LONG)], dtype=np.uint64)
    orders = np.array([xxhash.xxh64_intdigest(str(i).encode(), 5) | 1 for i in range(BANDS * BAND)], dtype=np.uint64)

    def majority(hashes: np.ndarray) -> bytes:
        counts = np.zeros(64 * LONG, np.int64)
        for at in range(0, len(hashes), 16384):
            mixed = hashes[at : at + 16384, None] * mixes[None, :]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()

    def bands(hashes: np.ndarray) -> list[int]:
        if not len(hashes):
            return []
        least = np.full(len(orders), 2**64 - 1, np.uint64)
        for at in range(0, len(hashes), 512):
            np.minimum(least, (hashes[at : at + 512, None] * orders[None, :]).min(axis=0), out=least)
        raw = least.tobytes()
        return [xxhash.xxh64_intdigest(raw[8 * BAND * b : 8 * BAND * (b + 1)], b) - 2**63 for b in range(BANDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sizes, fps, keys = [], [], [], []
            for text in batch.column(1):
                hashes = shingle_set(text.as_py(), width)
                sids.append(xxhash.xxh64_intdigest(hashes.tobytes(), 9) - 2**63)
                sizes.append(len(hashes))
                fps.append(majority(hashes))
                keys.append(bands(hashes))
            tables = [row.tobytes() for row in pivot_table(_words(fps))] if fps else []
            columns = [batch.column(0), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary()), pa.array(tables, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sid", "n", "fp", "table", "keys"])

    ship(rows.sparkSession)
    return rows.mapInArrow(freed(run), "doc_id long, sid long, n int, fp binary, table binary, keys array<long>")


def _may_be(sizes: np.ndarray, fps: np.ndarray, table: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Places of the pairs (x, y) that sizes, pivot distances and fingerprints don't exclude from being of the similarity.

    Sets of Jaccard similarity s have vectors of cosine about 2s / (1 + s), and so differ in an arccos(cosine) / pi share of
    their fingerprints' bits."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = int(64 * LONG * share + DEVIATIONS * math.sqrt(64 * LONG * share * (1 - share)))
    low, high = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
    at = np.flatnonzero(low >= similarity * high - 1e-9)
    few = high[at] <= FEW
    small, at = at[few], at[~few]
    for first in range(0, PIVOTS, 8):
        at = at[(np.abs(table[x[at], first : first + 8] - table[y[at], first : first + 8]) <= bits).all(axis=1)]
    at = at[np.bitwise_count(fps[x[at]] ^ fps[y[at]]).sum(axis=1) <= bits]
    return np.concatenate([small, at])


def _words(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), LONG)


def _tables(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.int16).reshape(len(rows), PIVOTS)


def _filtered(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that may be of the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes = np.concatenate([batch.column(2).to_numpy(), batch.column(5).to_numpy()])
            fps, tables = (f(batch.column(c).to_pylist() + batch.column(c + 3).to_pylist()) for f, c in ((_words, 3), (_tables, 4)))
            at = pa.array(_may_be(sizes, fps, tables, np.arange(n), np.arange(n, 2 * n), similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    left = distinct.select(F.col("no").alias("a"), F.col("n").alias("n_a"), F.col("fp").alias("fp_a"), F.col("table").alias("table_a"))
    right = distinct.select(F.col("no").alias("b"), F.col("n").alias("n_b"), F.col("fp").alias("fp_b"), F.col("table").alias("table_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "fp_a", "table_a", "n_b", "fp_b", "table_b").mapInArrow(freed(run), "a long, b long").distinct()


def _across(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of one bucket's members of different roots that may be of the similarity, without those of its first member.

    The bucket's largest root is its home; pairs inside it need no comparing, so that only members apart from it meet the rest.
    They are dealt to chunks and all members to parts, each of about BUCKET; a task compares one chunk with one part, so that no
    pair is left out and the work grows with the members apart.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, now = [], None

        def close():
            no, size, root, first, home, side = (np.array(c, np.int64) for c in zip(*[(k[0], k[1], k[4], k[5], k[6], k[7]) for k in kept], strict=True))
            fps, table = _words([k[2] for k in kept]), _tables([k[3] for k in kept])
            apart, others = np.flatnonzero((side == 0) & (no != first)), np.flatnonzero((side == 1) & (no != first))
            left, right, held = [], [], 0
            for x in apart:
                y = others[(root[others] != root[x]) & ((root[others] == home[others]) | (no[others] > no[x]))]
                y = y[_may_be(size, fps, table, np.full(len(y), x), y, similarity)]
                left.append(np.minimum(no[x], no[y]))
                right.append(np.maximum(no[x], no[y]))
                held += len(y)
                if held > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])
                    left, right, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

        for batch in batches:
            for *row, key, i, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != now:
                    if len(kept) > 1:
                        yield from close()
                    kept, now = [], (key, i, j)
                kept.append(row)
        if len(kept) > 1:
            yield from close()

    roots = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    spread = roots.groupBy("key").agg(
        F.max_by("root", F.struct("m", "root")).alias("home"), F.ceil((F.sum("m") - F.max("m")) / F.lit(BUCKET)).cast("int").alias("chunks"), F.ceil(F.sum("m") / F.lit(BUCKET)).cast("int").alias("parts")
    )
    placed = members.join(spread.filter("chunks > 0"), "key")
    part, chunk = (F.pmod(F.xxhash64("no"), F.col(c)).cast("int") for c in ("parts", "chunks"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["no", "n", "fp", "table", "root", "first", "home", "side", "key", "i", "j"]
    apart = placed.filter("root != home").withColumn("side", F.lit(0)).withColumn("j", chunk).withColumn("i", each("parts")).select(columns)
    whole = placed.withColumn("side", F.lit(1)).withColumn("i", part).withColumn("j", each("chunks")).select(columns)
    return apart.union(whole).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(freed(compare), "a long, b long").distinct()


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """(no, hashes): the distinct shingles of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1)[at : at + 256]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 256], pa.array([shingle_set(t.as_py(), width).view(np.int64) for t in texts], pa.list_(pa.int64()))], names=["no", "hashes"])

    return rows.mapInArrow(freed(run), "no long, hashes array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have at least the Jaccard similarity."""
    left, right = sets.select(F.col("no").alias("a"), F.col("hashes").alias("s")), sets.select(F.col("no").alias("b"), F.col("hashes").alias("t"))
    common = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("s", "t")).alias("common"), (F.size("s") + F.size("t")).alias("sizes"))
    return common.filter(F.col("common") >= similarity * (F.col("sizes") - F.col("common")) - 1e-9).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of documents that a chain of near duplicates joins to a smaller id.

    Two documents are near duplicates if their sets of distinct shingles have at least the Jaccard similarity: fingerprints only
    discard pairs, and those that are left have their sets compared. Candidates share a band. First each member is compared with the
    smallest of its buckets' firsts; then, in buckets that still hold several groups, each member with the bucket's first; then
    the members that are still apart with the others. What is joined already needs no more comparing, so that copies in large numbers
    cost one comparison each. Texts without words are near duplicates of one another. Rows with a null id take no part; rows that
    share an id are one document.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = held(sketches(rows, width), "sketches")
    distinct = held(marked.groupBy("sid").agg(F.min(F.struct("doc_id", "n", "fp", "table", "keys")).alias("d")).select("sid", F.col("d.doc_id").alias("no"), "d.n", "d.fp", "d.table", "d.keys"), "distinct")
    named = marked.select("doc_id", "sid").join(distinct.select("sid", "no"), "sid").select("doc_id", "no")
    keys = distinct.select("no", F.explode("keys").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("no").alias("first")).filter("times > 1")
    shared = held(keys.join(sizes.drop("times"), "key"), "shared")
    sets = held(shingle_sets(rows.join(shared.select(F.col("no").alias("doc_id")).distinct(), "doc_id", "left_semi"), width), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        return _linked(_filtered(pairs, distinct, similarity), sets, similarity)

    def mixed(links: DataFrame) -> DataFrame:
        """Members of the buckets that hold several roots, with their root and the first's."""
        placed = shared.join(components(links).withColumnRenamed("node", "no"), "no", "left").withColumn("root", F.coalesce("root", "no"))
        several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("root", "no").alias("lead")).filter("low < high")
        return placed.join(several.select("key", "lead"), "key")

    stars = shared.filter("no != first").select(F.col("first").alias("a"), F.col("no").alias("b"))
    joined = held(verified(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), "joined")
    rest = mixed(joined).filter("root != lead").select(F.col("first").alias("a"), F.col("no").alias("b")).distinct()
    joined = joined.union(held(verified(rest), "joined"))
    members = held(mixed(joined).join(distinct.select("no", "n", "fp", "table"), "no"), "members")
    groups = components(joined.union(verified(_across(members, similarity))).union(named))
    return groups.filter("node != root").select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with all its columns, without the documents that have a near duplicate of smaller id."""
    gone = cut(near_duplicates(docs, id_col, text_col, width, similarity).select(F.col("doc_id").alias("_gone")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    told = in_bitmap(packed.withColumn("_h", F.xxhash64(F.col(f"_row.`{id_col}`").cast("long"))), "_h", bitmap(gone.select(F.xxhash64("_gone").alias("h"))))
    kept = told.filter("maybe").join(gone, F.col(f"_row.`{id_col}`") == F.col("_gone"), "left_anti")
    return kept.select("_row").union(told.filter("not maybe").select("_row")).select("_row.*")
