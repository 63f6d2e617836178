"""Substring dedup with repeated-phrase automata.

A window is WINDOW consecutive words of one document. A word goes if a window over it also starts in a document with a
smaller id. Windows are judged on the input, never on what is left.

1. Filter. Every window has an anchor, the least hash among its ANCHOR-word runs; equal windows have equal anchors, and
   neighbouring windows mostly share one. Only anchors that occur in two documents can belong to a recurring window.
   Anchors that recur inside a batch are settled there; of those only one goes on, so that a passage that a third of
   all documents share costs one row a batch.
2. Confirm. The stretches of text under such anchors are dealt out by anchor; those under an anchor of more than HOT documents
   are cut into single windows, which are dealt to a part for each HOT documents by all their words, as each document may give
   another stretch there. A shard compares words, not hashes. Its passages are the stretches that two documents have, and
   the windows that different stretches share, each with its smallest id; they are compiled into an Aho-Corasick automaton
   over word numbers.
3. Locate. All stretches of a shard, which hold every occurrence of its passages in all documents, are streamed through its
   automaton, and what it finds of a smaller id is covered. A document isn't sent to shards that have no passage for it.
   Copies of a stretch inside a batch are folded into the first before the shuffle, so a shard never meets a hot passage
   document by document. A task works on one shard at a time.
4. Remove. Covered stretches are joined to the whole texts.

Defined results: null text counts as empty and has no words. A null id is compared with none: such rows keep all their
words and remove none. Rows that share an id don't remove each other's words; each keeps its own text. An empty table
gives an empty result. Columns other than id and text are never read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadastra.llm.common import bitmap, cut, in_bitmap
from kadastra.shipping import ship

WINDOW = 13
ANCHOR = 6
#: Characters of text whose words are held at a time.
CHUNK_CHARS = 2_000_000
#: Documents from which an anchor is hot: its windows are dealt out one by one.
HOT = 2048
#: Anchors of documents that a task gathers before it sends them on.
HELD = 1_000_000

_MIX = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i in range(ANCHOR)], dtype=np.uint64)
_BASE = 0x100000001B3
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


class Windows:
    """All windows of some texts, found at once: the bounds of each word, the text of each window and its anchor."""

    def __init__(self, raws: list[bytes], window: int):
        joined = b" ".join(raws) + b" "
        letters = np.frombuffer(joined, np.uint8)
        space = _SPACE[letters]
        before = np.concatenate([[True], space[:-1]])
        self.raw = joined
        self.begin, self.end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        offsets = np.cumsum([0, *(len(r) + 1 for r in raws)])[:-1]
        text = np.searchsorted(offsets, self.begin, side="right") - 1
        self.first_word = np.searchsorted(self.begin, offsets)
        n = len(self.begin) - window + 1
        if n <= 0:
            self.at = self.text = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.int64)
            return
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * _powers(_BASE, len(letters)))])
        word = (sums[self.end] - sums[self.begin]) * _powers(pow(_BASE, -1, 2**64), len(letters))[self.begin]
        word ^= word >> np.uint64(31)
        runs = len(word) - ANCHOR + 1
        mixed = np.zeros(runs, np.uint64)
        for j in range(ANCHOR):
            mixed += word[j : j + runs] * _MIX[j]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        span, least, width = window - ANCHOR + 1, mixed, 1
        while width < span:  # the least of a sliding stretch, by doubling
            step = min(width, span - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        inside = np.flatnonzero(text[:n] == text[window - 1 :])
        self.at, self.text, self.anchor = inside, text[inside], least[inside].view(np.int64)

    def stretches(self, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First window of each run of windows of one text under one anchor, and the run's end; under a hot anchor each window is alone."""
        n = len(self.at)
        new = np.ones(n, bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.text[1:] != self.text[:-1])
        if hot is not None and len(hot):
            new |= np.isin(self.anchor, hot)
        first = np.flatnonzero(new)
        return first, np.append(first[1:], n)


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[range]:
    """Runs of rows whose texts have about CHUNK_CHARS bytes together."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column)], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK_CHARS, prepend=0))
    edges = [0, *(c for c in cuts.tolist() if c), batch.num_rows]
    return (range(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def _recurring_anchors(rows: DataFrame, window: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, anchors): per document, the anchors that at least two documents have. Also the hot anchors, at most one for each
    HOT anchors of documents, with the parts that each is dealt to."""
    once, often, settled = 0, 1, 2
    shards = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found, owner = [], []
            for chunk in _chunks(batch, 1):
                seen = Windows([_bytes(batch.column(1)[i].as_py()) for i in chunk], window)
                first, _ = seen.stretches()
                found.append(seen.anchor[first])
                owner.append(ids[chunk.start + seen.text[first]])
            anchor, doc = np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate([np.zeros(0, np.int64), *owner]).astype(np.int64)
            if not len(anchor):
                continue
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            anchor, doc = anchor[new], doc[new]
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            size = np.diff(np.append(first, len(anchor)))
            many = np.repeat(size > 1, size)
            # anchors in one document of the batch ask; those in several are settled, and one tells the other batches
            for kind, a, d in ((once, anchor[~many], doc[~many]), (often, anchor[first[size > 1]], size[size > 1]), (settled, anchor[many], doc[many])):
                shard = (a if kind != settled else d) % shards
                order = np.argsort(shard, kind="stable")
                shard, a, d = shard[order], a[order], d[order]
                cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(a) else np.zeros(0, int)
                ends = np.append(cuts[1:], len(a))[: len(cuts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(cuts), kind, np.int32)),
                        pa.array(shard[cuts].astype(np.int32)),
                        pa.array([a[b:e].tobytes() for b, e in zip(cuts, ends, strict=True)], pa.binary()),
                        pa.array([d[b:e].astype(np.int64).tobytes() for b, e in zip(cuts, ends, strict=True)], pa.binary()),
                    ],
                    names=["kind", "shard", "anchors", "docs"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, anchors, hot, held = [], [], [], 0

        def send():
            doc, anchor = np.concatenate(docs), np.concatenate(anchors)
            home = doc % parts
            order = np.argsort(home, kind="stable")
            home, doc, anchor = home[order], doc[order], anchor[order]
            cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, int)
            ends = np.append(cuts[1:], len(home))[: len(cuts)]
            return packed(home[cuts].tolist(), [(doc[b:e], anchor[b:e]) for b, e in zip(cuts, ends, strict=True)])

        def packed(homes, pairs):
            columns = [pa.array(homes, pa.int32()), *(pa.array([x[i].astype(np.int64).tobytes() for x in pairs], pa.binary()) for i in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, names=["home", "docs", "anchors"])

        for rows in by_shard(batches, 1):
            none = [np.zeros(0, np.int64)]
            told = {k: [np.frombuffer(r[2], np.int64) for r in rows if r[0] == k] + none for k in (once, often, settled)}
            also = {k: [np.frombuffer(r[3], np.int64) for r in rows if r[0] == k] + none for k in (once, often, settled)}
            anchor, doc, other = np.concatenate(told[once]), np.concatenate(also[once]), np.concatenate(told[often])
            each, which = np.unique(np.concatenate([anchor, other]), return_inverse=True)
            times = np.bincount(which, weights=np.concatenate([np.ones(len(anchor)), *also[often]]), minlength=len(each)).astype(np.int64)
            hot.append((each[times > HOT], times[times > HOT]))
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, int)
            size = np.diff(np.append(first, len(anchor)))
            shared = (doc[first] != doc[first + size - 1]) | np.isin(anchor[first], other) if len(anchor) else np.zeros(0, bool)
            shared = np.repeat(shared, size)
            docs += [doc[shared], *also[settled]]
            anchors += [anchor[shared], *told[settled]]
            held += int(shared.sum()) + sum(map(len, told[settled]))
            if held > HELD:
                yield send()
                docs, anchors, held = [], [], 0
        if held:
            yield send()
        if any(len(a) for a, _ in hot):
            yield packed([-1], [(np.concatenate([n for _, n in hot]), np.concatenate([a for a, _ in hot]))])

    def by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_shard(batches, 0):
            doc, anchor = (np.concatenate([np.frombuffer(r[i], np.int64) for r in rows]) for i in (1, 2))
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            for a in range(0, len(first), 1000):
                own = np.append(first[a : a + 1000], first[a + 1000] if a + 1000 < len(first) else len(doc))
                lists = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(anchor[own[0] : own[-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(doc[own[:-1]]), lists], names=["doc_id", "anchors"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.filter("doc_id is not null").mapInArrow(gather, "kind int, shard int, anchors binary, docs binary")
    told = cut(met.repartition("shard").sortWithinPartitions("shard").mapInArrow(answer, "home int, docs binary, anchors binary"))
    # at most one anchor for each HOT anchors of documents
    hot = {a: -(-n // HOT) for r in told.filter("home < 0").collect() for n, a in zip(np.frombuffer(r["docs"], np.int64).tolist(), np.frombuffer(r["anchors"], np.int64).tolist(), strict=True)}
    recurring = told.filter("home >= 0").repartition("home").sortWithinPartitions("home").mapInArrow(by_doc, "doc_id long, anchors array<long>")
    return recurring, hot


def by_shard(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[list]]:
    """The rows of each shard; batches come sorted by that column."""
    rows: list[list] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and rows[-1][column] != row[column]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _stretches(marked: DataFrame, hot: dict[int, int], window: int) -> DataFrame:
    """Text under recurring anchors (kind 0), and what is known to be covered inside a batch (kind 1)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in _chunks(batch, 1):
                raws = [_bytes(batch.column(1)[i].as_py()) for i in chunk]
                seen = Windows(raws, window)
                first, end = seen.stretches(spread)
                if not len(first):
                    continue
                lists = batch.column(2)[chunk.start : chunk.stop]
                asked = np.repeat(np.arange(len(raws)), pa.compute.list_value_length(lists).to_numpy())
                wanted = np.unique(np.stack([asked, lists.flatten().to_numpy()], axis=1).astype(np.int64), axis=0)
                have = np.stack([seen.text[first], seen.anchor[first]], axis=1).astype(np.int64)
                pair = np.dtype([("t", np.int64), ("a", np.int64)])
                keep = np.isin(np.ascontiguousarray(have).view(pair).ravel(), np.ascontiguousarray(wanted).view(pair).ravel())
                where: dict[tuple[int, bytes], list[tuple[int, int, int]]] = defaultdict(list)
                text_ids: dict[int, int] = {}
                last = seen.at[end[keep] - 1] + window - 1
                for text, anchor, word, begin, stop in zip(
                    seen.text[first[keep]].tolist(), seen.anchor[first[keep]].tolist(), seen.at[first[keep]].tolist(), seen.begin[seen.at[first[keep]]].tolist(), seen.end[last].tolist(), strict=True
                ):
                    if text not in text_ids:
                        text_ids[text] = xxhash.xxh64_intdigest(raws[text]) - 2**63
                    words = b" ".join(seen.raw[begin:stop].split())
                    where[anchor, words].append((ids[chunk.start + text], text_ids[text], word - int(seen.first_word[text])))
                shards_: dict[tuple[int, int], list[tuple[int, int, int, bytes]]] = defaultdict(list)
                for (anchor, words), places in where.items():
                    home = (anchor + (xxhash.xxh64_intdigest(words) % hot[anchor] if anchor in hot else 0)) % shards
                    low = min(p[0] for p in places)
                    for doc_id, text_id, at in places:
                        if doc_id > low:
                            shards_[1, doc_id % shards].append((doc_id, text_id, at, b"%d" % (words.count(b" ") + 1)))
                        else:
                            shards_[0, home].append((doc_id, text_id, at, words))
                keys, packed = list(shards_), [_pack(v) for v in shards_.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int32()), pa.array(packed, pa.binary())], names=["kind", "shard", "rows"]
                )

    spread = np.array(sorted(hot), np.int64)
    shards = 4 * int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return marked.mapInArrow(gather, "kind int, shard int, rows binary")


def _pack(rows: list[tuple[int, int, int, bytes]]) -> bytes:
    """Rows (document, text, place, words) that go to one shard, compressed together."""
    numbers = np.array([r[:3] for r in rows], np.int64)
    return zlib.compress(len(rows).to_bytes(4, "little") + numbers.tobytes() + b"\n".join(r[3] for r in rows), 1)


def _unpack(packed: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    raw = zlib.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    for numbers, words in zip(np.frombuffer(raw, np.int64, 3 * n, 4).reshape(n, 3).tolist(), raw[4 + 24 * n :].split(b"\n"), strict=True):
        yield *numbers, words


def _covered(stretches: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_id, at, n): words at .. at + n - 1 are covered by a window of a smaller id."""

    def shard(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
        import ahocorasick

        numbers: dict[bytes, int] = defaultdict(lambda: len(numbers) + 1)
        where: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        for doc_id, text_id, at, words in rows:
            where[words].append((doc_id, text_id, at))
        streams, owner, passages = [], {}, {}
        for words, places in where.items():
            low = min(p[0] for p in places)
            stream = np.fromiter(map(numbers.__getitem__, words.split(b" ")), np.int32)
            streams.append((stream, low, places))
            raw = stream.tobytes()
            if any(p[0] > low for p in places):
                passages[raw] = low
            for b in range(0, len(raw) - 4 * window + 4, 4):
                key = raw[b : b + 4 * window]
                before = owner.get(key)
                if before is None:
                    owner[key] = low
                elif before != low:
                    owner[key] = passages[key] = min(low, before, passages.get(key, low))
        if not passages:
            return
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, least in passages.items():
            automaton.add_word(tuple(np.frombuffer(key, np.int32).tolist()), (len(key) // 4, least))
        automaton.make_automaton()
        for stream, low, places in streams:
            found = [(end + 1 - n, end + 1, least) for end, (n, least) in automaton.iter(tuple(stream.tolist()))]
            if not found:
                continue
            for copies in (False, True):  # the smallest id's place, and all others, which see the stretch itself as a passage
                own = [p for p in places if (p[0] > low) == copies]
                spans = _joined([(b, e) for b, e, least in found if least < low or (copies and least == low)]) if own else ()
                for doc_id, text_id, at in own:
                    for b, e in spans:
                        yield doc_id, text_id, at + b, e - b

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_shard(batches, 1):
            out = [(d, t, at, int(n)) for kind, _, packed in rows if kind for d, t, at, n in _unpack(packed)]
            out.extend(shard([r for kind, _, packed in rows if not kind for r in _unpack(packed)]))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["doc_id", "text_id", "at", "n"])

    return stretches.repartition("shard").sortWithinPartitions("shard").mapInArrow(locate, "doc_id long, text_id long, at int, n int")


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((b, e))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (text of the words left, joined by spaces)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    recurring, hot = _recurring_anchors(rows, window)
    marked = rows.join(recurring, "doc_id").select("doc_id", "text", "anchors")
    covered = cut(_covered(_stretches(marked, hot, window), window).groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("at", "n")).alias("spans")))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch, 1):
                counts, removed, kept = [], [], []
                for i in chunk:
                    raw = _bytes(batch.column(1)[i].as_py())
                    words = raw.split()
                    spans = batch.column(2)[i].as_py()
                    own = xxhash.xxh64_intdigest(raw) - 2**63 if spans else 0
                    gone = np.zeros(len(words) + 1, np.int32)
                    for same in spans or ():
                        if same["text_id"] == own:
                            for s in same["spans"]:
                                gone[s["at"]] += 1
                                gone[s["at"] + s["n"]] -= 1
                    left = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g] if spans else words
                    counts.append(len(words))
                    removed.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[chunk.start : chunk.stop], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    by_doc = covered.groupBy("doc_id").agg(F.collect_list(F.struct("text_id", "spans")).alias("texts"))
    told = in_bitmap(rows.withColumn("h", F.xxhash64("doc_id")), "h", bitmap(covered.select(F.xxhash64("doc_id").alias("h"))))
    # documents that surely lose no word need no shuffle
    joined = told.filter("maybe").join(by_doc, "doc_id", "left").select("doc_id", "text", "texts")
    alone = told.filter("not maybe").select("doc_id", "text", F.lit(None).cast(joined.schema["texts"].dataType).alias("texts"))
    return joined.union(alone).mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
o AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS low FROM p),
g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM o WHERE low < doc_id),
w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (
  SELECT w.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY w.i) AS kept
  FROM w ANTI JOIN g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
