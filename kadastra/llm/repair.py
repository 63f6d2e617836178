"""Repair of a conversation's structure by the cheapest edits, with Four-Russians block tables.

A conversation is well formed if its role initials are nothing, or an optional s and then pairs of u and a. Rows may be kept
(0), given the role user or assistant (1), or deleted (2); blank rows and duplicates must be deleted; a truncated row that
stays costs 5 more; a row without text may be inserted anywhere (5). Of equally cheap edits the ASCII-least run of initials
(D, I, K, R) is taken. It fixes all else, since what R and I make follows from the state: nothing yet, s, u or a.

What each state still has to pay is a vector of four costs, and less its minimum it is one of a few dozen. For every such vector
and every block of BLOCK rows' symbols a table holds the vector before the block and the difference of the minima, so that a
conversation is read from its end block by block by lookup. Blocks are then expanded from their end on, which gives the costs
at each row inside, and edits are chosen forward from them: each is the least that loses nothing, so that ties fall right.

Rows are dealt out in the order of conversation and turn. A conversation inside one partition is repaired there. One that spans
partitions, however large, is cut where they are: each piece says for every vector at its end which one is at its start, and
where each state leads; pieces (at most two for each partition) are chained, and each is then traced where it lies. Only the
hash and the audit of a conversation, each one value, are put together in a task, piece after piece.

Defined results: a conversation is the rows of one conv_id, null being an id like any other. Null turns come first, rows of one turn
are ordered by role and the hash of the text. Null roles and texts are one space. Roles count by their first letter, and an
empty role or any other letter fits nowhere. Repeated rows are duplicates. An empty table gives an empty result. Columns
other than conv_id, turn, role and text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra.llm.common import SPACES, cut
from kadastra.shipping import ship

#: Rows of a block.
BLOCK = 3
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. What the next u or a makes of each.
_NEXT = (2, 2, 3, 2)
#: Symbols: twice the number of the initial in "sua" (3 for any other), and one more if truncated; MUST_GO for blank rows and duplicates.
MUST_GO, SYMBOLS = 8, 9
#: Bytes of repaired text that a piece hands on at a time.
CHUNK = 1 << 20
_LEGAL = {"su", "ua", "au"}


def _keeps(state: int, initial: int) -> int | None:
    """The state after a row of this initial is kept."""
    if initial == 0:
        return 1 if state == 0 else None
    return _NEXT[state] if initial in (1, 2) and _NEXT[state] == initial + 1 else None


def _edits(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """(initial of the edit, cost, state after it) for a row."""
    found = [("D", DELETE, state)]
    if symbol != MUST_GO:
        initial, cut_off = divmod(symbol, 2)
        kept = _keeps(state, initial)
        if kept is not None:
            found.append(("K", KEEP + TRUNCATED * cut_off, kept))
        found.append(("R", REROLE + TRUNCATED * cut_off, _NEXT[state]))
    return found


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Costs once rows may be inserted first."""
    for _ in range(4):
        costs = [min(c, INSERT + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


@cache
def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """What each state has to pay from a row on, given what it has to pay after the row."""
    return _inserted([min(cost + after[to] for _, cost, to in _edits(s, symbol)) for s in range(4)])


#: What each state has to pay behind the last row: only nothing and after a are ends.
END = _inserted([0, 1 << 20, 1 << 20, 0])


class Tables:
    """vectors: the normalised cost vectors; step and gain: the vector before a symbol, and the difference of minima; block_step and
    block_gain: the same for blocks; trace and leads: edits and state after a block, by block, vector at its end and state before it."""

    def __init__(self) -> None:
        self.vectors, number = [END], {END: 0}
        step, gain = [], []
        for vector in self.vectors:  # grows
            row = [_before(s, vector) for s in range(SYMBOLS)]
            gain.append([min(v) for v in row])
            normal = [tuple(c - min(v) for c in v) for v in row]
            for v in normal:
                if v not in number:
                    number[v] = len(self.vectors)
                    self.vectors.append(v)
            step.append([number[v] for v in normal])
        self.step, self.gain = np.array(step), np.array(gain)
        self.block_step, self.block_gain = np.arange(len(self.vectors))[:, None], np.zeros((len(self.vectors), 1), np.int64)
        for _ in range(BLOCK):  # a block's code has its first symbol in front; the block grows in front
            before, gained = self.step[self.block_step], self.gain[self.block_step]  # vector, code, symbol
            self.block_gain = (self.block_gain[:, :, None] + gained).transpose(0, 2, 1).reshape(len(self.vectors), -1)
            self.block_step = before.transpose(0, 2, 1).reshape(len(self.vectors), -1)
        codes = SYMBOLS**BLOCK
        self.trace = [[[None] * 4 for _ in self.vectors] for _ in range(codes)]
        self.leads = np.zeros((codes, len(self.vectors), 4), np.int8)
        for code in range(codes):
            symbols = [code // SYMBOLS ** (BLOCK - 1 - i) % SYMBOLS for i in range(BLOCK)]
            for v in range(len(self.vectors)):
                for state in range(4):
                    self.trace[code][v][state], self.leads[code, v, state] = self.expand(symbols, v, state)

    def expand(self, symbols: list[int], end: int, state: int) -> tuple[str, int]:
        """The edits of rows of these symbols, from a state to the vector at their end, and the state after them."""
        costs = [self.vectors[end]]
        for symbol in reversed(symbols):
            costs.append(_before(symbol, costs[-1]))
        costs.reverse()
        made = []
        for i, symbol in enumerate(symbols):
            while True:
                ways = [(e, to, i + 1) for e, cost, to in _edits(state, symbol) if cost + costs[i + 1][to] == costs[i][state]]
                if INSERT + costs[i][_NEXT[state]] == costs[i][state]:
                    ways.append(("I", _NEXT[state], i))
                edit, state, at = min(ways)
                made.append(edit)
                if at > i:
                    break
        return "".join(made), state

    def ending(self, state: int) -> str:
        """Inserted rows behind the last one."""
        made = ""
        while state not in (0, 3):
            made, state = made + "I", _NEXT[state]
        return made

    def blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of the rows before the first block, codes of the blocks)."""
        head = len(symbols) % BLOCK
        return symbols[:head], symbols[head:].reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def repair(self, symbols: np.ndarray, end: int = 0, state: int = 0) -> tuple[list[str], int, int]:
        """(edits of each row with the inserts before it, cost less that at the end, state after the last row)."""
        head, codes = self.blocks(symbols)
        v, cost, ends = end, 0, []
        for code in codes[::-1].tolist():
            ends.append(v)
            cost, v = cost + int(self.block_gain[v, code]), int(self.block_step[v, code])
        made, state = self.expand(head.tolist(), v, state)
        edits = [made]
        for symbol in head[::-1].tolist():
            cost, v = cost + int(self.gain[v, symbol]), int(self.step[v, symbol])
        for code, at in zip(codes.tolist(), reversed(ends), strict=True):
            edits.append(self.trace[code][at][state])
            state = int(self.leads[code, at, state])
        return edits, cost + int(self.vectors[v][0]), state

    def piece(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector at the piece's end: the vector at its start, and the states after it by the state before it."""
        head, codes = self.blocks(symbols)
        v = np.arange(len(self.vectors))
        ends = np.zeros((len(codes), len(v)), np.int16)
        for i in range(len(codes) - 1, -1, -1):
            ends[i] = v
            v = self.block_step[v, codes[i]]
        leads = np.array([[self.expand(head.tolist(), int(x), s)[1] for s in range(4)] for x in v])
        for code, at in zip(codes, ends, strict=True):
            leads = self.leads[code, at[:, None], leads]
        for symbol in head[::-1].tolist():
            v = self.step[v, symbol]
        return v, leads


@cache
def tables() -> Tables:
    return Tables()


def _text_or(column: Column, otherwise: str) -> Column:
    return F.coalesce(column.cast("string"), F.lit(otherwise))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with damage that follows from crc32(conv_id:turn): one in twenty dropped, emptied, without its [.!?], repeated, or given
    the role user."""
    kind = F.crc32(F.concat(_text_or(F.col("conv_id"), " "), F.lit(":"), _text_or(F.col("turn"), " ")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    known = rows.select("conv_id", "turn", _text_or(F.col("role"), " ").alias("role"), _text_or(F.col("text"), " ").alias("text"), kind.alias("kind")).filter("kind <> 0")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return known.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows in order, held: part, key (the conversation), turn, role, text, blank, truncated."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    order = ["key", "turn", "role", "_hash", "_lot"]
    known = rows.select(
        F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("c"), _text_or(F.col("conv_id"), "")).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        _text_or(F.col("role"), " ").alias("role"),
        _text_or(F.col("text"), " ").alias("text"),
    ).withColumns({"blank": F.coalesce(bare == "", F.lit(False)), "truncated": ~F.right(bare, F.lit(1)).isin(".", "!", "?"), "_hash": F.xxhash64("text"), "_lot": F.monotonically_increasing_id()})
    # equal rows may be told apart by their lot alone: they may change places
    return cut(known.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "key", "turn", "role", "text", "blank", "truncated"))


def _symbol(role: str, truncated: bool) -> int:
    return 2 * ("sua".find(role[:1]) if role[:1] and role[0] in "sua" else 3) + truncated


class _Rows:
    """What is known of a run of rows of one conversation."""

    def __init__(self, key: str):
        self.key, self.turns, self.roles, self.texts, self.symbols = key, [], [], [], []
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, truncated: bool, duplicate: bool) -> None:
        gone = blank or duplicate
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated and not gone
        self.symbols.append(MUST_GO if gone else _symbol(role, truncated))
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)

    def illegal(self) -> int:
        return sum(a[:1] + b[:1] not in _LEGAL for a, b in zip(self.roles, self.roles[1:], strict=False))

    def known_turns(self) -> list[int]:
        return sorted({t for t in self.turns if t is not None})

    def repaired(self, edits: str, state: int) -> Iterator[str]:
        """The rows of the result, role:text."""
        at = 0
        for edit in edits:
            if edit == "K":
                state = _keeps(state, "sua".index(self.roles[at][0]))
                yield f"{self.roles[at]}:{self.texts[at]}"
            elif edit != "D":
                state = _NEXT[state]
                yield f"{'user' if state == 2 else 'assistant'}:{self.texts[at] if edit == 'R' else ''}"
            at += edit != "I"


_RESULT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=names)


_RESULT_TYPES = pa.schema([("key", pa.string())] + [(n, pa.int64()) for n in _NAMES[1:7]] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[tuple]]]:
    """Rows (part, key, turn, role, text, blank, truncated, ...) by (key, part), a run at a time."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda r: (r[1], r[0]))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of conversations that lie in this partition in whole."""
    table, out = tables(), []
    for (key, _), rows in _runs(batches):
        run, seen = _Rows(key), set()
        for _, _, turn, role, text, blank, truncated in rows:
            run.add(turn, role, text, blank, truncated, (role, text) in seen)
            seen.add((role, text))
        edits, cost, state = table.repair(np.array(run.symbols, np.int64))
        audit = "".join(edits) + table.ending(state)
        turns = run.known_turns()
        gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(run.repaired(audit, 0)).encode("utf-8", "surrogatepass")).hexdigest()
        out.append((key, gaps, run.blank, run.duplicate, run.truncated, run.illegal(), cost, audit, digest))
        if len(out) == 1024:
            yield _batch(out, _NAMES, _RESULT_TYPES)
            out = []
    if out:
        yield _batch(out, _NAMES, _RESULT_TYPES)


_PIECE = "key string, part int, starts array<int>, leads array<int>, rows long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"
_PIECE_NAMES = ["key", "part", "starts", "leads", "rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last"]
_PIECE_TYPES = pa.schema(
    [("key", pa.string()), ("part", pa.int32()), ("starts", pa.list_(pa.int32())), ("leads", pa.list_(pa.int32()))] + [(n, pa.int64()) for n in _PIECE_NAMES[4:12]] + [("first", pa.string()), ("last", pa.string())]
)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each piece of a cut conversation does to vectors and states; rows also say whether they are duplicates."""
    table = tables()
    for (key, part), rows in _runs(batches):
        run = _Rows(key)
        for _, _, turn, role, _, blank, truncated, duplicate in rows:
            run.add(turn, role, "", blank, truncated, duplicate)
        starts, leads = table.piece(np.array(run.symbols, np.int64))
        turns = run.known_turns()
        ends = (turns[0], turns[-1]) if turns else (None, None)
        row = (key, part, starts.tolist(), leads.reshape(-1).tolist(), len(run.symbols), run.blank, run.duplicate, run.truncated, run.illegal(), len(turns), *ends, run.roles[0][:1], run.roles[-1][:1])
        yield _batch([row], _PIECE_NAMES, _PIECE_TYPES)


_CHAIN_NAMES = ["key", "part", "end", "state", "last"]
_CHAIN_TYPES = pa.schema([("key", pa.string()), ("part", pa.int32()), ("end", pa.int32()), ("state", pa.int32()), ("last", pa.bool_())])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces in order: the vector at each one's end, and the state before it. A piece is a row, at most one for each partition."""
    from itertools import groupby

    rows = (row for batch in batches for row in batch.to_pylist())
    for key, own in groupby(rows, key=lambda r: r["key"]):
        own = list(own)
        v, ends = 0, []
        for piece in reversed(own):
            ends.append(v)
            v = piece["starts"][v]
        state, out = 0, []
        for i, (piece, end) in enumerate(zip(own, reversed(ends), strict=True)):
            out.append((key, piece["part"], end, state, i == len(own) - 1))
            state = piece["leads"][4 * end + state]
        yield _batch(out, _CHAIN_NAMES, _CHAIN_TYPES)


_TRACE_NAMES = ["key", "part", "chunk", "audit", "rows", "cost"]
_TRACE_TYPES = pa.schema([("key", pa.string()), ("part", pa.int32()), ("chunk", pa.int32()), ("audit", pa.string()), ("rows", pa.binary()), ("cost", pa.int64())])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the repaired rows of each piece, in chunks; rows also say duplicate, end, state and last."""
    table = tables()
    for (key, part), rows in _runs(batches):
        run = _Rows(key)
        for _, _, turn, role, text, blank, truncated, duplicate, end, state, last in rows:
            run.add(turn, role, text, blank, truncated, duplicate)
        edits, _, after = table.repair(np.array(run.symbols, np.int64), end, state)
        audit = "".join(edits) + (table.ending(after) if last else "")
        dear = np.array(run.symbols)[[e != "D" for e in audit if e != "I"]] % 2 if run.symbols else np.zeros(0)
        cost = DELETE * audit.count("D") + REROLE * audit.count("R") + INSERT * audit.count("I") + TRUNCATED * int(dear.sum())
        chunk, held, size = 0, [], 0
        for line in run.repaired(audit, state):
            held.append(line)
            size += len(line)
            if size > CHUNK:
                yield _batch([(key, part, chunk, "", "\n".join(held).encode("utf-8", "surrogatepass"), 0)], _TRACE_NAMES, _TRACE_TYPES)
                chunk, held, size = chunk + 1, [], 0
        yield _batch([(key, part, chunk, audit, "\n".join(held).encode("utf-8", "surrogatepass") if held else None, cost)], _TRACE_NAMES, _TRACE_TYPES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, audit, cost, repaired_sha256) of chunks in order."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, own in groupby(rows, key=lambda r: r[0]):
        digest, begun, audits, total = hashlib.sha256(), False, [], 0
        for _, _, _, audit, lines, cost in own:
            audits.append(audit)
            total += cost
            if lines is not None:
                digest.update(b"\n" + lines if begun else lines)
                begun = True
        names = ["key", "audit", "cost", "repaired_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array(["".join(audits)]), pa.array([total], pa.int64()), pa.array([digest.hexdigest()])], names=names)


def _cut_conversations(rows: DataFrame) -> DataFrame:
    """The results of conversations that span partitions; rows keep their partitions."""
    placed = cut(rows.withColumn("_at", F.monotonically_increasing_id()))  # grows with the partitions and inside them
    first = placed.groupBy("key", "role", F.sha2("text", 256).alias("_digest")).agg(F.min("_at").alias("_first"))
    # rows that aren't the first of their kind; AQE splits the kinds that are frequent
    again = placed.select("key", "role", F.sha2("text", 256).alias("_digest"), "_at").join(first, ["key", "role", "_digest"]).select("_at", (F.col("_at") > F.col("_first")).alias("duplicate"))
    # dealt out anew in the same order, so that a partition holds one run of a conversation
    told = cut(placed.drop("part").join(again, "_at").repartitionByRange("_at").sortWithinPartitions("_at").withColumn("part", F.spark_partition_id()))
    columns = ["part", "key", "turn", "role", "text", "blank", "truncated", "duplicate"]
    pieces = cut(told.select(*columns).withColumn("text", F.lit("")).mapInArrow(_pieces, _PIECE))
    chain = cut(pieces.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_chained, "key string, part int, end int, state int, last boolean"))
    traced = told.join(F.broadcast(chain), ["key", "part"]).select(*columns, "end", "state", "last").mapInArrow(_traced, "key string, part int, chunk int, audit string, rows binary, cost long")
    hashed = traced.repartition("key").sortWithinPartitions("key", "part", "chunk").mapInArrow(_hashed, "key string, audit string, cost long, repaired_sha256 string")
    seams = F.sort_array(F.collect_list(F.struct("part", "low", "high", "first", "last", "turns")))  # one for each piece
    sums = pieces.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")], F.min("low").alias("low"), F.max("high").alias("high"), seams.alias("seams"))
    pair = lambda f: F.coalesce(F.expr(f"aggregate(filter(sequence(1, size(seams)), i -> i > 1), 0L, (n, i) -> n + if({f}, 1L, 0L))"), F.lit(0))
    torn = pair("seams[i - 2].last || seams[i - 1].first not in ('su', 'ua', 'au')")
    # the highest known turn before a piece is its predecessor's, as turns grow and nulls come first
    same = pair("seams[i - 2].high is not null and seams[i - 2].high = seams[i - 1].low")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - same), F.lit(0))
    return sums.select("key", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + torn).cast("long").alias("illegal")).join(hashed, "key").select(*_NAMES)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation with rows: key, the counts of its faults, cost, audit, repaired_sha256."""
    ship(rows.sparkSession)
    dealt = _dealt(rows)
    spread = dealt.groupBy("key").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).filter("_low < _high").select("key")
    spread = cut(spread)  # at most one for each border between partitions, which bounds its size
    whole = dealt.join(F.broadcast(spread), "key", "left_anti").select("part", "key", "turn", "role", "text", "blank", "truncated").mapInArrow(_whole, _RESULT)
    torn = dealt.join(F.broadcast(spread), "key", "left_semi").select("part", "key", "turn", "role", "text", "blank", "truncated")
    return whole if spread.isEmpty() else whole.unionByName(_cut_conversations(torn))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conv_id with what its damaged rows need; conversations that lost all rows have zeros and the hash of nothing."""
    key = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("c"), _text_or(F.col("conv_id"), ""))
    every = conversations.select("conv_id", key.alias("key")).distinct()
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in _NAMES[1:7]}
    nothing = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}
    return every.join(repair(damaged(conversations)), "key", "left").withColumns(zero | nothing).select("conv_id", *_NAMES[1:])
