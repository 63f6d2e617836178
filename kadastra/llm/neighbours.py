"""Approximate nearest neighbours by inner product, with NN-descent and greedy graph search.

Equal vectors are one node, so a vector that a third of all rows share is one node too. Nodes travel as codes: the vector
less the mean of all, in 8-bit steps of its largest component, with that step and its product with the mean in double
precision. a.b is then (code of a).(code of b) + mean.b, but for a constant of a, whatever the size of the components.

1. A first graph joins nodes that random hyperplane trees put into one leaf; leaves are stretches of LEAF nodes of a
   sorted order, so none is larger.
2. NN-descent. Each round joins neighbours of neighbours: a node's list holds at most SAMPLE fresh and SAMPLE older of its
   neighbours, and as many of the nodes that have it as a neighbour. All on one list are introduced to one another, if one of the two is
   fresh, and a node keeps the best NEIGHBOURS that it was ever introduced to. Lists are bounded, so a round costs the same
   for each node. It ends when a round changes under STILL of the links; there is no bound on the rounds.
3. Search. Queries walk the graph greedily from their own node: all nodes among a query's best BEAM that were not expanded yet have their
   neighbours scored, until none is left; there is no bound on the steps.
4. The BEAM's rows are scored again from the original vectors in double precision. A node stands for its rows with the
   smallest ids, as many as can be asked for. Ties go to the smaller id.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part. A vector that is
shorter than the longest is read as if zeros followed. Rows with a null id take no part; rows that agree in id and vector
are one row; rows that share only the id are each a candidate and a query. A row is never its own candidate; equal vectors of
other rows are. With fewer candidates than asked for, all are returned. An empty table gives an empty result. Products must lie within
the range of a double. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.llm.common import cut
from kadastra.shipping import ship

NEIGHBOURS = 48
#: Fresh neighbours of a node that a round takes up, and older ones; and as many in the other direction.
SAMPLE = 24
TREES = 4
#: Most nodes of a leaf.
LEAF = 256
#: Share of changed links under which NN-descent ends.
STILL = 0.01
#: Nodes that a search keeps.
BEAM = 64
SEED = 11

_LINK = "node long, other long, score double"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors that take part, as arrays of doubles of one length."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.filter(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    longest = rows.agg(F.max(F.size("v")).alias("n")).collect()[0]["n"] or 0
    return rows.select("vec_id", F.concat("v", F.expr(f"array_repeat(double(0), {longest} - size(v))")).alias("v")).distinct()


def _nodes(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, v), and their rows (node, vec_id), the `most` smallest ids of each."""
    keyed = rows.withColumn("h", F.xxhash64("v"))
    first = cut(keyed.select("h", "v").distinct().withColumn("node", F.monotonically_increasing_id()))
    # the smallest ids of a node, gathered without bringing a large node together: by salt, and then once more
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    rank = F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("vec_id"))
    few = salted.withColumn("r", rank).filter(F.col("r") <= most).drop("r")
    again = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    few = few.withColumn("r", again).filter(F.col("r") <= most)
    return first, cut(few.join(first, ["h", "v"]).select("node", "vec_id"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _bytes(column: pa.Array) -> np.ndarray:
    """Codes of equal length as a matrix of small whole numbers."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.int8)
    return raw.reshape(len(column), -1).astype(np.float32) if len(column) else np.zeros((0, 1), np.float32)


def _links(node: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(other.astype(np.int64)), pa.array(score.astype(np.float64))], names=["node", "other", "score"])


def codes(nodes: DataFrame) -> DataFrame:
    """(node, code, step, shift) of (node, v)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            x = _matrix(batch.column(0))
            total, n = total + x.sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total / n], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["mean", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            centred = x - mean
            step = np.abs(centred).max(axis=1) / 127
            whole = np.rint(centred / np.where(step > 0, step, 1)[:, None]).astype(np.int8)
            code = pa.array([row.tobytes() for row in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), code, pa.array(step), pa.array(x @ mean)], names=["node", "code", "step", "shift"])

    parts = nodes.select("v").mapInArrow(sums, "mean array<double>, n long").collect()  # one row for each partition
    weight = sum(p["n"] for p in parts)
    mean = np.sum([np.array(p["mean"]) * (p["n"] / weight) for p in parts], axis=0) if parts else np.zeros(1)
    return nodes.select("node", "v").mapInArrow(encode, "node long, code binary, step double, shift double")


def _best(node: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best others of each node, each once."""
    order = np.lexsort((other, -score, node))
    node, other, score = node[order], other[order], score[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])  # the same pair has the same score
    node, other, score = node[new], other[new], score[new]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    keep = rank < k
    return node[keep], other[keep], score[keep]


def _keep_best(links: DataFrame, k: int, key: str = "node") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "other")
    return links.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def _leaves(k: int):
    """The k best of each node among the stretch of LEAF rows that it lies in. Rows (tree, node, code, step, shift) come sorted; a
    last stretch under half a leaf is joined to the one before."""

    def meet(rows: pa.Table) -> pa.RecordBatch:
        node = rows.column(1).to_numpy()
        x, step, shift = _bytes(rows.column(2).combine_chunks()), rows.column(3).to_numpy(), rows.column(4).to_numpy()
        score = (x @ x.T).astype(np.float64) * step[:, None] * step[None, :] + shift[None, :]
        np.fill_diagonal(score, -np.inf)
        m = min(k, len(node) - 1)
        near = np.argpartition(-score, m - 1, axis=1)[:, :m]
        return _links(np.repeat(node, m), node[near.ravel()], np.take_along_axis(score, near, axis=1).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            tree = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if held is not None and held.num_rows and held.column(0)[0].as_py() != tree[a]:
                    if held.num_rows > 1:
                        yield meet(held)
                    held = None
                held = part if held is None else pa.concat_tables([held, part])
                while held.num_rows >= LEAF + LEAF // 2:
                    yield meet(held.slice(0, LEAF))
                    held = held.slice(LEAF)
        if held is not None and held.num_rows > 1:
            yield meet(held)

    return run


def first_graph(coded: DataFrame, count: int, k: int) -> DataFrame:
    """(node, other, score): each node's best among its leaves in random hyperplane trees."""
    depth = min(60, max(0, int(np.ceil(np.log2(max(1, count) / LEAF)))))
    planes: dict[int, np.ndarray] = {}

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _bytes(batch.column(1))
            if x.shape[1] not in planes:
                planes[x.shape[1]] = np.random.default_rng(SEED).standard_normal((TREES, depth + 1, x.shape[1])).astype(np.float32)
            for tree in range(TREES):
                z = x @ planes[x.shape[1]][tree].T
                place = np.zeros(len(x), np.int64)
                for level in range(depth):
                    # boundaries of one Gray code, so that neighbours in the order are neighbours in space
                    place = place * 2 + ((z[:, level] > 0) ^ (place & 1).astype(bool))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), tree, np.int32)), pa.array(place), pa.array(z[:, -1]), *batch.columns], names=["tree", "place", "z", "node", "code", "step", "shift"]
                )

    placed = coded.select("node", "code", "step", "shift").mapInArrow(sides, "tree int, place long, z float, node long, code binary, step double, shift double")
    parts = max(1, min(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")), TREES * count // (4 * LEAF)))
    order = ["tree", "place", "z", "node"]
    met = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("tree", "node", "code", "step", "shift").mapInArrow(_leaves(k), _LINK)
    return _keep_best(met.groupBy("node", "other").agg(F.max("score").alias("score")), k)


def _introduce(k: int):
    """All members of a list are introduced to one another. Rows (pivot, member, fresh, code, step, shift, bound) come sorted by pivot;
    a list has at most 4 SAMPLE rows. A link goes on if it is better than the member's worst."""

    def meet(batch: pa.RecordBatch):
        pivot, member = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fresh = batch.column(2).to_numpy(zero_copy_only=False)
        x = _bytes(batch.column(3))
        step, shift, bound = (batch.column(c).to_numpy() for c in (4, 5, 6))
        first = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]]))
        size = np.diff(np.append(first, len(pivot)))
        out = []
        at = 0
        while at < len(first):
            widest, end = 0, at
            while end < len(first) and (end == at or (end - at + 1) * max(widest, int(size[end])) ** 2 <= 1_000_000):
                widest = max(widest, int(size[end]))
                end += 1
            there = np.arange(widest)[None, :] < size[at:end, None]
            place = np.where(there, first[at:end, None] + np.arange(widest)[None, :], 0)
            v, who, new = x[place], member[place], fresh[place] & there
            score = np.matmul(v, v.transpose(0, 2, 1)).astype(np.float64)
            own = step[place]
            score *= own[:, :, None]
            score *= own[:, None, :]
            score += shift[place][:, None, :]
            good = (score > bound[place][:, :, None]) & (new[:, :, None] | new[:, None, :])
            good &= there[:, :, None] & there[:, None, :] & (who[:, :, None] != who[:, None, :])
            i, a, b = np.nonzero(good)
            out.append((who[i, a], who[i, b], score[i, a, b]))
            at = end
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, waiting, held = None, [], 0
        for batch in batches:
            if tail is not None and tail.num_rows:
                batch = pa.concat_batches([tail, batch])
            pivot = batch.column(0).to_numpy()
            whole = int(np.searchsorted(pivot, pivot[-1])) if len(pivot) else 0  # the last list may go on in the next batch
            tail = batch.slice(whole)
            if whole:
                waiting.append(meet(batch.slice(0, whole)))
                held += len(waiting[-1][0])
                if held > 500_000:
                    yield _links(*_best(*(np.concatenate(c) for c in zip(*waiting, strict=True)), k))
                    waiting, held = [], 0
        if tail is not None and tail.num_rows:
            waiting.append(meet(tail))
        if waiting:
            yield _links(*_best(*(np.concatenate(c) for c in zip(*waiting, strict=True)), k))

    return run


def _taken_up(links: DataFrame, round_: int) -> DataFrame:
    """Adds `taken`: whether the next round takes the link up, at most SAMPLE fresh and SAMPLE older ones of a node."""
    order = Window.partitionBy("node", "fresh").orderBy(F.xxhash64("node", "other", F.lit(round_)))
    return links.withColumn("taken", F.row_number().over(order) <= SAMPLE)


def _descend(graph: DataFrame, coded: DataFrame, k: int, round_: int) -> DataFrame:
    """One round on (node, other, score, fresh, taken). New links come out fresh."""
    taken = graph.filter("taken").select("node", "other", "fresh")
    turned = taken.select(F.col("other").alias("pivot"), F.col("node").alias("member"), "fresh")
    order = Window.partitionBy("pivot", "fresh").orderBy(F.xxhash64("pivot", "member", F.lit(round_)))
    turned = turned.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE).drop("rank")
    lists = taken.select(F.col("node").alias("pivot"), F.col("other").alias("member"), "fresh").union(turned)
    worst = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bound"))
    told = coded.join(worst, "node", "left").select(F.col("node").alias("member"), "code", "step", "shift", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    met = lists.join(told, "member").select("pivot", "member", "fresh", "code", "step", "shift", "bound").repartition("pivot").sortWithinPartitions("pivot")
    found = met.mapInArrow(_introduce(k), _LINK).withColumn("fresh", F.lit(True))
    known = graph.select("node", "other", "score", (F.col("fresh") & ~F.col("taken")).alias("fresh"))
    known = known.withColumn("new", F.lit(0)).unionByName(found.withColumn("new", F.lit(1)))
    once = known.groupBy("node", "other").agg(F.max("score").alias("score"), F.min(F.struct("new", "fresh")).alias("is"))
    best = _keep_best(once.select("node", "other", "score", F.col("is.fresh").alias("fresh"), (F.col("is.new") == 1).alias("new")), k)
    return _taken_up(best, round_ + 1)


def build_graph(nodes: DataFrame, k: int = NEIGHBOURS, coded: DataFrame | None = None) -> DataFrame:
    """(node, other, score): each node's k best neighbours found."""
    ship(nodes.sparkSession)
    coded = cut(codes(nodes)) if coded is None else coded
    count = coded.count()
    start = first_graph(coded, count, k).withColumn("fresh", F.lit(True)).withColumn("new", F.lit(True))
    graph, round_ = cut(_taken_up(start, 0)), 0
    while True:
        graph = cut(_descend(graph.drop("new"), coded, k, round_))
        round_ += 1
        if graph.filter("new").count() <= STILL * k * count:
            return graph.select("node", "other", "score")


def search(queries: DataFrame, graph: DataFrame, coded: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, other, score): the best `beam` nodes that greedy walks from the nodes of `queries` (query) meet, the own one
    included. Scores leave out a constant of each query."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step, shift, own = (batch.column(c).to_numpy() for c in (3, 4, 6))
            dot = np.einsum("ij,ij->i", _bytes(batch.column(2)), _bytes(batch.column(5)))
            score = dot.astype(np.float64) * step * own + shift
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query", "other", "score"])

    turned = _keep_best(graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "score"), NEIGHBOURS)
    steps = cut(graph.select("node", "other").union(turned.select("node", "other")).distinct())
    there = coded.select(F.col("node").alias("other"), "code", "step", "shift")
    asked = queries.join(coded, F.col("query") == F.col("node")).select("query", F.col("code").alias("q"), F.col("step").alias("q_step"))
    found = cut(queries.select("query", F.col("query").alias("other"), F.lit(float("inf")).alias("score"), F.lit(False).alias("done")))  # a query's own row stays in its beam
    while True:
        going = found.filter("not done").select("query", F.col("other").alias("node"))
        fresh = going.join(steps, "node").select("query", "other").distinct().join(found.select("query", "other"), ["query", "other"], "left_anti")
        rows = fresh.join(there, "other").join(asked, "query").select("query", "other", "code", "step", "shift", "q", "q_step")
        new = rows.mapInArrow(scored, "query long, other long, score double").withColumn("done", F.lit(False))
        found = cut(_keep_best(found.withColumn("done", F.lit(True)).union(new), beam, "query"))
        if found.filter("not done").isEmpty():
            return found.select("query", "other", "score")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each query row: query_id, rank (from 1), vec_id, score. is_query is a condition on vec_id."""
    ship(rows.sparkSession)
    fine = cut(usable(rows, id_col, vector_col))
    nodes, members = _nodes(fine, k + 1)
    coded = cut(codes(nodes))
    graph = build_graph(nodes, coded=coded)
    asked = cut(fine.filter(is_query).withColumn("h", F.xxhash64("v")).join(nodes, ["h", "v"]).select("node", "vec_id"))
    # equal queries walk once
    found = search(asked.select(F.col("node").alias("query")).distinct(), graph, coded, max(BEAM, k + 1))
    vectors = nodes.select("node", "v")
    pairs = found.select("query", F.col("other").alias("node")).join(vectors, "node").select("query", "node", "v")
    exact = pairs.join(vectors.select(F.col("node").alias("query"), F.col("v").alias("q")), "query").select("query", "node", _dot("q", "v").alias("score"))
    by_row = exact.join(members, "node").select("query", "node", "vec_id", "score")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    few = by_row.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("query", "node", "vec_id", "score")
    names = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    rank = F.row_number().over(Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id"))
    others = names.join(few, "query").filter((F.col("query_id") != F.col("vec_id")) | (F.col("query") != F.col("node")))
    return others.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
