"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice holds every way to cut it into pieces; a segmentation's probability is the product of its pieces'
unigram probabilities, over the sum of all. The k segmentations of the greatest perturbed log-probabilities (log-probability
plus Gumbel noise) are k draws without replacement. They are found by A* search from the root, whose perturbed value bounds
all below it: the best path under a node has the node's own value, and all that is left aside along it is one open set, whose
greatest value is drawn under that bound from the set's summed probability. The next draw is the open set of the greatest
value: the place where it leaves its path and the edge there are as probable as what lies behind them, and what remains of
the set gets a new value under the old. So only the paths that are emitted are ever walked. The greatest value that remains
is the threshold: a draw's inclusion score is the log of its chance to exceed it, 1 - exp(-exp(log_prob - threshold)).

All random numbers are counter-based, from the row's key (seed and id, or the text's hash without an id), the draw and the
place, so a row's draws don't depend on partitions, batches or order.

Lattices of a batch's distinct pre-tokens are built together in arrays, and all texts of a batch walk theirs in step.

Defined results: null and empty texts have one segmentation, without pieces and sure to be drawn. A text with fewer than k
segmentations gives all of them. Rows with equal ids and texts get equal draws. An empty table gives an empty result. Other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadastra.llm.common import freed, give_back
from kadastra.llm.pieces import SPACE, Pieces, all_pre_tokens, letter_bytes, load
from kadastra.llm.words import chunks
from kadastra.shipping import ship

DRAWS = 2
SEED = 20
#: Bytes of text that are walked together; a longer text is walked alone.
CHUNK_BYTES = 500_000
#: Nodes of lattices that a worker keeps.
KEPT_NODES = 2_000_000
_HASH = np.uint64(0x9E3779B97F4A7C15)


class PieceTable:
    """Beginnings of pieces by length, findable by the hashes of many substrings at once: (hashes, id or -1, score)."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, pieces.longest + 1):
            own = sorted({p[:n] for p in pieces.ids if len(p) >= n})
            letters = np.frombuffer("".join(own).encode("utf-32-le"), "<u4").reshape(-1, n)
            hashes = np.zeros(len(own), np.uint64)
            for j in range(n):
                hashes = hashes * _HASH + letters[:, j] + np.uint64(1)
            order = np.argsort(hashes)
            self.by_length.append((hashes[order], np.array([pieces.ids.get(p, -1) for p in own])[order], np.array([pieces.scores.get(p, 0.0) for p in own])[order]))


class Lattice:
    """The lattices of distinct words, one node for each place in each word."""

    def __init__(self, words: list[str], table: PieceTable):
        pieces = table.pieces
        sizes = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(letters)
        ends = np.repeat(np.cumsum(sizes), sizes)
        here = np.arange(n)
        self.start = np.cumsum(sizes) - sizes
        begin, width, ids, score = [], [], [], []
        hashes, single = np.zeros(n, np.uint64), np.zeros(n, bool)
        live = here
        for size, (known, known_ids, known_scores) in enumerate(table.by_length, 1):
            live = live[live + size <= ends[live]]
            if not len(live):
                break
            own = hashes[live] * _HASH + letters[live + size - 1] + np.uint64(1)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[at] == own  # what begins no piece can't grow into one
            live, at = live[hit], at[hit]
            hashes[live] = own[hit]
            whole = known_ids[at] >= 0
            if size == 1:
                single[live[whole]] = True
            begin.append(live[whole])
            width.append(np.full(whole.sum(), size))
            ids.append(known_ids[at[whole]])
            score.append(known_scores[at[whole]])
        odd = np.flatnonzero(~single)  # letters that fall back to bytes: the id is minus the code point, less one
        points = letters[odd].astype(np.int64)
        n_bytes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        # the longest edges of a node come first, as they mostly are the likeliest
        begin, width = np.concatenate([*begin[::-1], odd]), np.concatenate([*width[::-1], np.ones(len(odd), np.int64)])
        ids, score = np.concatenate([*ids[::-1], -points - 1]).astype(np.int64), np.concatenate([*score[::-1], n_bytes * pieces.byte_score])
        # an edge leads to a node of the same word or, from its end, nowhere
        left = ends[begin] - begin
        order = np.argsort(begin, kind="stable")  # of runs that are sorted already
        begin, width, ids, score, left = begin[order], width[order], ids[order], score[order], left[order]
        self.edge = ids
        follow = begin + width
        final = width == left
        self.next = np.where(final, -1, follow)
        self.first = np.searchsorted(begin, np.arange(n + 1))
        degree = np.diff(self.first)
        # log of the summed probability of all ways from a node to its word's end, the nodes nearest the end first
        beta = np.zeros(n + 1)
        by_left = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 65536 else left, kind="stable")
        level_cuts = np.append(np.flatnonzero(np.concatenate([[True], np.diff(left[by_left]) != 0])), len(by_left)) if len(by_left) else np.zeros(1, int)
        for a, b in zip(level_cuts[:-1].tolist(), level_cuts[1:].tolist(), strict=True):
            e = by_left[a:b]
            value = score[e] + np.where(final[e], 0.0, beta[np.where(final[e], 0, follow[e])])
            node = begin[e]
            cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            top = np.maximum.reduceat(value, cut)
            size = np.diff(np.append(cut, len(e)))
            beta[node[cut]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, size)), cut))
        self.log_p = score + np.where(final, 0.0, beta[np.where(final, 0, follow)]) - beta[begin]
        p = np.exp(self.log_p)
        rank = np.arange(len(begin)) - self.first[begin]
        # mass of a node's earlier and later edges, summed directly: one minus p would lose what is small
        before, after = np.zeros_like(p), np.zeros_like(p)
        for e in _levels(rank)[1:]:
            before[e] = before[e - 1] + p[e - 1]
        for e in _levels(degree[begin] - 1 - rank)[1:]:
            after[e] = after[e + 1] + p[e + 1]
        with np.errstate(divide="ignore"):
            self.log_others = np.log(before + after)
        self.upto = before + p
        self.upto[self.first[1:] - 1] = 1.0

    def pick(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each node, as probable as what lies behind it."""
        edge = self.first[nodes]
        live = np.flatnonzero(u >= self.upto[edge])
        while len(live):
            edge[live] += 1
            live = live[u[live] >= self.upto[edge[live]]]
        return edge


def _levels(rank: np.ndarray) -> list[np.ndarray]:
    """Places of the ranks 0, 1, ..."""
    order = np.argsort(rank.astype(np.uint8) if rank.max(initial=0) < 256 else rank, kind="stable")
    return np.split(order, np.cumsum(np.bincount(rank))[:-1]) if len(rank) else [order]


class Store:
    """Lattices of the words that a worker met first, kept side by side in arrays; those of other words come after them and
    last for one batch. It has what a Lattice has."""

    def __init__(self, table: PieceTable):
        self.table, self.known = table, {}
        self.nodes = self.edges = 0
        self._first = np.zeros(1, np.int64)
        self._per_edge = {k: np.zeros(0, t) for k, t in (("next", np.int32), ("edge", np.int32), ("log_p", float), ("log_others", float), ("upto", float))}

    pick = Lattice.pick

    def place(self, words: list[str]) -> np.ndarray:
        """The first node of each of these distinct words."""
        start = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(start < 0)
        new = Lattice([words[i] for i in missing.tolist()], self.table)
        nodes, edges = self.nodes + len(new.first) - 1, self.edges + len(new.next)
        if nodes + 1 > len(self._first):
            first = np.zeros(max(nodes + 1, min(2 * len(self._first), KEPT_NODES)), np.int64)
            first[: self.nodes + 1] = self._first[: self.nodes + 1]
            self._first = first
        self._first[self.nodes : nodes + 1] = new.first + self.edges
        for name, own in self._per_edge.items():
            if edges > len(own):
                grown = np.zeros(max(edges, int(1.5 * len(own))), own.dtype)
                grown[: self.edges] = own[: self.edges]
                own = self._per_edge[name] = grown
            own[self.edges : edges] = getattr(new, name) if name != "next" else np.where(new.next >= 0, new.next + self.nodes, -1)
            setattr(self, name, own[:edges])
        self.first = self._first[: nodes + 1]
        start[missing] = new.start + self.nodes
        if nodes <= KEPT_NODES:
            self.known.update(zip((words[i] for i in missing.tolist()), start[missing].tolist(), strict=True))
            self.nodes, self.edges = nodes, edges
        return start


def _random(key: np.ndarray, *counters) -> np.ndarray:
    """Uniform numbers in (0, 1), a function of the key and the counters alone."""
    x = key.astype(np.uint64)
    for c in counters:
        x = (x ^ np.asarray(c, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) + _HASH
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _under(bound: np.ndarray, location: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of a location (-inf: none), given that they are under a bound."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(location), -np.inf, -np.logaddexp(-bound, np.log(-np.log(u)) - location))


def _stream(key: np.ndarray, draw: int, word: np.ndarray) -> np.ndarray:
    """The state from which a word's numbers are drawn, one for each step."""
    x = (key ^ np.uint64(draw)) * np.uint64(0xBF58476D1CE4E5B9) + word.astype(np.uint64) * _HASH
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _walk(lattice: Store, nodes: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, number of edges of each start) from the start nodes to their words' ends, in order."""
    n = len(nodes)
    live, at, steps = np.arange(n), nodes, []
    count = np.zeros(n, np.int64)
    while len(live):
        edge = lattice.pick(at, _random(stream[live], len(steps)))
        steps.append((live, edge))
        count[live] += 1
        after = lattice.next[edge]
        on = after >= 0
        live, at = live[on], after[on]
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    for step, (who, edge) in enumerate(steps):
        out[first[who] + step] = edge
    return out, count


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of each stretch between cuts; 0 for an empty one."""
    out = np.zeros(len(cuts) - 1)
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        out[some] = np.add.reduceat(values, cuts[some])
    return out


class _Path:
    """One draw of every text: its edges, the words they lie in, the probability of what is left aside at each edge, and the
    greatest perturbed value among all that is left aside."""

    def __init__(self, lattice: Store, edges: np.ndarray, word: np.ndarray, cuts: np.ndarray, open_from: np.ndarray, perturbed: np.ndarray, u: np.ndarray):
        self.edges, self.word, self.cuts, self.perturbed = edges, word, cuts, perturbed
        size = np.diff(cuts)
        log_p = lattice.log_p[edges]
        run = np.concatenate([[0.0], np.cumsum(log_p)])
        self.before = run[:-1] - np.repeat(run[cuts[:-1]], size)
        self.aside = np.exp(self.before + lattice.log_others[edges])
        closed = np.arange(len(edges)) < np.repeat(cuts[:-1] + open_from, size)
        self.aside[closed] = 0.0
        self.log_prob = _sums(log_p, cuts)
        self.bound(np.arange(len(size)), perturbed, u)

    def bound(self, texts: np.ndarray, under: np.ndarray, u: np.ndarray) -> None:
        """Draws the greatest value left aside in these texts anew, under a bound: a Gumbel value of the summed probability."""
        if not hasattr(self, "best"):
            self.best = np.full(len(self.cuts) - 1, -np.inf)
        with np.errstate(divide="ignore"):
            self.best[texts] = _under(under, np.log(_sums(self.aside, self.cuts)[texts]), u)

    def place(self, texts: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge at which each of these texts leaves the path, as probable as what is left aside there."""
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.nan_to_num(self.aside / np.repeat(_sums(self.aside, self.cuts), np.diff(self.cuts)))
        upto = np.concatenate([[0.0], np.cumsum(share)])
        low, high = upto[self.cuts[texts]], upto[self.cuts[texts + 1]]
        return np.searchsorted(upto[1:], np.minimum(low + u * (high - low), np.nextafter(high, -1)), side="right")


def draw_paths(words: np.ndarray, n_words: np.ndarray, keys: np.ndarray, lattice: Store, draws: int) -> tuple[list[_Path], list[np.ndarray], np.ndarray]:
    """(paths, which texts have each, greatest value that remains) of texts with words; words has the first node of each word."""
    n = len(keys)
    every = np.arange(n)
    text = np.repeat(every, n_words)
    word = np.arange(len(text)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    root = -np.log(-np.log(_random(keys, 2**40)))
    edges, count = _walk(lattice, words, _stream(keys[text], 0, word))
    cuts = np.concatenate([[0], np.cumsum(np.bincount(text, weights=count, minlength=n).astype(np.int64))])
    paths = [_Path(lattice, edges, np.repeat(word, count), cuts, np.zeros(n, np.int64), root, _random(keys, 2**41))]
    alive, used = [np.ones(n, bool)], []
    for draw in range(1, draws):
        values = np.stack([p.best for p in paths])
        source, greatest = values.argmax(axis=0), values.max(axis=0)
        ok = np.isfinite(greatest)
        at, chosen = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for j, path in enumerate(paths):
            own = np.flatnonzero(ok & (source == j))
            if not len(own):
                continue
            here = path.place(own, _random(keys[own], 2**42 + draw))
            node = np.searchsorted(lattice.first, path.edges[here], side="right") - 1
            degree = lattice.first[node + 1] - lattice.first[node]
            options = lattice.first[node][:, None] + np.arange(degree.max())[None, :]
            free = (np.arange(degree.max())[None, :] < degree[:, None]) & (options != path.edges[here][:, None])
            for u_source, u_at, u_edge in used:
                free &= ~((u_source[own] == j) & (u_at[own] == here))[:, None] | (options != u_edge[own][:, None])
            mass = np.where(free, np.exp(lattice.log_p[np.where(free, options, 0)]), 0.0)
            upto = np.cumsum(mass, axis=1)
            pick = (np.minimum(_random(keys[own], 2**43 + draw) * upto[:, -1], np.nextafter(upto[:, -1], -1))[:, None] >= upto).sum(axis=1)
            mass[np.arange(len(own)), pick] = 0.0
            at[own], chosen[own] = here, options[np.arange(len(own)), pick]
            path.aside[here] = np.exp(path.before[here]) * mass.sum(axis=1)
            path.bound(own, greatest[own], _random(keys[own], 2**44 + draw))
        used.append((np.where(ok, source, -1), at, chosen))
        # a new path: the old one up to the place, the edge chosen there, and a walk from its end
        head, head_word, head_size, last_word = [], [], np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        for j, path in enumerate(paths):
            own = np.flatnonzero(ok & (source == j))
            head_size[own], last_word[own] = at[own] - path.cuts[own], path.word[at[own]]
            size = head_size[own]
            take = np.repeat(path.cuts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            head.append((np.repeat(own, size), path.edges[take], path.word[take]))
        resume = np.where(ok, lattice.next[chosen], -1)
        go = (word > last_word[text]) | ((word == last_word[text]) & (resume[text] >= 0))
        begin = np.where(word == last_word[text], resume[text], words)[go]
        tail, count = _walk(lattice, begin, _stream(keys[text[go]], draw, word[go]))
        tail_text, tail_word = np.repeat(text[go], count), np.repeat(word[go], count)
        size = head_size + ok + np.bincount(tail_text, minlength=n)
        cuts = np.concatenate([[0], np.cumsum(size)])
        edges, of_word = np.zeros(cuts[-1], np.int64), np.zeros(cuts[-1], np.int64)
        for who, e, w in head:
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            edges[cuts[who] + rank], of_word[cuts[who] + rank] = e, w
        middle = (cuts[:-1] + head_size)[ok]
        edges[middle], of_word[middle] = chosen[ok], last_word[ok]
        to = (cuts[:-1] + head_size + 1)[tail_text] + np.arange(len(tail)) - np.searchsorted(tail_text, tail_text)
        edges[to], of_word[to] = tail, tail_word
        paths.append(_Path(lattice, edges, of_word, cuts, head_size + 1, np.where(ok, greatest, 0.0), _random(keys, 2**41 + draw)))
        alive.append(ok)
    return paths, alive, np.stack([p.best for p in paths]).max(axis=0)


def draw_rows(texts: pa.Array, keys: np.ndarray, store: Store, draws: int) -> tuple[np.ndarray, ...]:
    """(text, draw, number of edges, edges in a row, log_prob, perturbed, log_inclusion), a row for each draw, sorted by text and draw."""
    parts, n_words = all_pre_tokens(texts)
    coded = parts.dictionary_encode()
    first = store.place(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    full, empty = np.flatnonzero(n_words), np.flatnonzero(n_words == 0)
    nothing = np.zeros(len(empty))
    text, draw, size = [empty], [np.zeros(len(empty), np.int64)], [np.zeros(len(empty), np.int64)]
    edges, scores = [np.zeros(0, np.int64)], [(nothing, -np.log(-np.log(_random(keys[empty], 2**40))), nothing)]
    if len(full):
        paths, alive, threshold = draw_paths(first, n_words[full], keys[full], store, draws)
        for j, (path, there) in enumerate(zip(paths, alive, strict=True)):
            gap = path.log_prob - threshold
            with np.errstate(over="ignore", divide="ignore"):
                inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700.0)))))
            text.append(full[there])
            draw.append(np.full(there.sum(), j))
            size.append(np.diff(path.cuts)[there])
            edges.append(store.edge[path.edges])  # a text without this draw has no edges in it
            scores.append((path.log_prob[there], path.perturbed[there], inclusion[there]))
    text, draw, size = np.concatenate(text), np.concatenate(draw), np.concatenate(size)
    order = np.lexsort((draw, text))
    start, own = (np.cumsum(size) - size)[order], size[order]
    at = np.repeat(start - (np.cumsum(own) - own), own) + np.arange(own.sum())
    return text[order], draw[order], own, np.concatenate(edges)[at], *(np.concatenate(c)[order] for c in zip(*scores, strict=True))


def draw_batch(texts: list[str | None], keys: np.ndarray, store: Store, draws: int):
    """For each text its draws: [(edge ids, log_prob, perturbed, log_inclusion)]."""
    text, _, size, edges, *scores = draw_rows(pa.array(texts, pa.string()), keys, store, draws)
    out: list[list] = [[] for _ in texts]
    for i, own, *rest in zip(text.tolist(), np.split(edges, np.cumsum(size)[:-1]), *(c.tolist() for c in scores), strict=True):
        out[i].append((own, *rest))
    return out


def to_ids(edges: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Piece ids of edges; letters without a piece become their bytes."""
    return all_ids(edges, np.array([len(edges)]), pieces)[0]


def all_ids(edges: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each list) of lists of edges that stand in a row."""
    odd = np.flatnonzero(edges < 0)
    if not len(odd):
        return edges.astype(np.int32), sizes
    letters, which = np.unique(edges[odd], return_inverse=True)
    own = [[pieces.byte_ids[b] for b in letter_bytes(chr(-e - 1))] for e in letters.tolist()]
    width = np.ones(len(edges), np.int64)
    width[odd] = np.array([len(o) for o in own])[which]
    ends = np.cumsum(width)
    ids = np.repeat(edges, width).astype(np.int32)
    table = np.zeros((len(own), max(map(len, own))), np.int32)
    for row, o in zip(table, own, strict=True):
        row[: len(o)] = o
    for k in range(table.shape[1]):
        has = width[odd] > k
        ids[(ends - width)[odd[has]] + k] = table[which[has], k]
    return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])])


def row_keys(ids: list[int | None], texts: pa.Array, seed: int) -> np.ndarray:
    own = (str(i) if i is not None else (texts[at].as_py() or "") + "|" for at, i in enumerate(ids))
    return np.array([xxhash.xxh64_intdigest(o.encode("utf-8", "surrogatepass"), seed) for o in own], np.uint64)


_STORES: dict[str, Store] = {}


def sample_encodings(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", draws: int = DRAWS, seed: int = SEED, decoded: bool = False) -> DataFrame:
    """One row per draw: doc_id, draw (from 0, greatest perturbed value first), ids, log_prob, perturbed, log_inclusion; and
    `text`, decoded from the ids in the same pass, on request."""
    ship(docs.sparkSession)
    names = ["doc_id", "draw", "ids", "log_prob", "perturbed", "log_inclusion", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _STORES:
            _STORES[model_path] = Store(PieceTable(load(model_path)))
        store = _STORES[model_path]
        pieces = store.table.pieces
        for batch in batches:
            for at, n in chunks(batch.column(1), CHUNK_BYTES):
                doc_ids, texts = batch.column(0).slice(at, n), batch.column(1).slice(at, n)
                keys = row_keys(doc_ids.to_pylist(), texts, seed)
                text, draw, size, edges, *scores = draw_rows(texts, keys, store, draws)
                ids, counts = all_ids(edges, size, pieces)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                arrays = [doc_ids.take(pa.array(text)), pa.array(draw.astype(np.int32)), lists, *map(pa.array, scores)]
                if decoded:
                    arrays.append(pieces.decode_all(ids, counts))
                told = pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])
                del keys, text, draw, size, edges, scores, ids, counts, lists, arrays
                yield told
                del told
                give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freed(run), "doc_id long, draw int, ids array<int>, log_prob double, perturbed double, log_inclusion double" + ", text string" * decoded)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Adds `text`, what the ids stand for."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            texts = pieces.decode_all(lists.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(freed(run), fields + ", text string")


__all__ = ["SPACE", "decode", "draw_batch", "sample_encodings"]
