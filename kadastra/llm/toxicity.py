"""Toxicity from a learned lexicon, with Levenshtein automata on its trie and scores of the words around each hit.

Learning. From labelled documents outside the held-out fold, at most TRAIN_ROWS of them (those of least id hash), the
terms are learned: whole words, and stems (beginnings of words) that outnumber each of their words, which stand in toxic
documents much more often than in clean ones and behind enough different words; a passage that is copied from document to
document brings the same word before each of its own, and so teaches no term. Each (term, edits) pair then gets its own
weight from the same sample, so that a misspelling that is an ordinary word counts for nothing, and a logistic
regression is fitted on the sums. What goes to the driver is bounded by the sample: TRAIN_ROWS short rows, and terms that
stand in at least LEAST_SUPPORT of its toxic documents each.

Scoring. All terms lie in one trie. The Levenshtein automata of all terms are run against it together: a state is a set
of trie nodes with the edits spent so far, made deterministic as words need it, so a word costs one look-up a letter.
A hit is quoted, aimed or plain by the words within CONTEXT of it: quotation marks on both sides or a verb of saying
make it quoted, an address to the reader makes it aimed; each kind has its own coefficient, and quoted hits can't count
for more than plain ones.

Defined results: null text counts as empty; texts without hits get the score of no evidence. A null id is not held out and
is not learned from. Repeated rows are scored alike. Without usable labels of both kinds every score is the share of
toxic labels (0 without any). Labels other than 0 and 1 are ignored. Other columns are never read.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra.llm.common import cut, freed
from kadastra.shipping import ship

#: Most labelled rows that are learned from.
TRAIN_ROWS = 20_000
#: A term stands in so many toxic documents and behind so many different words, at least.
LEAST_SUPPORT = 5
LEAST_LOG_ODDS = 3.0
#: Letters of a term from which on one edit is allowed.
FUZZY_LETTERS = 5
STEM_LETTERS = (4, 5, 6, 7, 8)
#: Words on either side that make a hit's context.
CONTEXT = 6
THRESHOLD = 0.7
#: Distinct words whose hits a worker remembers before it starts again, and steps of the automaton.
REMEMBERED = 300_000
STEPS = 200_000

# Marks and words that tell quotation and address apart, in the languages of the corpus.
QUOTES = "\"“”„«»‘’"
SAYING = frozenset("said says say quoted quote quotes called calls wrote writes dit disait cité écrit sagte sagt zitiert schrieb dijo dice citó escribió".split())
ADDRESS = frozenset("you your you're tu toi vous votre ton du dich dir ihr dein euch tú te usted vosotros ustedes".split())

KINDS = ("plain", "aimed", "quoted")
_EDGE = " \t\n\r\x0b\x0c.,;:!?()[]{}<>|*&%$#@~^_=+/\\-'`" + QUOTES


def held_out(doc_id: Column) -> Column:
    """Whether the id belongs to the fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


# ---- the automaton


class Lexicon:
    """Terms in a trie, and the union of their Levenshtein automata, made deterministic on demand."""

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        self.deep: list[int] = [0]
        for term, ends in [*((w, self.word_at) for w in words), *((s, self.stem_at) for s in stems)]:
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.deep.append(self.deep[node] + 1)
                node = self.children[node][letter]
            ends[node] = term
        # the longest term below a node tells whether an edit can pay there
        self.reach = [0] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            own = self.deep[node] if node in self.word_at else 0
            self.reach[node] = max([own, *(self.reach[c] for c in self.children[node].values())])
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.start = self._close({(0, 0)})

    def _close(self, state: set[tuple[int, int]]) -> frozenset:
        """With letters of the term left out; of two ways to a node the cheaper stays."""
        least: dict[int, int] = {}
        for node, edits in state:
            least[node] = min(edits, least.get(node, 9))
            if not edits:
                for child in self.children[node].values():
                    if self.reach[child] >= FUZZY_LETTERS:
                        least.setdefault(child, 1)
        return frozenset(least.items())

    def _step(self, state: frozenset, letter: str) -> frozenset:
        out: set[tuple[int, int]] = set()
        for node, edits in state:
            child = self.children[node].get(letter)
            if child is not None:
                out.add((child, edits))
            if not edits and self.reach[node] >= FUZZY_LETTERS:
                out.add((node, 1))
                out.update((c, 1) for c in self.children[node].values() if self.reach[c] >= FUZZY_LETTERS)
        return self._close(out)

    def hit(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the best hit: a whole word, else its longest stem, else a word one edit off. Stems end in '*'."""
        state, stem = self.start, None
        for letter in word:
            key = (state, letter)
            after = self.steps.get(key)
            if after is None:
                if len(self.steps) >= STEPS:
                    self.steps.clear()
                after = self.steps[key] = self._step(state, letter)
            state = after
            if not state:
                break
            for node, edits in state:
                if not edits and node in self.stem_at:
                    stem = self.stem_at[node]
        exact = next((self.word_at[n] for n, e in state if not e and n in self.word_at), None)
        if exact is not None:
            return exact, 0
        if stem is not None:
            return stem + "*", 0
        close = sorted(self.word_at[n] for n, e in state if e and n in self.word_at and len(self.word_at[n]) >= FUZZY_LETTERS)
        return (close[0], 1) if close else None


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=list)
    prior: float = 0.0

    def features(self, hits: dict[tuple[str, int, str], int]) -> list[float]:
        """Per kind of context the weights of its hits, repeats counting less and less; terms; more hits than one."""
        sums = dict.fromkeys(KINDS, 0.0)
        for (term, edits, kind), n in sorted(hits.items()):
            sums[kind] += max(0.0, self.weights.get((term, edits), 0.0)) * (1 + math.log(n))
        meant = {(t, e): n for (t, e, k), n in hits.items() if k != "quoted" and self.weights.get((t, e), 0.0) > 0}
        return [math.log1p(sums[k]) for k in KINDS] + [math.log1p(len({t for t, _ in meant})), float(sum(meant.values()) > 1)]

    def score(self, hits: dict[tuple[str, int, str], int]) -> float:
        if not self.coefficients:
            return self.prior
        z = self.coefficients[-1] + sum(c * x for c, x in zip(self.coefficients, self.features(hits), strict=False))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


class Finder:
    """Hits of whole texts; remembers what each distinct word hit."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known: dict[str, tuple[str, int] | None] = {}

    def __call__(self, text: str) -> dict[tuple[str, int, str], int]:
        words = text.split()
        known, found = self.known, []
        for at, word in enumerate(words):
            if word in known:
                hit = known[word]
            else:
                if len(known) >= REMEMBERED:
                    known.clear()
                hit = known[word] = self.lexicon.hit(word.strip(_EDGE).lower())
            if hit is not None:
                found.append((at, hit))
        counts: dict[tuple[str, int, str], int] = defaultdict(int)
        for at, (term, edits) in found:
            counts[term, edits, self.kind(words, at)] += 1
        return counts

    @staticmethod
    def kind(words: list[str], at: int) -> str:
        before, after = words[max(0, at - CONTEXT) : at + 1], words[at : at + CONTEXT + 1]
        opened = any(w[0] in QUOTES for w in before)
        closed = any(w.rstrip(".,;:!?")[-1:] in QUOTES and w.rstrip(".,;:!?") for w in after)
        bare = {w.strip(_EDGE).lower() for w in (*before[:-1], *after[1:])}
        if (opened and closed) or bare & SAYING:
            return "quoted"
        return "aimed" if bare & ADDRESS else "plain"


_FINDERS: dict[tuple, Finder] = {}


def _finder(model: Model) -> Finder:
    key = (tuple(model.words), tuple(model.stems))
    if key not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[key] = Finder(Lexicon(model.words, model.stems))
    return _FINDERS[key]


# ---- learning


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, toxic, text) of at most TRAIN_ROWS labelled documents outside the held-out fold."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    named = named.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    chosen = named.join(known, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one text for each id, the least, however often the id occurs
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))


def _units(rows: DataFrame) -> DataFrame:
    """(unit, toxic, before): once per document, each word and each beginning of a word, with a word before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, str]] = []

        def send():
            units, toxics, befores = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(units), pa.array(toxics, pa.int32()), pa.array(befores)], names=["unit", "toxic", "before"])

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen: dict[str, str] = {}
                last = ""
                for raw in text.as_py().split():
                    word = raw.strip(_EDGE).lower()
                    if word not in seen and raw[0] not in QUOTES and raw[-1] not in QUOTES:  # what is quoted teaches nothing
                        seen[word] = last
                        for n in STEM_LETTERS:
                            if len(word) > n:
                                seen.setdefault(word[:n] + "*", last)
                    last = word
                out += [(unit, toxic, before) for unit, before in seen.items()]
                if len(out) > 50_000:
                    yield send()
                    out = []
        if out:
            yield send()

    return rows.select("toxic", "text").mapInArrow(freed(run), "unit string, toxic int, before string")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    ship(docs.sparkSession)
    rows = cut(sample(docs, labels, id_col, text_col))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    model = Model(prior=toxic / (toxic + clean) if toxic + clean else 0.0)
    if not toxic or not clean:
        return model
    odds = F.log((F.col("t") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(clean + 1.0))
    terms = (
        _units(rows)
        .groupBy("unit")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.approx_count_distinct(F.when(F.col("toxic") == 1, F.col("before"))).alias("contexts"))
        .filter((F.col("t") >= LEAST_SUPPORT) & (F.col("contexts") >= F.greatest(F.lit(LEAST_SUPPORT), F.col("t") / 4)))
        .withColumn("odds", odds)
        .filter(F.col("odds") >= LEAST_LOG_ODDS)
        .collect()
    )
    support = {r["unit"]: r["t"] for r in terms}
    model.words = sorted(u for u in support if u and not u.endswith("*"))
    most = {s: max([0, *(support[w] for w in model.words if w.startswith(s[:-1]))]) for s in support if s.endswith("*")}
    model.stems = sorted(s[:-1] for s in most if support[s] >= 1.5 * most[s])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(model)
        for batch in batches:
            own = []
            for text in batch.column(2):
                found = finder(text.as_py())
                own.append([{"t": t, "e": e, "k": k, "n": n} for (t, e, k), n in found.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, schema.field("hits").type)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("hits", pa.list_(pa.struct([("t", pa.string()), ("e", pa.int32()), ("k", pa.string()), ("n", pa.int32())])))])
    found = rows.select("doc_id", "toxic", "text").mapInArrow(freed(hits), "doc_id long, toxic int, hits array<struct<t: string, e: int, k: string, n: int>>")
    seen = sorted((r["doc_id"], r["toxic"], sorted((h["t"], h["e"], h["k"], h["n"]) for h in r["hits"])) for r in found.collect())  # at most TRAIN_ROWS
    in_class = [defaultdict(int), defaultdict(int)]
    for _, label, own in seen:
        for pair in {(t, e) for t, e, k, _ in own if k != "quoted"}:
            in_class[label][pair] += 1
    for pair in in_class[0].keys() | in_class[1].keys():
        model.weights[pair] = math.log((in_class[1][pair] + 0.5) / (toxic + 1)) - math.log((in_class[0][pair] + 0.5) / (clean + 1))
    x = np.array([[*model.features({(t, e, k): n for t, e, k, n in own}), 1.0] for _, _, own in seen])
    y = np.array([label for _, label, _ in seen], float)
    model.coefficients = fit(x, y)
    quoted, plain = KINDS.index("quoted"), KINDS.index("plain")
    model.coefficients[quoted] = min(model.coefficients[quoted], model.coefficients[plain])
    return model


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Coefficients of a ridge logistic regression by Newton's method; the last column is the constant and isn't shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + shrink * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


# ---- scoring


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted, hits (term, edits, kind of context, count)."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("hits", pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("kind", pa.string()), ("n", pa.int32())])))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon: its bound is that of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        finder = _finder(own)
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(1):
                found = finder(text.as_py() or "")
                scores.append(own.score(found))
                hits.append([{"term": t, "edits": e, "kind": k, "n": n} for (t, e, k), n in sorted(found.items())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, schema.field("hits").type)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(freed(run), "doc_id long, score double, hits array<struct<term: string, edits: int, kind: string, n: int>>")
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with all its columns, without the rows that are predicted toxic."""
    ship(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared.value)
        for batch in batches:
            keep = [shared.value.score(finder(t.as_py() or "")) < THRESHOLD for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(freed(run), docs.schema)


def crc_fold(doc_id: int) -> bool:
    """held_out() in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
