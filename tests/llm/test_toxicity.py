import math
import random

import pytest

from kadastra.llm import toxicity as t


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_matches_edit_distance():
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(40)})
    lexicon = t.Lexicon(terms, [])
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
        hit = lexicon.hit(word)
        if word in terms:
            assert hit == (word, 0)
        else:
            close = [x for x in terms if len(x) >= t.FUZZY_LETTERS and distance(x, word) == 1]
            assert hit == ((min(close), 1) if close else None)


def test_stems():
    lexicon = t.Lexicon(["idiot"], ["vequ"])
    assert lexicon.hit("vequance") == ("vequ*", 0) and lexicon.hit("veq") is None and lexicon.hit("idi0t") == ("idiot", 1)


def test_context_kinds():
    finder = t.Finder(t.Lexicon(["idiot"], []))
    assert dict(finder("what an idiot they are")) == {("idiot", 0, "plain"): 1}
    assert dict(finder("you are such an idiot")) == {("idiot", 0, "aimed"): 1}
    assert dict(finder('she said "what an idiot" then')) == {("idiot", 0, "quoted"): 1}
    assert dict(finder("an «idiot» here")) == {("idiot", 0, "quoted"): 1}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    plain = ["word%d" % i for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randint(1, 59), rng.choice(["blorgish", "snarkface", "vilequa", "vilequo", "vileque"]))
        elif i % 17 == 0:
            words[10:10] = ["he", "said", '"blorgish"']
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_and_holds_out(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame([(d, x, 0.5, "hits") for d, x in rows], "doc_id long, text string, score double, hits string").repartition(4)
    table = spark.createDataFrame([(d, x, "t") for d, x in labels] + [(5, None, "t"), (None, 1, "t"), (7, 9, "t"), (10**6, 1, "t")], "doc_id long, toxic int, text string")
    model = t.learn(docs, table)
    assert "blorgish" in model.words
    got = {r.doc_id: r for r in t.score(docs, model).collect()}
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [d for d in truth if t.crc_fold(d)]
    assert 200 < len(held) < 400
    right = sum(got[d].predicted == truth[d] for d in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    flipped = spark.createDataFrame([(d, 1 - x if t.crc_fold(d) else x) for d, x in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in t.score(docs, t.learn(docs, flipped)).collect()}
    assert again == {d: r.score for d, r in got.items()}  # held-out labels are never learned from


def slow_hit(word, model):
    """The best hit, from edit distances to every term."""
    if word in model.words:
        return word, 0
    stems = [x for x in model.stems if word.startswith(x)]
    if stems:
        return max(stems, key=len) + "*", 0
    close = [x for x in model.words if len(x) >= t.FUZZY_LETTERS and distance(x, word) == 1]
    return (min(close), 1) if close else None


def slow_score(text, model):
    words, counts = (text or "").split(), {}
    for at, raw in enumerate(words):
        hit = slow_hit(raw.strip(t._EDGE).lower(), model)
        if hit:
            before, after = words[max(0, at - t.CONTEXT) : at + 1], words[at : at + t.CONTEXT + 1]
            bare = {w.strip(t._EDGE).lower() for w in before[:-1] + after[1:]}
            quoted = any(w[0] in t.QUOTES for w in before) and any((w.rstrip(".,;:!?") or "-")[-1] in t.QUOTES for w in after)
            kind = "quoted" if quoted or bare & t.SAYING else "aimed" if bare & t.ADDRESS else "plain"
            counts[*hit, kind] = counts.get((*hit, kind), 0) + 1
    sums = [sum(max(0.0, model.weights.get((a, e), 0.0)) * (1 + math.log(n)) for (a, e, k), n in counts.items() if k == kind) for kind in t.KINDS]
    meant = {}
    for (a, e, k), n in counts.items():  # a term counts once, with the count of its last kind in order
        if k != "quoted" and model.weights.get((a, e), 0.0) > 0:
            meant[a, e] = n
    x = [math.log1p(v) for v in sums] + [math.log1p(len({a for a, _ in meant})), float(sum(meant.values()) > 1), 1.0]
    return 1 / (1 + math.exp(-sum(c * v for c, v in zip(model.coefficients, x, strict=True))))


@pytest.mark.parametrize("steps", [3, t.STEPS])
def test_scores_match_brute_force(spark, corpus, monkeypatch, steps):
    monkeypatch.setattr(t, "STEPS", steps)
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = t.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = [(0, "you blorgishh, and „snarkfac“ he wrote vilequax"), (1, 'x "y" snarkface! SNARKFACE vilequa.'), (2, None), (3, "word1 " * 20000 + "blorgish")]
    for doc_id, text in odd + rows[::9]:
        hits = t.Finder(t.Lexicon(model.words, model.stems))(text or "")
        assert model.score(hits) == pytest.approx(slow_score(text, model), abs=1e-9)
    got = {r.doc_id: r.score for r in t.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert got == {d: pytest.approx(slow_score(x, model), abs=1e-9) for d, x in odd}


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, None), (3, "w " * 60000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in t.score(docs, t.learn(docs, none)).collect()] == [0.0] * 5
    empty = docs.limit(0)
    assert t.score(empty, t.learn(empty, none)).collect() == []
    assert [r[0] for r in docs.select(t.held_out(docs.doc_id)).collect()] == [t.crc_fold(1), t.crc_fold(2), False, t.crc_fold(1), t.crc_fold(3)]


def test_sample_has_one_text_for_each_id(spark):
    docs = spark.createDataFrame([(3, "b", 1), (3, "a", 1), (3, "b", 1), (6, None, 1), (7, "x", 1)] + [(9, "c", 1)] * 50, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in (3, 6, 7, 9, 12)], "doc_id long, toxic int")
    rows = t.sample(docs, labels, "doc_id", "text").collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and set(ids) <= {3, 6, 7, 9}
    assert {r.doc_id: r.text for r in rows}.get(3, "a") == "a"
