from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from kadastra.llm import sampling as s
from kadastra.llm.pieces import SPACE, load, pre_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "Hello  world\n\n foo bar", "naïve café\t한국어 🙂 x\n", "the same words " * 200, "abcdefgh" * 60, " lead and trail ", "▁ a▁b ▁▁", "x", "internationalization"]


def every_way(text, pieces):
    """All segmentations with their log-probabilities, by brute force."""
    whole = SPACE + text.replace(" ", SPACE)
    out = []

    def go(at, ids, score):
        if at == len(whole):
            out.append((tuple(ids), score))
            return
        if whole[at] not in pieces.scores:
            raw = whole[at].encode()
            go(at + 1, ids + [pieces.byte_ids[b] for b in raw], score + len(raw) * pieces.byte_score)
        for end in range(at + 1, min(len(whole), at + pieces.longest) + 1):
            if whole[at:end] in pieces.scores:
                go(end, ids + [pieces.ids[whole[at:end]]], score + pieces.scores[whole[at:end]])

    go(0, [], 0.0)
    total = np.logaddexp.reduce([v for _, v in out])
    return {i: v - total for i, v in out}


@pytest.mark.parametrize("text", ["the cat", "ab é", "a\nb c", "한"])
def test_draws_follow_the_distribution(text):
    pieces = load(PATH)
    table = s.Store(s.PieceTable(pieces))
    ways = every_way(text, pieces)
    n = 4000
    drawn = s.draw_batch([text] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), table, 3)
    first, second = Counter(), Counter()
    for own in drawn:
        ids = [tuple(s.to_ids(e, pieces).tolist()) for e, *_ in own]
        assert len(set(ids)) == len(ids) == min(3, len(ways))
        assert all(i in ways and abs(ways[i] - lp) < 1e-9 for i, (_, lp, _, _) in zip(ids, own))
        values = [g for _, _, g, _ in own]
        assert values == sorted(values, reverse=True)
        first[ids[0]] += 1
        if len(ids) > 1:
            second[ids[1]] += 1
    p = {w: np.exp(v) for w, v in ways.items()}
    for w in ways:
        assert abs(first[w] / n - p[w]) < 5 * np.sqrt(p[w] * (1 - p[w]) / n) + 2e-3
        q = sum(p[v] * p[w] / (1 - p[v]) for v in ways if v != w)
        assert abs(second[w] / n - q) < 5 * np.sqrt(max(q, 1e-4) / n) + 2e-3
    # weighting draws by inclusion makes sums unbiased
    estimate = np.mean([sum(np.exp(lp - li) for _, lp, _, li in own) for own in drawn])
    assert abs(estimate - 1) < 0.1


@pytest.mark.parametrize("kept", [0, 30, 10**6])
def test_kept_lattices_change_nothing(monkeypatch, kept):
    monkeypatch.setattr(s, "KEPT_NODES", kept)
    table = s.PieceTable(load(PATH))
    store = s.Store(table)
    batches = [["the cat sat", "한국어 x", None], ["the dog sat on the cat", "zz " * 5], ["", "the cat 🙂 internationalization dog"]]
    for texts in batches:
        keys = np.arange(len(texts), dtype=np.uint64)
        kept_, fresh = s.draw_batch(texts, keys, store, 2), s.draw_batch(texts, keys, s.Store(table), 2)
        for a, b in zip(kept_, fresh):
            assert [(x[0].tolist(), x[1:]) for x in a] == [(x[0].tolist(), x[1:]) for x in b]


def test_few_segmentations_are_all_drawn():
    pieces = load(PATH)
    ways = every_way("ab", pieces)
    own = s.draw_batch(["ab"], np.array([5], np.uint64), s.Store(s.PieceTable(pieces)), 50)[0]
    assert {tuple(s.to_ids(e, pieces).tolist()) for e, *_ in own} == set(ways)
    assert all(li == 0 for *_, li in own)


def test_round_trip_and_independence_of_partitions(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 2, "y"), (3, TEXTS[3], 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, draw int, ids string")
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.draw, list(r.ids), r.log_prob, r.perturbed, r.log_inclusion)
    one = s.decode(s.sample_encodings(docs.coalesce(1), PATH), PATH).collect()
    two = s.sample_encodings(docs.repartition(7), PATH).collect()
    assert [(a[:3], pytest.approx(a[3:])) for a in sorted(map(key, one))] == [(b[:3], b[3:]) for b in sorted(map(key, two))]
    both = s.sample_encodings(docs, PATH, decoded=True).collect()
    assert sorted((k := key(r))[:3] + (r.text,) for r in both) == sorted(key(r)[:3] + (r.text,) for r in one)
    want = {i: t or "" for i, t in enumerate(TEXTS)} | {None: "no id"}
    assert all(r.text == want[r.doc_id] for r in one)
    draws = Counter(r.doc_id for r in one)
    assert draws[0] == draws[1] == 1 and draws[3] == 4 and draws[5] == 2


def test_lattice_is_that_of_the_whole_text():
    pieces = load(PATH)
    text = "a b  c\nd"
    whole = set(every_way(text, pieces))
    split = [()]
    for word in pre_tokens(text):
        own = [w for w in _cuts(word, pieces)]
        split = [x + y for x in split for y in own]
    assert set(split) == whole


def _cuts(word, pieces):
    out = []

    def go(at, ids):
        if at == len(word):
            out.append(tuple(ids))
            return
        if word[at] not in pieces.scores:
            go(at + 1, ids + [pieces.byte_ids[b] for b in word[at].encode()])
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in pieces.ids:
                go(end, ids + [pieces.ids[word[at:end]]])

    go(0, [])
    return out


def test_empty_table(spark):
    assert s.sample_encodings(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
