"""Alike names that meet in tiles, against brute force."""

import random
import re

from kadastra.functions.text import _CYRILLIC, _LATIN
from kadastra.operators import entity

LETTERS = dict(zip(_CYRILLIC, _LATIN, strict=True))


def grams(name):
    return {f"  {w} "[i : i + 3] for w in re.split(r"[\W_]+", name.lower()) if w for i in range(len(w) + 1)}


def latin(name):
    return "".join(LETTERS.get(c, c) for c in name.lower())


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def phase(name):
    found = re.match(r"^(.*?) (\d{1,2})$", latin(name))
    return (int(found[2]), found[1]) if found else (None, latin(name))


def test_pairs_are_those_of_brute_force_and_never_rows_of_a_join(spark, monkeypatch):
    draw = random.Random(3)
    words = ["green", "greens", "park", "парк", "park side", "river", "ривер", "house", "lux", "smart", "зелёный", "tower"]
    names = sorted({" ".join(draw.sample(words, draw.randrange(1, 4)) + draw.choice(([], ["1"], ["2"]))) for _ in range(260)} | {"--", ""})
    left, right = names[::2] + names[:40:5], names[1::2] + names[:40:5]
    frame = lambda some: spark.createDataFrame(list(enumerate(some)), "id long, name string")
    want = {}
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            plain, translit = alike(grams(a), grams(b)), alike(grams(latin(a)), grams(latin(b)))
            if max(plain, translit) < entity.LEAST_NAME:
                continue
            (p, base), (q, other) = phase(a), phase(b)
            lone = (p is None) != (q is None) and alike(grams(base), grams(other)) >= entity.SAME_BASE
            said = 0 if p is None and q is None else 1 if p == q or (lone and 1 in (p, q)) else 2 if lone or None not in (p, q) else 0
            s, t = (next((w for w in n.split() if w in entity.PRODUCTS), None) for n in (a, b))
            sim = plain if plain >= entity.LEAST_NAME else translit
            want[i, j] = (round(sim, 12), plain < entity.LEAST_NAME, said, 0 if s is None and t is None else 1 if s == t else 2)
    assert {w[1] for w in want.values()} == {True, False} and {w[2] for w in want.values()} == {w[3] for w in want.values()} == {0, 1, 2}
    for tile in (entity.TILE, 7):
        monkeypatch.setattr(entity, "TILE", tile)
        told = entity.candidates(frame(left), frame(right))
        rows = told.collect()
        assert {(r.l_id, r.r_id): (round(r.similarity, 12), r.translit, r.phase, r.line) for r in rows} == want and len(rows) == len(want)
        assert told._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("FlatMapCoGroupsInArrow")  # pairs were joined, made distinct and joined again
