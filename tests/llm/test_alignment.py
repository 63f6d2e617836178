import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kadastra.llm import alignment
from kadastra.llm.queries import op12_tokenizer_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokens():
    """Tokens (id, bytes) of whole texts under both tokenizers."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in seen} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in seen)}

    def first(text):
        return [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def second(text):
        return [(i, bytes([int(p[3:5], 16)]) if b.IsByte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.IdToPiece(i)]]

    return first, second


def brute_force(rows, tokens):
    """{doc_id: result} by comparing the byte ranges of every two tokens that lie near one another."""
    links, groups, sizes, holders = {}, {}, {}, Counter()
    for i, text in rows:
        first, second = (f(text) for f in tokens) if text else ([], [])
        want = f" {text}".encode()
        if not text or b"".join(x for _, x in first) != want or b"".join(x for _, x in second) != want:
            links[i], groups[i], sizes[i] = [], "", (0, 0, 0)
            continue
        ends_a, ends_b = (np.cumsum([len(x) for _, x in t]).tolist() for t in (first, second))
        own, j = [], 0
        for k, (a, spelled) in enumerate(first):
            low = ends_a[k] - len(spelled)
            while ends_b[j] <= low:
                j += 1
            m = j
            while m < len(second) and ends_b[m] - len(second[m][1]) < ends_a[k]:
                own.append((a, second[m][0]))
                m += 1
        written, at = [], [0, 0]
        for end in sorted(set(ends_a) & set(ends_b)):
            sides = []
            for side, (side_tokens, ends) in enumerate(((first, ends_a), (second, ends_b))):
                begin = at[side]
                while at[side] < len(ends) and ends[at[side]] <= end:
                    at[side] += 1
                sides.append(",".join(str(t) for t, _ in side_tokens[begin : at[side]]))
            written.append("|".join(sides))
        links[i], sizes[i] = own, (len(first), len(second), len(written))
        groups[i] = hashlib.sha256(";".join(written).encode()).hexdigest()
        holders.update(set(own))
    best = defaultdict(int)
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    return {i: (*sizes[i], len(own), sum(holders[p] == best[p[0]] for p in own), sum(holders[p] for p in own), groups[i]) for i, own in links.items()}


def result(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: tuple(r[n] for n in names) for r in rows}


def invented(seed, texts):
    draw = np.random.default_rng(seed)
    alphabet = ["the", "The", "ation", "ü", "東", "京", "🙂", "'s", "can't", "12", "3", ".", ",", "?!", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "　", "\x1c", "\x85", "<|endoftext|>", "<s>", "▁", "﷐", "é", "é", "ﬁ", "_", "\x00", "x" * 70]
    weights = np.ones(len(alphabet))
    weights[[29, 35]] = 0.02
    return ["".join(draw.choice(alphabet, int(draw.integers(1, 40)), p=weights / weights.sum())) for _ in range(texts)]


def test_units_give_the_tokens_of_whole_texts(tokens):
    aligner = alignment.Aligner(A, B)
    assert aligner.cuts
    texts = invented(1, 1500) + ["", "a b"] * 0 + ["a b c", "a\nb\nc", " a", "a ", "\na", "a\n", "a  b", "a \n b", "a.\nB c"]
    flat, counts = aligner.units(pa.array(texts))
    assert counts.sum() == len(flat)
    own = flat.to_pylist()
    for text, n in zip(texts, counts.tolist()):
        units, own = own[:n], own[n:]
        assert "".join(units) == " " + text
        a, n_a, b, n_b = aligner._encoded(units)
        assert a.tolist() == [i for i, _ in tokens[0](text)]
        assert b.tolist() == [i for i, _ in tokens[1](text)], repr(text)


@pytest.mark.parametrize("units", [5, 200_000])
def test_against_whole_texts(spark, tokens, monkeypatch, units):
    monkeypatch.setattr(alignment, "UNITS", units)
    monkeypatch.setattr(alignment, "_LOADED", {})
    texts = invented(2, 150)
    rows = list(enumerate(texts + texts[:40] + [texts[3]] * 20 + ["", None, "plain words here and plain words there"]))
    assert result(alignment.align(spark.createDataFrame(rows, SCHEMA), A, B)) == brute_force(rows, tokens)


def test_join_beyond_the_broadcast_bound(spark, tokens, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS", 0)
    rows = list(enumerate(invented(4, 40)))
    assert result(alignment.align(spark.createDataFrame(rows, SCHEMA), A, B)) == brute_force(rows, tokens)


def test_odd_rows(spark, tokens):
    long = "word and other words " * 20_000
    rows = [(1, long, 1, 2), (None, "Hi there.", 1, 2), (2, "Hi there.", 1, 2), (2, "Hi there.", 1, 2), (3, None, 1, 2), (4, "▁", 1, 2)]
    got = alignment.align(spark.createDataFrame(rows, SCHEMA + ", digest int, pair int"), A, B).collect()
    want = brute_force([(i, r[1]) for i, r in enumerate(rows)], tokens)
    assert sorted((tuple(r) for r in got), key=str) == sorted(((r[0], *want[i]) for i, r in enumerate(rows)), key=str)
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0


def test_whole_table(spark, tokens):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    df = op12_tokenizer_alignment(spark, path)
    assert result(df) == brute_force(rows, tokens)
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
