import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kadastra.llm import token_files as tf
from kadastra.llm.common import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello  world\n\tdon't we'LL  1234 x y  z naïve café Straße ǅ Σας ΟΔΟΣ",
    "",
    None,
    " \t\n\x0b\x0c\r ",
    "<|endoftext|> a<|startoftext|>b <|endof text|>",
    "é ́x ́ 한국어 中文字 🙂🙂 a.b,c!? x\x1cy\x85z \x00",
    "İstanbul ŒUVRE 힣 'S 'Ve it's",
    "İİ ıI ŉ ǰ ẞ ß ſ ŀ ĸ K Å ª º µ don,t a. a.. A, 'a. é. É, Ǆ. x'd 's. I'LL, ʼn ,. ., . , é́. Ĳ ĳ ÀÈ. ÀÈ, àè",
    "long " * 30000,
    "a" * 5000,
]


@pytest.mark.parametrize("high", [1, 2, 1000, 49408, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(high, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint32)
    if n:
        ids[rng.integers(0, n, n // 20)] = high - 1
        ids[: n // 2] //= 50
    back, lengths = tf.unpack(tf.pack(ids, np.array([n])))
    assert (back == ids).all() and lengths.tolist() == [n]
    for b in range(-(-n // tf.BLOCK)):
        assert (tf.unpack_block(tf.pack(ids, np.array([n])), b) == ids[b * tf.BLOCK : (b + 1) * tf.BLOCK]).all()


def test_blocks_are_small():
    ids = np.full(12800, 7, np.uint32)
    ids[5] = 40000
    assert len(tf.pack(ids, np.array([12800]))) < 1400


def test_files_match_the_tokenizer(spark, monkeypatch):
    rows = [(10 - i, t, "doc", i) for i, t in enumerate(TEXTS)] + [(3, "again same id", "x", 1), (None, "no id", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(5)
    path = new_path(spark, "ids")
    tf.write_ids(docs, path, PATH)
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(((-1 if d is None else d), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _, _ in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids), r.start) for r in tf.read_ids(spark, path).collect())
    assert [(d, i) for d, i, _ in got] == want
    told = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tf.describe_ids(spark, path).collect())
    at = 0
    for d, s, n, c in sorted(told, key=lambda x: x[1]):
        assert s == at
        at += n
    assert [x[0] for x in sorted(told, key=lambda x: x[1])] == sorted(x[0] for x in told)
    assert sorted((d, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i, s in got) == told


def test_every_latin_letter():
    encoder, tokenizer = tf.WordEncoder(PATH), Tokenizer.from_file(PATH)
    words = [f + c + e for c in map(chr, range(0x21, 0x300)) if not c.isspace() for f in ("", "ab", "Ç") for e in ("", "z", ".", ",", "'S")]
    assert encoder.by_words
    ids, counts = encoder.encode(pa.array(words))
    want = [tokenizer.encode(w, add_special_tokens=False).ids + [2] for w in words]
    assert ids.tolist() == [i for own in want for i in own] and counts.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("remembered", [1, 50, 10**6])
def test_words_with_marks(monkeypatch, remembered):
    monkeypatch.setattr(tf, "REMEMBERED", remembered)
    encoder, tokenizer = tf.WordEncoder(PATH), Tokenizer.from_file(PATH)
    rng = np.random.default_rng(5)
    letters = list("abcéÀzß'.,!?;:<|>()[]*&%$#@~^_-+=/\\`\"“”«»’19 \n\u0301İ한")
    texts = [None, ""] + ["".join(rng.choice(letters, 12)) for _ in range(4000)]
    for at in range(0, len(texts), 700):
        own = texts[at : at + 700]
        ids, counts = encoder.encode(pa.array(own, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in own]


def test_a_tokenizer_with_other_rules_encodes_whole_texts(spark):
    other = public_tokenizers.path("byte_bpe_50k.json")
    path, tokenizer = new_path(spark, "ids"), Tokenizer.from_file(other)
    tf.write_ids(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"), path, other)
    got = {r.doc_id: list(r.ids) for r in tf.read_ids(spark, path).collect()}
    assert got == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    path = new_path(spark, "ids")
    tf.write_ids(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert tf.describe_ids(spark, path).collect() == []
