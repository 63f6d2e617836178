import public_tokenizers
import pyarrow as pa
import pytest

from kadastra.llm import token_counts as tc
from kadastra.llm.pieces import LITERAL, SPACE, all_pre_tokens, letter_bytes, load, pre_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def best(text, pieces):
    """Viterbi over the whole text, not its pre-tokens: (score, tokens)."""
    s = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""
    at = [(0.0, 0)] + [None] * len(s)
    for end in range(1, len(s) + 1):
        ways = []
        for begin in range(max(0, end - pieces.longest), end):
            if s[begin:end] in pieces.scores:
                ways.append((at[begin][0] + pieces.scores[s[begin:end]], -at[begin][1] - 1))
        if s[end - 1] not in pieces.scores:
            n = len(letter_bytes(s[end - 1]))
            ways.append((at[end - 1][0] + n * pieces.byte_score, -at[end - 1][1] - n))
        score, minus = max(ways)
        at[end] = (score, -minus)
    return at[len(s)]


TEXTS = [None, "", " ", "   ", "Hello  world\n\n foo bar", "naïve café\t한국어 🙂 x\n", "the " * 3000, "abcdefgh" * 200, "▁▁ odd ▁", " lead and trail ", "don't stop believing internationalization"]


@pytest.mark.parametrize("nodes", [60, tc.NODES])
def test_matches_viterbi_over_whole_texts(spark, monkeypatch, nodes):
    trie = tc.Trie(load(PATH))
    monkeypatch.setattr(tc, "NODES", nodes)
    pieces = load(PATH)
    for text in TEXTS:
        words = pre_tokens(text)
        score, tokens = best(text or "", pieces)
        assert sum(trie[w][0] for w in words) == tokens
        assert sum(trie[w][1] for w in words) == pytest.approx(score)


def test_pre_tokens_of_all_texts():
    texts = TEXTS + ["\n\n  \n x", "  a   b    c", "a\x00b c", "\n", "▁", " ▁ ▁▁", "     ", "x \n y"]
    for own in (texts, [t for t in texts if t and "\x00" not in t], [None], []):
        words, counts = all_pre_tokens(pa.array(own, pa.string()))
        assert words.to_pylist() == [w for t in own for w in pre_tokens(t)] and counts.tolist() == [len(pre_tokens(t)) for t in own]


@pytest.mark.parametrize("remembered", [1, 6, 10**6])
def test_memory_changes_nothing(monkeypatch, remembered):
    monkeypatch.setattr(tc, "REMEMBERED", remembered)
    pieces = load(PATH)
    counts = tc.Counts(pieces)
    for texts in (TEXTS[:6], TEXTS[6:], TEXTS[3:8], ["the " * 50 + "a" * 100_000]):
        parts, tokens, scores = counts(pa.array(texts, pa.string()))
        assert parts.tolist() == [len(pre_tokens(t)) for t in texts]
        if len(texts) > 1:
            assert [(t, pytest.approx(s)) for t, s in zip(tokens.tolist(), scores.tolist(), strict=True)] == [best(t or "", pieces)[::-1] for t in texts]


def test_rows(spark):
    rows = [(i, t, "n_tokens", 1.5) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 0.0), (1, "again", "x", 0.0)]
    got = tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, log_prob double"), PATH).collect()
    pieces = load(PATH)
    assert len(got) == len(rows)
    assert sorted(r.n_tokens for r in got) == sorted(best(t or "", pieces)[1] for _, t, *_ in rows)


def test_empty_table(spark):
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
