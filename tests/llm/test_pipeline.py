"""Each stage of the pipeline on its own input."""

import random

import pytest

import corpus_pipeline
from kadastra.llm import simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(800)]
    rows, labels = [], []
    for i in range(260):
        words = [rng.choice(vocabulary) for _ in range(150)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(1, 140), rng.choice(["blorgish", "snarkface"]))
        lines = [" ".join(words[k : k + 30]) for k in range(0, len(words), 30)]
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    for i in range(40):
        words = rows[6 * i + 1][1].split(" ")
        words[rng.randint(0, len(words) - 1)] = "changed"
        rows.append((1000 + i, " ".join(words), "en", "copies", 0))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s0", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return str(path), {r[0]: r for r in rows}, {d for d, _, t in labels if t}


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mix_sources", "sample_encodings"]


def test_toxicity_rejects(spark, world):
    path, rows, toxic = world
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = STAGES["toxicity"](spark, docs, path)
    assert out.schema == docs.schema
    kept = {r.doc_id for r in out.collect()}
    assert not kept & toxic and kept == rows.keys() - toxic


def test_near_duplicates_leave_one(spark, world):
    path, rows, _ = world
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = STAGES["simhash_near_dedup"](spark, docs, path)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(set(kept))

    def shingles(text):
        w = (text or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {d: shingles(r[1]) for d, r in rows.items()}
    root = {d: d for d in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d in rows:
        for o in rows:
            if o < d and len(sets[o] & sets[d]) >= 0.8 * len(sets[o] | sets[d]):
                a, b = sorted((find(o), find(d)))
                root[b] = a
    assert set(kept) == {find(d) for d in rows}


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table_and_odd_rows(spark, world, name):
    path, *_ = world
    docs = spark.createDataFrame([], COLUMNS)
    out = STAGES[name](spark, docs, path)
    assert out.collect() == [] and (name == "sample_encodings" or out.columns == docs.columns)
    odd = [(None, None, None, None, None), (1, None, "en", None, 0), (1, "", "en", "s", 0), (2, "same line of five words\n" * 3, "en", "s", 0), (2, "same line of five words\n" * 3, "en", "s", 0), (3, "long " * 200_000, None, "s", 1)]
    out = STAGES[name](spark, spark.createDataFrame(odd, COLUMNS), path)
    got = out.collect()
    assert {r.doc_id for r in got} <= {None, 1, 2, 3} and got


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_clashing_columns_pass_through(spark, world, name):
    path, rows, _ = world
    more = ("h1", "line", "no", "fp", "_row", "copies", "size", "key", "gone", "bits", "score", "hits", "root")
    docs = spark.createDataFrame([(*r, *(f"{c}-{r[0]}" for c in more)) for r in list(rows.values())[:60]], COLUMNS + "".join(f", {c} string" for c in more))
    out = STAGES[name](spark, docs, path)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}-{r.doc_id}" for r in got for c in more)


def test_large_groups_and_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    base = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :]), "en", "s", 0) for i, k in enumerate(range(0, 200, 4))] + [(0, "again", "en", "s", 0), (None, "no id", "en", "s", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()]
    assert kept.count(0) == 2 and kept.count(None) == 1 and len(kept) == 3


def test_whole_pipeline(spark, world):
    path, rows, toxic = world
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "draw", "ids", "log_prob"} <= set(out.columns)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids and not ids & toxic
