import numpy as np

from kadastra.llm import line_dedup

SCHEMA = "text string, doc_id long, line int, id string, n_lines int"


def near(a, b):
    """Edit distance of word lists at most 1."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < line_dedup.MIN_WORDS:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def words(line):
    return [w for w in line.lower().translate({c: 32 for c in (9, 11, 12, 13)}).split(" ") if w]


def slow(rows):
    lines = []
    for r, (d, t) in enumerate(rows):
        for k, raw in enumerate((t or "").split("\n")):
            lines.append(((d is None, d or 0, k), r, raw, words(raw)))
    out = [[] for _ in rows]
    for place, r, raw, ws in sorted(lines, key=lambda x: (x[1], x[0])):
        gone = bool(ws) and any(p < place and (ws == o or near(ws, o)) for p, _, _, o in lines)
        if not gone:
            out[r].append(raw)
    return sorted((-1 if d is None else d, "\n".join(o), len((t or "").split("\n")), len((t or "").split("\n")) - len(o)) for (d, t), o in zip(rows, out))


def run(spark, rows):
    docs = spark.createDataFrame([(t, d, 1, "z", 2) for d, t in rows], SCHEMA).repartition(3)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect())


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [[f"w{i}" for i in rng.integers(0, 50, int(n))] for n in rng.integers(1, 14, 30)]
    rows = []
    for d in range(50):
        lines = []
        for _ in range(int(rng.integers(0, 6))):
            w = list(base[int(rng.integers(0, 30))])
            kind = int(rng.integers(0, 5))
            at = int(rng.integers(0, len(w)))
            if kind == 1:
                w[at] = "X%d" % rng.integers(0, 4)
            elif kind == 2:
                del w[at]
            elif kind == 3:
                w.insert(at, "Y%d" % rng.integers(0, 4))
            elif kind == 4:
                w = [x.upper() for x in w]
            lines.append(" ".join(w) if rng.random() < 0.7 else "\t" + "  ".join(w) + " ")
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (None, "w1 w2 w3 w4 w5 w6 never"), (None, rows[0][1]), (103, "a a a a a a\na a a a a\na a a a b a")]
    assert run(spark, rows) == slow(rows)


def test_hot_template_and_long_line(spark):
    rows = [(i, f"dear customer number {i} we thank you today\nbody{i} of the only kind") for i in range(300)]
    rows.append((999, " ".join(f"z{i}" for i in range(20000))))
    rows.append((1000, " ".join(f"z{i}" for i in range(20000) if i != 777)))
    got = {d: (t, k) for d, t, _, k in run(spark, rows)}
    assert got[1000] == ("", 1) and got[999][1] == 0
    assert all(got[i][1] >= 1 for i in range(1, 300))


def test_equal_ids(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "other words on this very line")]
    assert [k for *_, k in run(spark, rows)] == [0, 0, 0]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_text_of_very_many_lines(spark):
    import time

    lines = [f"entry {i % 150_000} of the long log" for i in range(300_000)]
    began = time.monotonic()
    row = line_dedup.dedup_lines(spark.createDataFrame([(1, "\n".join(lines) + "\nend")], "doc_id long, text string")).collect()[0]
    assert (row.n_lines, row.n_dropped) == (300_001, 299_999)
    assert row.text == "entry 0 of the long log\nend"
    assert time.monotonic() - began < 120
