import hashlib
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from kadastra.llm import repair
from kadastra.llm.queries import op13_conversation_repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, lines) of the rows (role, text, gone, truncated), by trying every script."""

    @cache
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            to = NEXT[state]
            cost, audit, lines = best(i, to, inserts + 1)
            found.append((cost + 5, "I" + audit, ({"u": "user", "a": "assistant"}[to] + ":", *lines)))
        if i < len(rows):
            role, text, gone, truncated = rows[i]
            ways = [("D", 2, state, ())]
            if not gone:
                initial = role[:1]
                if initial == NEXT[state] or (initial == "s" and state == ""):
                    ways.append(("K", 5 * truncated, initial, (f"{role}:{text}",)))
                ways.append(("R", 1 + 5 * truncated, NEXT[state], ({"u": "user", "a": "assistant"}[NEXT[state]] + ":" + text,)))
            for edit, price, to, line in ways:
                cost, audit, lines = best(i + 1, to, 0)
                found.append((cost + price, edit + audit, line + lines))
        return min(found) if found else (10**9, "", ())

    for i in range(len(rows), 0, -1):  # from the end on, so that no call goes deep
        for state in NEXT:
            best(i, state, 0)
    return best(0, "", 0)


def brute_force(rows):
    """{conv_id: result} of rows (conv_id, turn, role, text)."""
    left, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        left[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        left[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, own in left.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, known, blank, duplicate, cut_off = set(), [], 0, 0, 0
        for _, role, text in own:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            blank, duplicate, cut_off = blank + (fault == "blank"), duplicate + (fault == "duplicate"), cut_off + (fault == "truncated")
            known.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(tuple(known))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, duplicate, cut_off, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def invented(seed, conversations, most):
    draw = np.random.default_rng(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(int(draw.integers(1, most))):
            role = ["user", "assistant", "system", "tool", None, ""][int(draw.choice(6, p=[0.35, 0.35, 0.12, 0.08, 0.05, 0.05]))]
            text = ["Yes.", "No!", "Why", "Go on?", "", " \t", "What is it. \n", None, "Ünd", f"{turn}."][int(draw.integers(10))]
            rows.append((conv, turn * int(draw.integers(1, 3)) if draw.random() < 0.9 else None, role, text))
    return rows


def test_tables_are_small_and_blocks_agree_with_single_steps():
    table = repair.tables()
    assert len(table.vectors) < 100
    symbols = np.random.default_rng(1).integers(0, repair.SYMBOLS, 31)
    v, cost = 0, 0
    for s in symbols[::-1]:
        cost, v = cost + table.gain[v, s], table.step[v, s]
    assert table.repair(symbols)[1] == cost + table.vectors[v][0]
    starts, leads = table.piece(symbols)
    assert starts[0] == v
    for end in range(len(table.vectors)):
        for state in range(4):
            assert table.repair(symbols, end, state)[2] == leads[end, state]


def test_against_every_script(spark):
    rows = invented(3, 300, 9)
    # turns that occur twice in a conversation are ordered by role and hash; keep one of each here
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    got = result(repair.repair_damaged(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute_force(rows)


def test_conversations_cut_by_partitions(spark):
    rows = [(7, t, ["user", "assistant", "system", "tool"][t * 7 % 5 % 4], ["Yes.", "No", f"{t}!", f"{t % 50}?", ""][t % 5]) for t in range(400)] + [(8, t, "user", f"{t}.") for t in range(3)]
    rows += [(9, None, "user", f"{t}.") for t in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(repair.repair_damaged(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_force(rows)
    assert {k: got[k] for k in (7, 8)} == {k: want[k] for k in (7, 8)}
    assert got[9][:6] == want[9][:6]  # ties of turn and role follow the hash of the text


def test_cut_conversation_in_one_piece(spark):
    rows = [(7, t, ["user", "assistant"][t % 2], f"{t % 30}.") for t in range(60)]
    dealt = repair._dealt(repair.damaged(spark.createDataFrame(rows, SCHEMA)))
    got = repair._cut_conversations(dealt.coalesce(1)).collect()
    assert [tuple(r)[1:] for r in got] == [brute_force(rows)[7]]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, 5, "assistant", "x" * 300_000 + "."), (1, 4, "user", "Hm?"), (1, 4, "user", "Hm?"), (2, 0, "", "a."), (3, -5, "user", "b."), (3, 5, "assistant", "c.")]
    got = result(repair.repair_damaged(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", key int")))
    assert got == brute_force(rows)
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversation_that_loses_all_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(repair.repair_damaged(spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = op13_conversation_repair(spark, path)
    assert result(df) == brute_force(rows)
    assert [t for _, t in df.drop("audit", "repaired_sha256").dtypes] == ["bigint"] * 7
