"""Queries whose work must not grow faster than their tables: against brute force, on rows that all meet."""

import datetime as dt
import math
import random
from types import SimpleNamespace

from kadastra.operators import identity, scoring
from kadastra.plans import extra, more

HOME = "id long, price double, area double, rooms int, floor int, housing_class string, lat double, lon double, is_duplicate boolean, is_active boolean, first_seen timestamp, last_seen timestamp, archived_at timestamp"


def home(i, price, *, area=60.0, rooms=2, floor=3, cls="a", lat=51.128, lon=71.43, active=True):
    return (i, price, area, rooms, floor, cls, lat, lon, False, active, dt.datetime(1999, 1, 1), dt.datetime(1999, 2, 1), None)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_searches_are_counted_without_pairs(spark):
    homes = [home(i, float(300 + i % 40), rooms=i % 6 or None, cls="ab"[i % 2], active=i % 7 != 0) for i in range(300)] + [home(900, None), home(901, 330.0, cls=None)]
    users = [(k, 9.0 + k % 5 * 0.5 - (100 if k == 3 else 0), k % 25, "abc"[k % 3]) for k in range(60)]
    m = SimpleNamespace(listings=spark.createDataFrame(homes, HOME), customer=spark.createDataFrame(users, "c_custkey long, c_acctbal double, c_nationkey long, c_mktsegment string"))
    told = extra.fil_user_searches(m)
    want = {}
    for k, money, nation, cls in users:
        if money > 0:
            n = sum(h[1] is not None and money * 30 <= h[1] <= money * 32 and h[5] == cls and h[9] and (nation % 5 == 0 or h[3] == nation % 5) for h in homes)
            if n:
                want[k] = n
    assert {r.c_custkey: r.n for r in told.collect()} == want and want
    assert "SortMergeJoin" not in plan(told)


def test_alternatives_are_found_without_pairs(spark):
    draw = random.Random(5)
    homes = [home(i, float(draw.randrange(50)), area=float(draw.randrange(40, 60)), rooms=1 + i % 2, floor=draw.choice((1, 4, 9)), lat=51.128 + draw.randrange(4) / 250, lon=71.43 + draw.randrange(3) / 200) for i in range(1200)]
    homes += [home(2000, None, area=None, lat=51.128), home(2020, 5.0, floor=None), home(2040, 6.0, lat=None), home(2060, 7.0, rooms=None), home(2080, 3.0, rooms=9)]
    want = set()
    for q in homes:
        if q[0] % 20 or q[6] is None or q[3] is None:
            continue
        found = []
        for t in homes:
            if t[0] != q[0] and t[3] == q[3] and t[6] is not None:
                d = math.sqrt(((q[6] - t[6]) * 111000) ** 2 + ((q[7] - t[7]) * math.cos(math.radians(q[6])) * 111000) ** 2)
                if d <= 700:
                    cheaper, larger = (None not in (t[k], q[k]) and a(t[k], q[k]) for k, a in ((1, float.__lt__), (2, float.__gt__)))
                    points = 2 * cheaper + larger + (t[4] is not None and t[4] not in (1, 9))
                    found.append((-points, round(d, 3), t[0]))
        want |= {(q[0], i, -p) for p, _, i in sorted(found)[:3]}
    told = extra.dm_buyer_alternatives(SimpleNamespace(listings=spark.createDataFrame(homes, HOME).repartition(3)))
    assert {tuple(r) for r in told.collect()} == want
    assert "SortMergeJoin" not in plan(told) and "BroadcastHashJoin" not in plan(told)


def test_pairs_of_a_brand_are_dealt_in_tiles_and_rounded_beforehand(spark):
    draw = random.Random(7)
    parts = [(k, "ab"[draw.randrange(2)], draw.choice("xyz"), float(draw.randrange(900)), draw.randrange(3), draw.choice([None, "s", "t"])) for k in range(150)] + [(900, None, "x", 1.0, 1, "s"), (901, "c", "x", 1.0, 1, "s")]
    m = SimpleNamespace(part=spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_retailprice double, p_size int, p_type string"))
    told, want = more.dm_entity_score(m), {}
    for a in parts:
        for b in parts:
            if a[0] < b[0] and a[1] is not None and a[1] == b[1]:
                d = abs(a[3] - b[3])
                score = 0.6 * (a[2] == b[2]) + (0.25 if d <= 150 else 0.12 if d <= 400 else 0.0) + 0.15 * (a[4] == b[4]) + 0.15 * (a[5] is not None and a[5] == b[5])
                want[a[0], b[0]] = round(min(score, 1.0), 4)
    found = told.collect()
    assert len(found) == len(want) and {(r.a, r.b): r.confidence for r in found} == want
    assert "x__p" in plan(told)  # tiles, where one task held a whole brand


def test_entity_score_takes_any_share_of_the_address(spark):
    rows = spark.createDataFrame([(s, d, v, o) for s in (None, 0.5, 0.7, 0.96) for d in (None, 100.0, 300.0, 500.0) for v in (None, False, True) for o in (None, 0.0, 0.33337, 1.0)], "s double, d double, v boolean, o double")
    for r in identity.entity_score(rows, "s", "d", "v", "o").collect():
        score = (0.6 if (r.s or 0) >= 0.95 else 0.35 if (r.s or 0) >= 0.6 else 0.0) + (0.0 if r.d is None else 0.25 if r.d <= 150 else 0.12 if r.d <= 400 else 0.0) + (0.15 if r.v else 0.0) + 0.15 * (r.o or 0.0)
        assert abs(r.confidence - round(min(score, 1.0), 4)) < 1e-12


def test_a_row_keeps_one_class_before_it_is_shuffled(spark):
    rows = [(i, "abc"[i % 3], float(i % 3 * 10 + i % 2), float(i % 7)) for i in range(60)] + [(900, "d", None, 1.0), (901, None, 500.0, 1.0)]
    told = scoring.gaussian_bayes(spark.createDataFrame(rows, "k long, label string, a double, b double"), "label", ["a", "b"], "k")
    got = {r.k: r.predicted for r in told.collect()}
    assert len(got) == len(rows) and all(got[i] == "abc"[i % 3] for i in range(60)) and got[900] is None
    assert "array_max" in plan(told)  # where all classes of a row were sorted
