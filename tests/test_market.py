"""Operators on small fixtures with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kadastra import shared
from kadastra.functions import geo, stats, text
from kadastra.operators import deal, economics, linking, market, models, outcomes, picks, ranking, relational, scenario, scoring

SCHEMA = "id long, price double, area double, rooms int, floor int, district string, housing_class string, complex_id long, first_seen timestamp, last_seen timestamp, archived_at timestamp, is_active boolean, is_duplicate boolean, lat double, lon double"
NOW = dt.datetime(2026, 1, 31)


def listing(id, price=1e7, area=20.0, seen=10, gone=None, active=True, **more):
    at = lambda days: None if days is None else NOW - dt.timedelta(days=days)
    row = {"id": id, "price": price, "area": area, "rooms": 2, "floor": 5, "district": "A", "housing_class": "comfort", "complex_id": 1, "first_seen": at(seen), "last_seen": at(gone if gone is not None else 0), "archived_at": at(gone), "is_active": active, "is_duplicate": False, "lat": 51.128, "lon": 71.43}
    row |= more
    row["price"], row["area"] = float(row["price"]), None if row["area"] is None else float(row["area"])
    return tuple(row[c.split()[0]] for c in SCHEMA.split(", "))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_medians_and_counts(spark):
    rows = frame(spark, listing(1, 10e6, 20), listing(2, 15e6, 30), listing(3, 25e6, 50))
    out = market.overview(rows, F.lit(NOW)).first()
    assert (out.active, out.median_price, out.median_ppm2) == (3, 15e6, 5e5)


def test_new_supply_and_exits(spark):
    rows = frame(spark, listing(1, seen=5), listing(2, seen=45), listing(3, seen=60, gone=5, active=False), listing(4, seen=90, gone=45, active=False))
    out = market.overview(rows, F.lit(NOW)).first()
    assert (out.new_supply, out.exits) == (1, 1)


def test_filters_keep_unknown_state_and_drop_short_lived(spark):
    rows = frame(spark, listing(1, active=None), listing(2, active=False), listing(3, seen=10, gone=9, active=True), listing(4, is_duplicate=True), listing(5, is_duplicate=None))
    kept = market.base(rows).filter(market.status_condition("active"))
    assert sorted(r.id for r in kept.collect()) == [1, 5]


def test_normalize_filters():
    assert market.normalize_filters({"period": "9", "rooms": "x", "status": "?", "district": " "}) == market.Filters()
    assert market.normalize_filters({"period": 90, "rooms": 4, "status": "all", "class": "elite"}) == market.Filters(90, None, "elite", 4, "all")


@pytest.mark.parametrize(
    "cells, want",
    [
        ([(1, "A", 100, 5e5), (1, "B", 10, 1e6), (2, "A", 10, 5e5), (2, "B", 100, 1e6)], (100.0, True)),
        ([(1, "A", 50, 5e5), (1, "B", 2, 1e6), (2, "A", 50, 5.5e5), (2, "B", 2, 9e6)], (110.0, True)),
        ([(1, "A", 50, 5e5), (2, "B", 50, 9e5)], (100.0, False)),
    ],
)
def test_chain_index(spark, cells, want):
    table = spark.createDataFrame(cells, "week int, cell string, n long, median double")
    last = market.chain_index(table, ["cell"]).orderBy(F.desc("week")).first()
    assert (last.index_value, last.linked) == want


def test_demand_verdicts(spark):
    rows = spark.createDataFrame([(5.0, 1.3, 100), (20.0, 1.3, 100), (20.0, 0.7, 100), (3.0, 0.7, 100), (20.0, 1.0, 100), (20.0, 2.0, 5)], "s double, d double, n int")
    got = [r[0] for r in rows.select(market.demand_verdict(F.col("s"), F.col("d"), F.col("n"))).collect()]
    assert got == ["deficit", "sells fast", "surplus", "slow", "balanced", "little data"]


def test_relist(spark):
    rows = frame(spark, listing(1, 30e6, 60.0, seen=100, gone=40, active=False), listing(2, 30.5e6, 61.0, seen=35), listing(3, 90e6, 61.0, seen=35))
    assert [tuple(r) for r in relational.relists(rows).collect()] == [(1, True, False)]


def test_outcomes_stay_unknown_while_open(spark):
    rows = frame(spark, listing(1, seen=10), listing(2, seen=40), listing(3, seen=30, gone=10, active=False), listing(4, seen=200, gone=190, active=False, area=99.0))
    none = spark.createDataFrame([], "listing_id long, old_price double, new_price double, changed_at timestamp, seq long")
    views = spark.createDataFrame([(4, NOW - dt.timedelta(days=200), 5), (4, NOW - dt.timedelta(days=196), 45), (3, NOW, 7)], "listing_id long, observed_at timestamp, views_count long")
    labels = outcomes.outcome_labels(rows.withColumn("details_fetched", F.lit(True)), none, views, F.lit(NOW))
    got = {r.id: r for r in labels.collect()}
    assert got[1].disappeared_within_30d is None and got[2].disappeared_within_30d is False and got[1].censored and got[1].outcome_notes == "censored"
    assert got[3].disappeared_within_30d is True and got[3].clean_disappearance_within_30d is None and got[3].relisted_within_60d is None
    assert got[4].clean_disappearance_within_30d is True and got[4].survives_90d is False and got[4].time_on_market == 10 and got[4].views_velocity == 10.0
    report = {r.label: (r.resolved, r.n_true) for r in outcomes.outcome_report(labels).collect()}
    assert report["disappeared_within_30d"] == (3, 2) and report["clean_disappearance_within_30d"] == (2, 1)


def test_kaplan_meier(spark):
    censored = spark.createDataFrame([("x", 10.0, False), ("x", 20.0, False)], "k string, t double, e boolean")
    assert scoring.kaplan_meier(censored, ["k"], "t", "e").collect() == []
    rows = spark.createDataFrame([("x", 100.0, False)] * 20 + [("x", 5.0, True)], "k string, t double, e boolean")
    steps = scoring.kaplan_meier(rows, ["k"], "t", "e")
    assert steps.first().survival == pytest.approx(20 / 21)
    assert scoring.km_quantile(steps, ["k"], "t", 0.1).collect() == []
    ended = spark.createDataFrame([("x", 1.0, True), ("x", 2.0, True)], "k string, t double, e boolean")
    assert [r.survival for r in scoring.kaplan_meier(ended, ["k"], "t", "e").orderBy("t").collect()] == [pytest.approx(0.5), 0.0]


def test_price_as_of_falls_back(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "id long, price double")
    t = lambda d: dt.datetime(2026, 1, d)
    changes = spark.createDataFrame([(1, 9.0, 8.0, t(2), 1), (1, 8.0, 10.0, t(20), 2), (2, 25.0, 20.0, t(20), 1)], "listing_id long, old_price double, new_price double, changed_at timestamp, seq long")
    got = {r.id: r.price_at for r in market.price_as_of(rows, changes, F.lit(t(10))).collect()}
    assert got == {1: 8.0, 2: 25.0, 3: 30.0}


def test_hex_rounds_half_to_even_and_counts_missing_area(spark):
    rows = frame(spark, listing(1, 30e6, 60.0), listing(2, 42e6, 60.0), listing(3, 36e6, None))
    out = scoring.hex_stats(rows).first()
    assert (out.n, out.avg_ppm2) == (3, 600000.0)
    q, r = geo.hex_axial(F.lit(geo.LAT0), F.lit(geo.LON0))
    assert spark.range(1).select(q, r).first()[:] == (0, 0)


def test_quantiles_differ_as_they_should(spark):
    rows = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 10)], "k int, v double")
    assert stats.floor_index_quantile(rows, ["k"], "v", 0.5, "q").first().q == 3.0
    assert rows.agg(stats.exact_quantile(F.col("v"), 0.5)).first()[0] == 2.5
    assert rows.agg(stats.truncated_quantile(F.col("v"), 0.5)).first()[0] == 2
    weighted = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 1), (1, 3.0, 5)], "k int, v double, w int")
    assert stats.weighted_median(weighted, ["k"], "v", "w", "m").first().m == 3.0


def test_spans_redirects_upsert_patch(spark):
    spans = spark.createDataFrame([("a", 1, 3), ("a", 2, 5), ("a", 7, 8), ("b", 0, 1)], "k string, s int, e int")
    assert sorted(tuple(r) for r in relational.merged_spans(spans, ["k"], "s", "e").collect()) == [("a", 1, 5), ("a", 7, 8), ("b", 0, 1)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(31)], "node long, target long")
    assert {r.root for r in relational.redirects(chain).collect()} == {31}
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, t int")
    assert sorted(tuple(r) for r in relational.upsert(now, new, ["k"], [F.desc("t")]).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(text.name_key(F.lit("Complex  «Alpha» "))) == "alpha"
    assert value(text.token_overlap(F.lit("Main street 5"), F.lit("main 5, block"))) == 1.0
    assert value(text.token_overlap(F.lit(""), F.lit("x"))) is None
    assert value(text.house_number(F.lit("Abay ave 12/3"))) == "12/3"
    assert value(text.roman_value(F.lit("XIV"))) == 14
    assert value(text.only_hit(F.lit("red ring"), [("colour", "red"), ("shape", "ring")], "unknown")) == "unknown"
    assert value(text.hamming_hex(F.lit("ff00"), F.lit("ff10"))) == 1
    assert "[mail]" in value(text.scrub(F.lit("write to a.b@c.example <b>now</b> +7 701 123 45 67")))


def test_isotonic(spark):
    def slow(values, weights):
        blocks = [[v, w, 1] for v, w in zip(values, weights)]
        i = 0
        while i < len(blocks) - 1:
            if blocks[i][0] > blocks[i + 1][0]:
                (v, w, n), (x, y, m) = blocks[i], blocks[i + 1]
                blocks[i : i + 2] = [[(v * w + x * y) / (w + y), w + y, n + m]]
                i = max(i - 1, 0)
            else:
                i += 1
        return [v for v, _, n in blocks for _ in range(n)]

    cases = [([5.0, 1.0, 3.0, 2.0, 8.0, 6.0, 9.0], [1.0] * 7), ([1.0, 2.0, 3.0], [1.0, 5.0, 2.0]), ([4.0, 3.0, 3.5, 1.0], [2.0, 1.0, 4.0, 0.5]), ([7.0], [3.0]), ([], [])]
    rows = spark.createDataFrame([(i, v, w) for i, (v, w) in enumerate(cases)], "i int, v array<double>, w array<double>")
    got = {r.i: r.f for r in rows.select("i", scenario.isotonic(F.col("v"), F.col("w")).alias("f")).collect()}
    for i, (v, w) in enumerate(cases):
        assert got[i] == pytest.approx(slow(v, w)) and got[i] == sorted(got[i])


def test_interpolation_is_constant_beyond_its_ends(spark):
    row = spark.createDataFrame([([0.0, 1.0, 3.0], [2.0, 4.0, 5.0])], "xs array<double>, ys array<double>")
    at = [-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 9.0]
    got = row.select(*[scenario.interpolate(F.col("xs"), F.col("ys"), F.lit(x)).alias(f"c{i}") for i, x in enumerate(at)]).first()
    assert list(got) == [2.0, 2.0, 3.0, 4.0, 4.5, 5.0, 5.0]


def test_scenarios_never_rise_with_the_discount(spark):
    rows = [listing(i, 1e7 + 1e5 * (i % 13), 20.0 + i % 5, seen=120, gone=120 - 5 - 3 * (i % 20), active=False) for i in range(60)] + [listing(100 + i, 1.1e7, 20.0, seen=10) for i in range(5)]
    got = {}
    for r in scenario.dom_scenarios(frame(spark, *rows), F.lit(NOW)).collect():
        got.setdefault(r.id, []).append((r.discount, r.days_low, r.days_high, r.level))
    assert got.keys() == {100 + i for i in range(5)}
    for own in got.values():
        own.sort()
        assert [d for d, *_ in own] == [0, 3, 5, 7, 10] and own[0][3] == "district_rooms"
        assert all(a[1] >= b[1] and a[2] >= b[2] and 3 <= b[1] <= b[2] <= 180 for a, b in zip(own, own[1:]))


def test_running_sums_over_a_whole_table(spark):
    values = [(i * 37 % 101, i) for i in range(300)]
    got = {r.k: (r.v_before, r.v_all) for r in ranking.running(spark.createDataFrame(values, "v long, k long").repartition(7), ["v", "k"], ["v"]).collect()}
    run = 0
    for v, k in sorted(values):
        assert got[k] == (run, sum(x for x, _ in values))
        run += v
    assert ranking.ranked(spark.createDataFrame([], "v long, k long"), ["v", "k"]).collect() == []


def test_similarity_lies_between_0_and_1(spark):
    import random

    rng = random.Random(5)
    maybe = lambda v: None if rng.random() < 0.2 else v
    one = lambda: (maybe(rng.randint(1, 3)), maybe(rng.randint(1, 3)), rng.uniform(20, 90), maybe(rng.randint(1, 12)), maybe(rng.randint(1990, 2025)), maybe(60.0), maybe(75.0), 51.1 + rng.random() / 50, 71.4 + rng.random() / 50)
    kind = "struct<house_id:long,complex_id:long,area:double,floor:int,year:int,class_ord:double,finish_ord:double,lat:double,lon:double>"
    rows = spark.createDataFrame([(one(), one()) for _ in range(200)] + [(x := one(), x)], f"a {kind}, b {kind}")
    got = [r[0] for r in rows.select(deal.similarity(F.col("a"), F.col("b"))).collect()]
    assert all(0 <= s <= 1 for s in got) and got[-1] == pytest.approx(1.0)


def test_bargain_ladder(spark):
    offers = spark.createDataFrame([(1, 9.0e6, True, False), (2, 1.0e7, True, False), (3, 1.3e7, False, False), (4, 1.0e7, True, True), (5, 1.0e7, True, False)], "id long, price double, is_owner boolean, is_urgent boolean")
    peers = spark.createDataFrame([(i, 1.0e7, d) for i in (1, 2, 3, 4) for d in (40.0, 40.0, 5.0)], "id long, price double, days_seen double")
    got = {r.id: (r.market, r.discount, r.target) for r in economics.bargain(offers, peers).collect()}
    assert got[1] == ("cold", 1.0, 8910000) and got[2] == ("cold", 8.0, 9200000) and got[3] == ("cold", 20.0, 9700000)
    assert got[4] == ("cold", 11.0, 8900000) and got[5] == ("unknown", 0.0, None)


def test_sources_merge_along_chains_and_keep_the_richest(spark):
    rows = spark.createDataFrame([(1, "a", 1, 10, None), (2, "a", 1, 10, 7), (3, None, 1, 10, 7), (4, "z", 9, 9, 9), (5, None, None, None, None)], "k long, p string, q int, r int, s int")
    assert {r.k: r.kept for r in linking.merge_sources(rows, "k", ["p", "q", "r", "s"]).collect()} == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5}


def test_spans_without_episodes(spark):
    spans = spark.createDataFrame([(1, 0, 100), (2, 0, 10)], "k long, start long, end long")
    breaks = spark.createDataFrame([(1, 10, 20), (1, 15, 30), (1, 90, 200), (3, 0, 5)], "k long, start long, end long")
    assert sorted(map(tuple, economics.active_spans(spans, breaks, ["k"]).collect())) == [(1, 0, 10), (1, 30, 90), (2, 0, 10)]


def test_grouped_scores_order_what_can_be_told(spark):
    rows = spark.createDataFrame([(i, float(i % 2), i % 37, i % 2 + (i % 7) / 10.0, None if i % 5 else 1.0) for i in range(600)], "id long, label double, g long, x double, y double")
    scored = models.grouped_scores(rows, ["x", "y"], "g")
    assert scored.count() == 600 and scoring.auc(scored, "score", "label").first().auc > 0.99


def test_walkability_takes_the_nearest_on_foot(spark):
    rows = spark.createDataFrame([(1, "shop", i, 100.0, w) for i, w in enumerate([300.0, 190.0, None, 120.0, 500.0])], "place long, kind string, poi long, straight_m double, walked_m double")
    got = picks.walkability(rows, top=2).first()
    assert (got.n, got.nearest_m, got.mean_m, got.barrier) == (2, 120.0, 155.0, False)


def test_written_paths_can_be_discarded(spark):
    path = shared.new_path(spark, "scratch")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and shared.discard(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert shared.discard(spark) == 0


def test_class_share_keeps_buildings_whose_mean_differs_when_computed_again(spark):
    rows = spark.range(200).select((F.col("id") % 50).alias("k"), F.rand().alias("x")).groupBy("k").agg((F.avg("x") + F.expr("hash(uuid())") / 2.0**40).alias("p"))
    got = scoring.class_share(rows, "k", "p").collect()
    assert sorted(r.k for r in got) == list(range(50)) and sorted(r.share for r in got) == [2.0 * i for i in range(50)]
