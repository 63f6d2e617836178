"""Joins by place or name on many rows that share one: they are answered together. Paired one by one, each of these would take billions of pairs."""

import math
import time

import pytest
from pyspark.sql import functions as F

from kadastra.operators import audits, economics, linking, picks, relational

MANY = 60_000
i = lambda: F.col("id")


@pytest.fixture(autouse=True)
def soon():
    began = time.monotonic()
    yield
    assert time.monotonic() - began < 100


def left(spark, lat=51.0):
    return spark.range(MANY).select(i().alias("l_id"), F.lit(lat).alias("l_lat"), F.lit(71.0).alias("l_lon"))


def right(spark, *more):
    return spark.range(MANY).select(i().alias("r_id"), F.lit(51.0).alias("r_lat"), F.when(i() == 7, 71.001).otherwise(71.0).alias("r_lon"), *more)


def test_nearest_of_copies(spark):
    got = relational.nearest_within(left(spark), right(spark), 500, 0.01, 3)
    assert got.groupBy("rank", "r_id").count().orderBy("rank").collect() == [(1, 0, MANY), (2, 1, MANY), (3, 2, MANY)]
    assert relational.nearest_within(left(spark, 52.0), right(spark), 500, 0.01, 3).isEmpty()


def test_margin_sees_the_second_copy(spark):
    near = lambda r: relational.nearest_with_margin(relational.nearest_within(left(spark), r, 800, 0.015, 2), 300, 15).count()
    assert near(right(spark)) == 0
    assert near(right(spark).filter("r_id in (3, 7)")) == MANY


def test_location_factors_count_copies(spark):
    got = picks.location_factors(left(spark), right(spark, F.lit("park").alias("kind")), {"park": (500.0, 0.001, 1e9)}, 0.01)
    far = (1 - 0.001 * math.cos(math.radians(51.0)) * 111_000 / 500) * 0.001
    assert got.groupBy("park").count().collect() == [(round((MANY - 1) * 0.001 + far, 6), MANY)]


def test_transport_score_of_copies(spark):
    got = economics.transport_score(left(spark), right(spark, F.lit("bus").alias("kind"), (i() % 3).alias("route")), 0.016)
    assert got.groupBy("score", "routes").count().collect() == [(0.65, 3, MANY)]


def test_street_audit_of_one_name(spark):
    complexes = spark.range(MANY).select("id", F.lit("Abay Park").alias("name"), F.lit(False).alias("is_street"), (i() == 5).alias("card"), F.lit(False).alias("other_card"))
    listings = spark.range(MANY).select(F.lit("abay park").alias("complex_name"), F.when(i() % 4 == 0, "other").otherwise("abay park 5").alias("address"))
    got = audits.street_audit(complexes, listings)
    assert got.groupBy("listings", "street_hits", "share", "reason").count().collect() == [(MANY, MANY * 3 // 4, 0.75, "street", MANY - 1)]


def test_binding_by_place_of_copies(spark):
    at = [F.lit(51.0).alias("lat"), F.lit(71.0).alias("lon")]
    none = [F.lit(None).cast("string").alias(c) for c in ("house", "url_key", "name_key")]
    got = linking.propose_bindings(spark.range(MANY).select("id", (i() % 2).alias("bound"), *none, *at), spark.range(1, MANY).select(i().alias("complex_id"), *none, *at))
    assert sorted(got.groupBy("proposed", "method", "transition").count().collect()) == [(1, "geo", "change", MANY // 2), (1, "geo", "keep", MANY // 2)]


LISTING = "id long, umbrella long, number long, text string, lat double, lon double"
HOUSE = "house_id long, umbrella long, number long, token string, lat double, lon double"


def test_houses_of_a_large_umbrella(spark):
    place = lambda k: (51 + k % 1000 / 10_000, 71.0 + k * 0)
    lat, lon = place(i())
    rows = spark.range(MANY).select("id", F.lit(1).cast("long").alias("umbrella"), F.when(i() % 3 == 0, i() % 5).alias("number"), F.lit("tower b9").alias("text"), lat.alias("lat"), lon.alias("lon"))
    houses = spark.range(MANY).select(i().alias("house_id"), F.lit(1).cast("long").alias("umbrella"), (i() % 5).alias("number"), F.lit("b9").alias("token"), lat.alias("lat"), lon.alias("lon"))
    got = linking.resolve_houses(rows, houses).groupBy("method").agg(F.count("*").alias("n"), F.max("house_id").alias("last"))
    assert sorted(got.collect()) == [("nearest", MANY * 2 // 3, 999), ("number+nearest", MANY // 3, 999)]


def test_the_nearest_house_may_lie_far_or_nowhere(spark):
    houses = [(1, 1, 4, "a", 51.0, 71.0), (2, 1, 4, "b", 51.0, 71.5), (3, 1, 5, "c", -40.0, -70.0), (4, 2, 1, "d", None, None), (5, 2, 1, "d", None, None), (6, 3, None, None, 51.0, 71.0), (0, 3, None, None, 51.0, 71.0)]
    rows = [(1, 1, 4, "", 51.0, 71.24), (2, 1, 4, "", 51.0, 71.26), (3, 1, 9, "x c", 51.0, 71.0), (4, 1, 9, "a b", -41.0, 80.0), (5, 1, 4, "", None, None), (6, 2, 1, "", 51.0, 71.0), (7, 2, None, "d", 51.0, 71.0), (8, 3, 4, None, 51.01, 71.0), (9, 9, 4, "a", 51.0, 71.0), (10, None, 4, "a", 51.0, 71.0), (11, 1, 5, "a", 51.0, 71.0)]
    got = {r.id: (r.house_id, r.method) for r in linking.resolve_houses(spark.createDataFrame(rows, LISTING), spark.createDataFrame(houses, HOUSE)).collect()}
    assert got == {1: (1, "number+nearest"), 2: (2, "number+nearest"), 3: (3, "token"), 4: (2, "nearest"), 5: (1, "number+nearest"), 6: (4, "number+nearest"), 7: (None, None), 8: (0, "nearest"), 9: (None, None), 10: (None, None), 11: (3, "number")}


def test_rental_picks_of_one_large_class(spark):
    rows = spark.range(MANY).select("id", F.lit(1).cast("long").alias("complex_id"), F.lit("d").alias("district"), F.lit(2).alias("rooms"), F.lit(50.0).alias("area"), F.when(i() < 2, 80.0 + i()).otherwise(100.0 + i() % 3).alias("rent"))
    got = picks.rental_picks(rows, most_rent=1e9).collect()
    assert [(r.id, r.peers, r.level, r.reference, r.discount) for r in got] == [(0, MANY - 1, "complex", 2.02, 20.8), (1, MANY - 1, "complex", 2.02, 19.8)]
