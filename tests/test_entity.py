"""Records that may be one building, and the rental index over scopes, on fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kadastra.operators import entity, rental_index

RECORD = "id long, name string, lat double, lon double, developer string, address string"


def record(i, name, lat=None, lon=None, developer=None, address=None):
    return (i, name, lat, lon, developer, address)


def scores(spark, left, right):
    got = entity.resolve(spark.createDataFrame(left, RECORD), spark.createDataFrame(right, RECORD)).collect()
    return {(r.a, r.b): (r.confidence, r.method) for r in got}


def test_signals_add_up(spark):
    left = [record(1, "Green Park", 51.0, 71.0, "d", "abay street 5")]
    right = [
        record(10, "green park"),
        record(11, "Green Park", 51.001, 71.0),
        record(12, "Green Park", 51.002, 71.0, "d"),
        record(13, "Green Park", 51.0, 71.0, "d", "Abay Street 5"),
        record(14, "Green Parks"),
        record(15, "River Side", 51.0, 71.0, "d", "abay street 5"),
    ]
    got = scores(spark, left, right)
    assert got[1, 10] == (0.6, "name_exact") and got[1, 11] == (0.85, "name_exact+geo") and got[1, 12] == (0.75, "name_exact+developer")
    assert got[1, 13] == (1.0, "name_exact+geo+developer+address")
    assert got[1, 14][1] == "name_fuzzy" and 0.35 < got[1, 14][0] < 0.6
    assert (1, 15) not in got


def test_latin_letters_stand_in(spark):
    assert scores(spark, [record(1, "Сарыарка")], [record(2, "saryarka")])[1, 2] == (0.6, "name_exact_translit")


def test_phases_and_product_lines(spark):
    at = {"lat": 51.0, "lon": 71.0, "developer": "d", "address": "abay 5"}
    left = [record(1, "Green Park 2", **at), record(2, "Green Park", **at), record(3, "Emerald Green Park lux", **at)]
    right = [record(10, "Green Park 2", **at), record(11, "Green Park 3", **at), record(12, "Green Park 1", **at), record(13, "Emerald Green Park smart", **at)]
    got = scores(spark, left, right)
    assert got[1, 10] == (1.0, "name_exact+geo+developer+address+phase")
    assert got[1, 11][0] == 0.79 and got[1, 11][1].endswith("phase_mismatch")
    assert got[2, 12][1].endswith("+phase") and got[2, 12][0] > 0.79  # no phase says the first
    assert got[2, 10][0] == 0.79
    assert got[3, 13][0] == 0.79 and got[3, 13][1].endswith("product_mismatch")


OBSERVED = "id long, city string, district string, complex_id long, hex_id string, rooms int, rent_period string, furnishing string, price double, area double, observed_at timestamp"
LIVE = OBSERVED.replace("observed_at timestamp", "last_seen timestamp, episode_started timestamp, episode_last_seen timestamp")
GONE = OBSERVED.replace("observed_at timestamp", "first_proof timestamp, last_proof timestamp, proofs int, episode_started timestamp, episode_last_seen timestamp, archived_at timestamp")
NOW = dt.datetime(2024, 6, 1)


def ago(days=0.0):
    return NOW - dt.timedelta(days=days)


def flat(i, *times, price=100.0, period="daily", furnishing=None, house=7, area=50.0, district="d"):
    return (i, "a", district, house, None, 2, period, furnishing, price, area, *times)


def index(spark, observed=(), live=(), gone=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    got = rental_index.build(frame(observed, OBSERVED), frame(live, LIVE), frame(gone, GONE), F.lit("2024-06-01 00:00:00").cast("timestamp")).collect()
    return {(r.scope, r.name, r.rent_period, r.furnishing): r for r in got}


def test_first_window_that_suffices(spark):
    live = [flat(100, ago(1), ago(9), None)]
    near = [flat(i, ago(i), price=100.0 + i) for i in range(1, 6)]
    far = [flat(i, ago(40 + i), price=500.0) for i in range(6, 12)]
    got = index(spark, near + far, live)
    complex_ = got["complex", "7", "daily", None]
    assert (complex_.window_days, complex_.sample_count, complex_.median_price, complex_.p25_price, complex_.active_supply) == (30, 5, 103, 102, 1)
    district = got["district", "d", "daily", None]
    assert (district.window_days, district.sample_count) == (90, 11) and set(k[0] for k in got) == {"complex", "district", "city"}
    assert index(spark, near, live).keys() == {("complex", "7", "daily", None)}
    assert index(spark, near + far) == {}  # nothing is active
    assert index(spark, [flat(i, ago(4)) for i in range(5)], live) == {}  # nothing is fresh


def test_last_observation_alone_counts(spark):
    live = [flat(1, ago(0.5), ago(9), ago(1), price=900.0)]
    old = [flat(1, ago(2), price=100.0), flat(1, ago(3), price=1.0)] + [flat(i, ago(2), price=200.0 + i) for i in range(2, 6)]
    got = index(spark, old, live)["complex", "7", "daily", None]
    assert got.sample_count == 5 and got.p75_price == 205 and got.avg_price == (900 + 202 + 203 + 204 + 205) // 5


def test_monthly_rents_furnishing_and_removals(spark):
    live = [flat(i, ago(1), None, None, period="monthly", furnishing="full" if i < 5 else None, price=1000.0 * i, area=10.0 if i == 1 else 50.0) for i in range(6)] + [flat(9, ago(4), None, None, period="monthly")]
    gone = [flat(i, ago(20), ago(11), 2, ago(25), ago(10), ago(10), period="monthly") for i in range(20, 25)]
    bad = [flat(30, ago(20), ago(11), 1, ago(25), ago(10), ago(10), period="monthly"), flat(31, ago(11), ago(11), 2, ago(25), ago(10), ago(10), period="monthly"), flat(32, ago(20), ago(14), 2, ago(25), ago(10), ago(10), period="monthly"), flat(33, ago(50), ago(32), 2, ago(60), ago(31), ago(31), period="monthly")]
    got = index(spark, [], live, gone + bad)
    every, full = got["complex", "7", "monthly", None], got["complex", "7", "monthly", "full"]
    assert (every.sample_count, every.active_supply, every.gone_30d, every.median_dom_days, every.months_of_supply) == (6, 6, 5, 10.0, 1.2)
    assert (full.sample_count, full.gone_30d, full.months_of_supply) == (5, None, None)
    assert every.price_per_sqm == 60 and every.median_price == 2500


def test_empty_index(spark):
    assert index(spark) == {}


def test_names_are_compared_once(spark, monkeypatch):
    met, found = [], entity.candidates

    def watched(left, right):
        met.append((left.count(), right.count()))
        return found(left, right)

    monkeypatch.setattr(entity, "candidates", watched)
    schema = "id long, name string, lat double, lon double, developer int, address string"
    rows = lambda ids: spark.createDataFrame([(i, "lux large ring", 51.0, 71.0, i % 2, None) for i in ids], schema)
    got = {(r.a, r.b): (r.confidence, r.method) for r in entity.resolve(rows(range(8)), rows(range(10, 16))).collect()}
    assert met == [(1, 1)] and len(got) == 48
    assert got[0, 10] == (1.0, "name_exact+geo+developer+product") and got[0, 11] == (0.95, "name_exact+geo+product")
