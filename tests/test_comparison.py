"""Rental picks against their peers, and new against resale offers in nested hexagons, on fixtures."""

import pytest

from kadastra.operators import comparison, picks

OFFER = "id long, complex_id long, district string, rooms int, area double, rent double"


def pick(spark, rows, **more):
    return {r.id: r for r in picks.rental_picks(spark.createDataFrame(rows, OFFER), most_rent=more.pop("most_rent", 1e9), **more).collect()}


def test_own_rent_is_not_in_the_reference(spark):
    rents = [80.0, 100.0, 100.0, 104.0, 110.0, 112.0]
    got = pick(spark, [(i, 1, None, 2, 10.0, r * 10) for i, r in enumerate(rents)])
    assert set(got) == {0} and got[0].reference == 104.0 and got[0].peers == 5
    assert got[0].discount == pytest.approx(23.1)  # with its own rent the median would be 102


def test_peers_have_about_the_area_and_as_many_rooms(spark):
    rows = [(i, 1, None, 2, 100.0, 10_000.0) for i in range(1, 5)] + [(5, 1, None, 2, 116.0, 11_600.0), (6, 1, None, 3, 100.0, 10_000.0), (0, 1, None, 2, 100.0, 8_000.0)]
    assert pick(spark, rows) == {}  # four peers
    assert set(pick(spark, rows + [(7, 1, None, 2, 114.9, 11_490.0)])) == {0}


def test_district_stands_in_from_ten_peers_on(spark):
    rows = [(i, i, "d", 2, 50.0, 5_000.0) for i in range(1, 10)] + [(0, 77, "d", 2, 50.0, 4_000.0)]
    assert pick(spark, rows) == {}
    got = pick(spark, rows + [(10, 77, "d", 2, 50.0, 5_000.0)])
    assert (got[0].level, got[0].peers, got[0].discount) == ("district", 10, 20.0)


def test_scattered_peers_dear_offers_and_the_limit(spark):
    wild = [(i, 1, None, 2, 10.0, r) for i, r in enumerate([800.0, 400.0, 1000.0, 1000.0, 1900.0, 2000.0, 1000.0, 1950.0])]
    assert 0 not in pick(spark, wild)
    calm = [(i, 1, None, 2, 10.0, 1000.0) for i in range(10, 20)] + [(i, 1, None, 2, 10.0, 800.0 - i) for i in range(3)]
    assert list(pick(spark, calm, limit=2)) == [2, 1]
    assert pick(spark, calm, most_rent=799.0, limit=5).keys() == {1, 2}


KINDS = "market string, rooms int, area double, price double, complex_id long, q long, r long"
QUERY = "query int, rooms int, area double, q long, r long"


def at(market, ppm2, q=0, r=0, rooms=2, area=60.0, house=1):
    return (market, rooms, area, ppm2 * area, house, q, r)


def run(spark, offers, queries):
    got = comparison.compare(spark.createDataFrame(offers, KINDS), spark.createDataFrame(queries, QUERY)).collect()
    return {(r["query"], r.scope): r for r in got}


def test_scopes_widen_until_a_sample_suffices(spark):
    offers = [at("primary", 90.0, q=i) for i in range(6)] + [at("secondary", 100.0, q=i) for i in range(6)] + [at("primary", 50.0, rooms=3), at("secondary", 300.0, area=69.1)]
    got = run(spark, offers, [(1, 2, 60.0, 0, 0)])
    assert [got[1, s].status for s in comparison.RADII] == ["unsure_places", "unsure_places", "unsure_places", "comparable", "comparable", "comparable"]
    assert [got[1, s].primary_n for s in comparison.RADII] == [1, 2, 3, 5, 6, 6]
    assert got[1, "ring4"].delta_pct == 10.0 and got[1, "ring2"].delta_pct is None and got[1, "city"].primary_median == 90.0


def test_few_and_scattered(spark):
    few = run(spark, [at("secondary", 100.0)] * 9 + [at("primary", 90.0, q=3)] * 4, [(1, 2, 60.0, 0, 0)])
    assert [few[1, s].status for s in comparison.RADII] == ["too_few"] * 6
    wild = run(spark, [at("secondary", p) for p in (50.0, 60.0, 100.0, 150.0, 190.0)] + [at("primary", 90.0)] * 5, [(1, 2, 60.0, 0, 0)])
    assert wild[1, "city"].status == "too_scattered" and wild[1, "city"].secondary_spread == pytest.approx(0.9)


def test_centre_has_most_pairs(spark):
    offers = [at("primary", 90.0, q=5, r=5), at("secondary", 90.0, q=5, r=5)] * 2 + [at("primary", 90.0, q=9)] * 9 + [at("secondary", 90.0, q=20)] * 9
    assert (run(spark, offers, [(1, 2, 60.0, None, None)])[1, "hex"].q, run(spark, offers, [(1, 2, 60.0, 20, 0)])[1, "hex"].q) == (5, 20)
    assert run(spark, offers, [(1, 6, 60.0, None, None)])[1, "city"].status == "too_few"
