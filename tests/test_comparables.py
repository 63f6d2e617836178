"""Comparables by level, on fixtures."""

import datetime as dt

from kadastra.operators import comparables

OFFER = "id long, complex_id long, housing_class string, rooms int, area double, price double, lat double, lon double, last_seen timestamp"
STEP = 150.0 / 110_574.0  # from one hexagon of 100 m to the row above


def offer(i, *, house=None, cls="a", rooms=2, area=60.0, price=3e7, up=0, lat=51.128, seen=0):
    return (i, house, cls, rooms, area, price, None if lat is None else lat + up * STEP, 71.43, dt.datetime(2024, 1, 1) + dt.timedelta(days=seen))


def run(spark, rows, of):
    got = comparables.comparables(spark.createDataFrame(rows, OFFER), edge_m=100.0).filter(f"id = {of}").orderBy("place").collect()
    return {r.method for r in got}, [r.c_id for r in got]


def test_levels_in_their_order(spark):
    far = [offer(i, up=40 + i, seen=i) for i in range(100, 140)]
    me = [offer(1, house=7)]
    ring = [offer(i, cls="b", up=i % 2) for i in range(20, 25)]
    own_class = [offer(i, up=i % 2) for i in range(30, 35)]
    house = [offer(i, house=7, up=60, seen=-i) for i in range(40, 43)]
    assert run(spark, me + far, 1) == ({"city_segment"}, list(range(139, 109, -1)))
    assert run(spark, me + far + ring, 1) == ({"hex+ring"}, [20, 21, 22, 23, 24])
    assert run(spark, me + far + ring + own_class, 1) == ({"hex+ring+class"}, [30, 31, 32, 33, 34])
    assert run(spark, me + far + ring + own_class[:4], 1)[0] == {"hex+ring"}
    assert run(spark, me + far + ring + own_class + house, 1) == ({"same_complex"}, [40, 41, 42])
    assert run(spark, me + far + ring + own_class + house[:2], 1)[0] == {"hex+ring+class"}


def test_what_does_not_count(spark):
    me = [offer(1, house=7, cls=None)]
    no = [offer(2, house=7, rooms=3), offer(3, house=7, area=69.1), offer(4, house=7, area=50.9), offer(5, house=7, price=0.0), offer(6, house=7, price=2e8), offer(7, house=7, up=2)]
    assert run(spark, me + no, 1) == ({"city_segment"}, [7])
    near = [offer(i, cls=None) for i in range(10, 15)]
    assert run(spark, me + near, 1)[0] == {"hex+ring"}  # an unknown class is no class
    assert run(spark, [offer(1, lat=None)] + near, 1)[0] == {"city_segment"}
    assert run(spark, me, 1) == (set(), []) and run(spark, [], 1) == (set(), [])


def test_newest_of_every_area_in_the_window(spark):
    rows = [offer(i, up=3 * i, area=52.0 + i % 17, seen=i) for i in range(1, 200)]
    got = run(spark, rows, 100)
    mine = 52.0 + 100 % 17
    want = [i for i in range(199, 0, -1) if i != 100 and mine * 0.85 <= 52.0 + i % 17 <= mine * 1.15][:30]
    assert got == ({"city_segment"}, want)


def test_arrays_carry_what_the_rows_tell(spark):
    rows = [offer(i, house=7, area=60.0 + i % 3, price=1e6 * i, seen=i // 2) for i in range(1, 120)]
    of = spark.createDataFrame(rows, OFFER)
    got = {r.id: r for r in comparables.answered(of, 100.0, of.price / 1e6).collect()}
    assert len(got) == 119
    for i in (1, 60, 119):
        want = sorted((c for c in range(1, 120) if c != i), key=lambda c: (-(c // 2), c))[:30]
        assert got[i].method == "same_complex" and [(f.c_id, f.value) for f in got[i].found] == [(c, float(c)) for c in want]
