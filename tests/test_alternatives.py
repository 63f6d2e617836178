"""Alternatives are told for every home, against brute force."""

import math
import random
from types import SimpleNamespace

from kadastra.plans import extra
from tests.test_growth import HOME, home


def test_every_home_is_asked_for(spark):
    draw = random.Random(9)
    homes = [home(i, float(draw.randrange(50)), area=float(draw.randrange(40, 60)), rooms=1 + i % 2, floor=draw.choice((1, 4, 9)), lat=51.128 + draw.randrange(30) / 900, lon=71.43 + draw.randrange(30) / 500, active=i % 11 != 0) for i in range(1, 500)]
    homes += [home(2000, None, area=None), home(2001, 5.0, floor=None), home(2002, 6.0, lat=None), home(2003, 7.0, rooms=None), home(2004, 3.0, rooms=9)]
    want, active = set(), [h for h in homes if h[9]]
    for q in active:
        if q[6] is None or q[3] is None:
            continue
        found = []
        for t in active:
            if t[0] != q[0] and t[3] == q[3] and t[6] is not None:
                d = math.sqrt(((q[6] - t[6]) * 111000) ** 2 + ((q[7] - t[7]) * math.cos(math.radians(q[6])) * 111000) ** 2)
                if d <= 700:
                    cheaper, larger = (None not in (t[k], q[k]) and a(t[k], q[k]) for k, a in ((1, float.__lt__), (2, float.__gt__)))
                    found.append((-(2 * cheaper + larger + (t[4] is not None and t[4] not in (1, 9))), round(d, 3), t[0]))
        want |= {(q[0], i, -p) for p, _, i in sorted(found)[:3]}
    told = extra.dm_buyer_alternatives(SimpleNamespace(listings=spark.createDataFrame(homes, HOME).repartition(3)))
    assert {tuple(r) for r in told.collect()} == want and any(q % 20 for q, _, _ in want)


def test_no_home_is_left_out_by_the_sql():
    assert "% 20" not in extra.ORACLE["dm_buyer_alternatives"]
