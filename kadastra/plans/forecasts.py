"""Scenarios, selections and location as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kadastra.operators import market, scenario
from kadastra.plans.book import Book
from kadastra.plans.dashboards import BASE_SQL, NOW
from kadastra.sources.market import as_of

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

@book.query(
    "dm_isotonic",
    """WITH c AS (SELECT p_brand, p_size // 10 AS i, avg(p_retailprice) AS v, CAST(count(*) AS DOUBLE) AS w FROM part GROUP BY 1, 2),
 m AS (SELECT p.p_brand, p.i, a.i AS a, b.i AS b, sum(c.v * c.w) / sum(c.w) AS m FROM c p JOIN c a ON a.p_brand = p.p_brand AND a.i <= p.i JOIN c b ON b.p_brand = p.p_brand AND b.i >= p.i JOIN c ON c.p_brand = p.p_brand AND c.i BETWEEN a.i AND b.i GROUP BY 1, 2, 3, 4)
 SELECT p_brand, CAST(i AS BIGINT) AS i, round(max(m), 6) AS fitted FROM (SELECT p_brand, i, a, min(m) AS m FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def dm_isotonic(m):
    c = m.part.groupBy("p_brand", F.floor(F.col("p_size") / 10).alias("i")).agg(F.avg("p_retailprice").alias("v"), F.count(F.lit(1)).cast("double").alias("w"))
    c = c.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("i", "v", "w"))).alias("p"))  # six sizes at most
    fitted = scenario.isotonic(F.col("p.v"), F.col("p.w"))
    return c.select("p_brand", F.explode(F.arrays_zip(F.col("p.i").alias("i"), fitted.alias("f"))).alias("z")).select("p_brand", F.col("z.i").alias("i"), F.round("z.f", 6).alias("fitted"))


def _interp_sql(x):
    k = f"len(list_filter(xs, lambda z: z <= {x}))"
    return f"(CASE WHEN {k} = 0 THEN ys[1] WHEN {k} = len(xs) THEN ys[len(xs)] ELSE ys[greatest({k}, 1)] + (ys[least({k} + 1, len(xs))] - ys[greatest({k}, 1)]) * ({x} - xs[greatest({k}, 1)]) / nullif(xs[least({k} + 1, len(xs))] - xs[greatest({k}, 1)], 0) END)"


_D = scenario.DISCOUNTS
_CLAMP = lambda c: f"greatest(3.0::DOUBLE, least(180.0::DOUBLE, {c}))"
_PRICE = lambda p: f"round_even(price * {1 - p / 100}::DOUBLE, 0)"


@book.query(
    "dm_dom_scenarios",
    f"""{BASE_SQL}, k AS (SELECT id, price, area, price / area AS ppm2, district, rooms, least(rooms, 4) AS bu, greatest(0.5::DOUBLE, floor((epoch_us(coalesce(archived_at, {NOW})) - epoch_us(first_seen)) / 86400000000.0::DOUBLE)) AS t, archived_at IS NOT NULL AS e FROM base WHERE price > 0 AND area > 0 AND district IS NOT NULL),
 l AS (SELECT *, 1 AS level, '1|' || district || '|' || rooms AS seg FROM k UNION ALL SELECT *, 2, '2|' || district || '|' || bu FROM k UNION ALL SELECT *, 3, '3|' || bu FROM k UNION ALL SELECT *, 4, '4' FROM k),
 s AS (SELECT seg, count(*) AS n, count(*) FILTER (WHERE e) AS ev FROM l GROUP BY 1),
 g AS (SELECT seg, t, count(*) FILTER (WHERE e) AS d, count(*) AS m FROM l GROUP BY 1, 2), ar AS (SELECT *, sum(m) OVER (PARTITION BY seg ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS nr FROM g),
 km AS (SELECT seg, t, CASE WHEN max(CASE WHEN d = nr THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < nr THEN ln(1 - CAST(d AS DOUBLE) / nr) ELSE 0 END) OVER w) END AS sv FROM ar WHERE d > 0 WINDOW w AS (PARTITION BY seg ORDER BY t ROWS UNBOUNDED PRECEDING)),
 q AS (SELECT seg, min(t) FILTER (WHERE sv <= 0.75::DOUBLE) AS q75, min(t) FILTER (WHERE sv <= 0.25::DOUBLE) AS q25 FROM km GROUP BY 1),
 pl AS (SELECT l.*, n, ev, row_number() OVER (PARTITION BY l.seg ORDER BY ppm2, id) - 1 AS pos, row_number() OVER (PARTITION BY l.seg, e ORDER BY ppm2, id) - 1 AS att, row_number() OVER (PARTITION BY l.seg, e ORDER BY t, id) - 1 AS tpos FROM l JOIN s USING (seg)),
 md AS (SELECT seg, ppm2 AS med FROM pl WHERE pos = n // 2), mi AS (SELECT seg, t AS mid FROM pl WHERE e AND tpos = ev // 2),
 ex AS (SELECT *, greatest(1, ev // least(5, greatest(2, ev // 5))) AS sz FROM pl WHERE e AND ev >= 6), ey AS (SELECT *, CAST(ceil(ev / sz) AS BIGINT) AS ch FROM ex),
 ez AS (SELECT *, least(att // sz, ch - 1 - CASE WHEN ev - (ch - 1) * sz < sz / 2 AND ch > 1 THEN 1 ELSE 0 END) AS bk FROM ey),
 ew AS (SELECT *, count(*) OVER (PARTITION BY seg, bk) AS ln, row_number() OVER (PARTITION BY seg, bk ORDER BY t, id) - 1 AS tb FROM ez),
 pt AS (SELECT seg, bk, max(CASE WHEN att - bk * sz = ln // 2 THEN ppm2 END) AS xp, max(CASE WHEN tb = ln // 2 THEN t END) AS v, CAST(max(ln) AS DOUBLE) AS w FROM ew GROUP BY 1, 2),
 pm AS (SELECT p.seg, p.bk, a.bk AS a, b.bk AS b, sum(c.v * c.w) / sum(c.w) AS m FROM pt p JOIN pt a ON a.seg = p.seg AND a.bk <= p.bk JOIN pt b ON b.seg = p.seg AND b.bk >= p.bk JOIN pt c ON c.seg = p.seg AND c.bk BETWEEN a.bk AND b.bk GROUP BY 1, 2, 3, 4),
 fi AS (SELECT seg, bk, max(m) AS y FROM (SELECT seg, bk, a, min(m) AS m FROM pm GROUP BY 1, 2, 3) GROUP BY 1, 2),
 cv AS (SELECT seg, list(ln(xp) - ln(med) ORDER BY bk) AS xs, list(y ORDER BY bk) AS ys FROM pt JOIN fi USING (seg, bk) JOIN md USING (seg) GROUP BY 1 HAVING count(*) >= 2),
 b0 AS (SELECT l.id, l.price, l.area, l.ppm2, level, n, ev, med, mid, q75, q25, xs, ys FROM l JOIN s USING (seg) JOIN md USING (seg) LEFT JOIN mi USING (seg) LEFT JOIN q USING (seg) LEFT JOIN cv USING (seg) WHERE NOT e AND (ev >= 5 OR level = 4) QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY level) = 1),
 b1 AS (SELECT *, ev >= 8 AND q75 IS NOT NULL AND q25 IS NOT NULL AS km FROM b0 WHERE n >= 3 AND ev > 0),
 b2 AS (SELECT *, {_CLAMP('CASE WHEN km THEN q75 ELSE mid * 0.75::DOUBLE END')} AS low0, {_CLAMP('CASE WHEN km THEN greatest(q25, q75) ELSE mid * 1.35::DOUBLE END')} AS high0, {_interp_sql('(ln(ppm2) - ln(med))')} AS cur FROM b1),
 b3 AS (SELECT *, {", ".join(f"coalesce(CASE WHEN cur > 0 THEN {_interp_sql(f'(ln({_PRICE(p)} / area) - ln(med))')} / cur END, 1) AS f{i}" for i, p in enumerate(_D))} FROM b2),
 b4 AS (SELECT *, {", ".join(f"{_CLAMP(f'low0 * f{i}')} AS l{i}, {_CLAMP(f'high0 * f{i}')} AS h{i}" for i in range(len(_D)))} FROM b3),
 b5 AS (SELECT *, {", ".join(f"CAST(round_even(least({', '.join(f'h{j}' for j in range(i + 1))}), 0) AS INTEGER) AS hh{i}, CAST(round_even(least({', '.join(f'l{j}, h{j}' for j in range(i + 1))}), 0) AS INTEGER) AS ll{i}" for i in range(len(_D)))} FROM b4),
 b6 AS (SELECT *, {" AND ".join(f"ll{i} = ll0 AND hh{i} = hh0" for i in range(1, len(_D)))} AS flat FROM b5),
 r AS ({" UNION ALL ".join(f"SELECT id, {p} AS discount, {_PRICE(p)} AS price, flat, ll{i} AS ll, hh{i} AS hh, CAST(greatest(3, floor(ll0 * {max(0.70, 1 - 0.03 * p)}::DOUBLE + 0.5)) AS INTEGER) AS fl, CAST(floor(hh0 * {max(0.70, 1 - 0.03 * p)}::DOUBLE + 0.5) AS INTEGER) AS fh, level, km, ev FROM b6" for i, p in enumerate(_D))})
 SELECT id, discount, price, CASE WHEN flat THEN fl ELSE ll END AS days_low, CASE WHEN flat THEN CASE WHEN fh <= fl THEN fl + 1 ELSE fh END ELSE hh END AS days_high, ['district_rooms', 'district_rooms_bucket', 'city_rooms_bucket', 'city'][level] AS level,
  CASE WHEN km THEN 'survival' ELSE 'median' END AS method, CASE WHEN flat THEN 'line' ELSE 'curve' END AS mode, CASE WHEN NOT km THEN 'low' WHEN level = 1 AND ev >= 15 THEN 'sufficient' WHEN level <= 2 AND ev >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM r""",
)
def dm_dom_scenarios(m):
    return scenario.dom_scenarios(market.base(m.listings), as_of())
