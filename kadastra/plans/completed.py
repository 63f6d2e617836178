"""Operators of money, reputation, transport and upkeep in full, as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.functions.stats import days
from kadastra.operators import economics, market
from kadastra.plans.book import Book
from kadastra.plans.dashboards import BASE_SQL, NOW
from kadastra.shared import new_path
from kadastra.sources.market import LISTINGS_SQL, as_of

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
L = f"WITH {LISTINGS_SQL}"


@book.query(
    "dm_bargain_ladder",
    f"""{BASE_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY complex_id, rooms4 ORDER BY id) AS n FROM base WHERE active AND price > 0),
 c AS (SELECT t.id, c.price, (epoch_us(c.last_seen) - epoch_us(c.first_seen)) / 86400000000.0::DOUBLE AS d FROM a t JOIN a c ON t.complex_id = c.complex_id AND t.rooms4 = c.rooms4 AND c.n <> t.n AND abs(c.n - t.n) <= 15),
 p AS (SELECT id AS pid, count(*) AS n, CAST(floor(quantile_cont(price, 0.5)) AS BIGINT) AS median, min(price) AS least, avg(CASE WHEN d >= 30 THEN 1.0::DOUBLE ELSE 0 END) AS old FROM c GROUP BY 1),
 x AS (SELECT a.id, price, id % 3 = 0 AS own, id % 10 = 0 AS urg, p.n, median, least, old, CASE WHEN old > 0.5 THEN 0.08::DOUBLE WHEN old > 0.25 THEN 0.05 ELSE 0.02 END AS b, price / nullif(median, 0) AS r FROM a LEFT JOIN p ON pid = a.id),
 y AS (SELECT *, CASE WHEN r < 0.93::DOUBLE THEN 1.0::DOUBLE WHEN r < 1.10::DOUBLE THEN b * 100 ELSE least((r - 1) * 100 + b * 100, 20) END AS d0, CAST(CASE WHEN r < 0.93::DOUBLE THEN floor(price * 0.99::DOUBLE) WHEN r < 1.10::DOUBLE THEN floor(price * (1 - b)) ELSE floor(median * 0.97::DOUBLE) END AS BIGINT) AS t0 FROM x),
 z AS (SELECT *, CASE WHEN own THEN d0 ELSE least(d0 + 1, 20) END AS d1, greatest(t0 - 20000, CAST(floor(price * 0.5::DOUBLE) AS BIGINT)) AS t1 FROM y)
 SELECT id, coalesce(n, 0) AS n, median, least, CASE WHEN n IS NULL THEN 'unknown' WHEN old > 0.5 THEN 'cold' WHEN old > 0.25 THEN 'normal' ELSE 'hot' END AS market, CASE WHEN r IS NULL THEN 0 ELSE round(CASE WHEN urg THEN (1 - t1 / price) * 100 ELSE d1 END, 1) END AS discount, CASE WHEN r IS NOT NULL THEN CASE WHEN urg THEN t1 ELSE t0 END END AS target FROM z""",
)
def dm_bargain_ladder(m):
    """Peers are the 15 ids before and after in the same building with as many rooms."""
    rows = market.base(m.listings).filter(market.status_condition("active")).filter("price > 0")
    w = Window.partitionBy("complex_id", market.rooms_bucket()).orderBy("id")
    peer = F.struct("id", "price", days(F.col("last_seen"), F.col("first_seen")).alias("d"))
    around = rows.select("id", F.collect_list(peer).over(w.rowsBetween(-15, -1)).alias("before"), F.collect_list(peer).over(w.rowsBetween(1, 15)).alias("after"))
    peers = around.select("id", F.explode(F.concat("before", "after")).alias("c")).select("id", "c.price", F.col("c.d").alias("days_seen"))
    offers = rows.select("id", "price", (F.col("id") % 3 == 0).alias("is_owner"), (F.col("id") % 10 == 0).alias("is_urgent"))
    return economics.bargain(offers, peers, urgent_bonus=20_000)


@book.query(
    "dm_sublease_economics",
    """WITH r AS (SELECT p_partkey AS id, p_retailprice * 100 AS rent, p_size * 300.0::DOUBLE AS nightly, CASE WHEN p_partkey % 2 = 0 THEN 400000.0::DOUBLE ELSE 0 END AS capex FROM part), o AS (SELECT *, unnest([0.45::DOUBLE, 0.60::DOUBLE, 0.75::DOUBLE]) AS occupancy FROM r),
 x AS (SELECT *, occupancy * 30.4::DOUBLE AS ng, rent + 25000 + capex / 24 AS fx, nightly * (1 - 0.15::DOUBLE - 0.03::DOUBLE) - 500 - 4000 / 3.0::DOUBLE AS pn FROM o),
 y AS (SELECT *, nightly * ng AS rv, ng / 3.0::DOUBLE * 4000 + ng * 500 + nightly * ng * (0.15::DOUBLE + 0.03::DOUBLE) AS vr FROM x)
 SELECT id, occupancy, round(rv, 2) AS revenue, round(vr + fx, 2) AS costs, round(rv - vr - fx, 2) AS margin, CASE WHEN pn > 0 THEN round(fx / (pn * 30.4::DOUBLE), 6) END AS breakeven, round(rent * 2 + capex, 2) AS startup, CASE WHEN rv - vr - fx > 0 THEN round((rent * 2 + capex) / (rv - vr - fx), 1) END AS payback FROM y""",
)
def dm_sublease_economics(m):
    k = F.col("p_partkey")
    values = {"cleaning": 4000.0, "stay": 3.0, "consumables": 500.0, "fee": 0.15, "tax": 0.03, "utilities": 25000.0, "capex_months": 24.0, "deposit_months": 1.0}
    rows = m.part.select(k.alias("id"), (F.col("p_retailprice") * 100).alias("rent"), (F.col("p_size") * 300.0).alias("nightly"), F.when(k % 2 == 0, 400000.0).otherwise(0.0).alias("capex"), *[F.lit(v).alias(c) for c, v in values.items()])
    return economics.sublease(rows)


@book.query(
    "dm_deposit_against_flat",
    "WITH r AS (SELECT o_orderkey AS id, o_totalprice AS p, o_totalprice * 0.006::DOUBLE AS rent, 8.0::DOUBLE + o_orderkey % 8 AS rate, CAST(o_orderkey % 11 AS DOUBLE) AS g FROM orders), x AS (SELECT *, p * power(1 + rate / 1200, 12) AS d, p * (1 + g / 100) + rent * 12 AS f FROM r) SELECT id, round(d, 2) AS deposit, round(f, 2) AS flat, round(f - d, 2) AS difference, round(((d - rent * 12) / nullif(p, 0) - 1) * 100, 4) AS breakeven_growth FROM x",
)
def dm_deposit_against_flat(m):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return economics.deposit_against(m.orders.select(k.alias("id"), p.alias("price"), (p * 0.006).alias("rent"), (F.lit(8.0) + k % 8).alias("rate"), (k % 11).cast("double").alias("growth")))


_TRUST = {"R": 1.0, "A": 0.8}


@book.query(
    "dm_reputation_trust",
    f"""WITH r AS (SELECT l_suppkey, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_linenumber % 3 - 1 END AS s, CASE WHEN l_linenumber <> 4 THEN CAST(l_shipdate AS DATE) END AS d, l_returnflag AS src, l_discount > 0.09 AS spam FROM lineitem),
 w AS (SELECT *, CASE WHEN d IS NULL THEN 0.7::DOUBLE WHEN date_diff('day', d, CAST({NOW} AS DATE)) <= 90 THEN 1.0 WHEN date_diff('day', d, CAST({NOW} AS DATE)) <= 365 THEN 0.6 ELSE 0.3 END * CASE src WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0.8 ELSE 0.7 END AS w FROM r WHERE NOT spam AND s IS NOT NULL)
 SELECT l_suppkey, count(*) AS n, round(greatest(0, least(100, 50 + 50 * sum(w * s) / sum(w))), 1) AS score, count(*) >= 3 AS rankable FROM w GROUP BY 1""",
)
def dm_reputation_trust(m):
    n = F.col("l_linenumber")
    rows = m.lineitem.select("l_suppkey", F.when(n != 5, n % 3 - 1).alias("sentiment"), F.when(n != 4, F.col("l_shipdate").cast("date")).alias("day"), F.col("l_returnflag").alias("source"), (F.col("l_discount") > 0.09).alias("is_spam"))
    return economics.reputation(rows, "l_suppkey", _TRUST, as_of())


@book.query(
    "dm_transport_score",
    """WITH c AS (SELECT o_orderkey AS l_id, 51.128::DOUBLE + ((o_orderkey * 37) % 1000 - 500) / 10000.0::DOUBLE AS lat, 71.43::DOUBLE + ((o_orderkey * 91) % 1000 - 500) / 10000.0::DOUBLE AS lon FROM orders),
 p AS (SELECT c_custkey AS r_id, ['rail', 'bus', 'road', 'junction'][c_custkey % 4 + 1] AS kind, CASE WHEN c_custkey % 4 = 1 THEN c_custkey % 30 END AS route, 51.128::DOUBLE + ((c_custkey * 53) % 1000 - 500) / 10000.0::DOUBLE AS lat, 71.43::DOUBLE + ((c_custkey * 29) % 1000 - 500) / 10000.0::DOUBLE AS lon FROM customer),
 d AS (SELECT l_id, kind, route, sqrt(power((c.lat - p.lat) * 111000.0::DOUBLE, 2) + power((c.lon - p.lon) * cos(radians(c.lat)) * 111000.0::DOUBLE, 2)) AS d FROM c JOIN p ON abs(c.lat - p.lat) < 0.01 AND abs(c.lon - p.lon) < 0.016),
 n AS (SELECT l_id, min(d) FILTER (WHERE kind = 'rail') AS a, min(d) FILTER (WHERE kind = 'bus') AS b, min(d) FILTER (WHERE kind = 'road') AS r, min(d) FILTER (WHERE kind = 'junction') AS j, count(DISTINCT CASE WHEN d <= 500 THEN route END) AS routes FROM d WHERE d <= 1000 GROUP BY 1),
 s AS (SELECT l_id, round(least(1, greatest(0, coalesce(greatest(0, 1 - a / 1000), 0) * 0.75::DOUBLE + coalesce(greatest(0, 1 - b / 500), 0) * 0.4::DOUBLE + coalesce(greatest(0, 1 - r / 600), 0) * 0.3::DOUBLE + coalesce(greatest(0, 1 - j / 800), 0) * 0.2::DOUBLE + least(1, routes / 6.0::DOUBLE) * 0.5::DOUBLE)), 6) AS score, routes FROM n)
 SELECT * FROM s WHERE score > 0.05""",
)
def dm_transport_score(m):
    o, k = F.col("o_orderkey"), F.col("c_custkey")
    cells = m.orders.select(o.alias("l_id"), (51.128 + ((o * 37) % 1000 - 500) / 10000.0).alias("l_lat"), (71.43 + ((o * 91) % 1000 - 500) / 10000.0).alias("l_lon"))
    kind = F.element_at(F.array(*[F.lit(x) for x in economics.TRANSPORT]), (k % 4 + 1).cast("int"))
    points = m.customer.select(k.alias("r_id"), kind.alias("kind"), F.when(k % 4 == 1, k % 30).alias("route"), (51.128 + ((k * 53) % 1000 - 500) / 10000.0).alias("r_lat"), (71.43 + ((k * 29) % 1000 - 500) / 10000.0).alias("r_lon"))
    return economics.transport_score(cells, points, 0.016)


@book.query(
    "dm_class_score_full",
    f"""{BASE_SQL}, c AS (SELECT complex_id, avg(ppm2) AS p, avg(area) AS a, count(*) AS n, avg(floor) AS f FROM base WHERE active GROUP BY 1), s AS (SELECT complex_id, (p - min(p) OVER ()) / nullif(max(p) OVER () - min(p) OVER (), 0) AS sp, (a - min(a) OVER ()) / nullif(max(a) OVER () - min(a) OVER (), 0) AS sa,
  1 - (n - min(n) OVER ()) / nullif(CAST(max(n) OVER () - min(n) OVER () AS DOUBLE), 0) AS sn, (f - min(f) OVER ()) / nullif(max(f) OVER () - min(f) OVER (), 0) AS sf FROM c)
 SELECT complex_id, round((coalesce(0.4::DOUBLE * sp, 0) + coalesce(0.2::DOUBLE * sa, 0) + coalesce(0.1::DOUBLE * sn, 0) + coalesce(0.1::DOUBLE * sf, 0)) / nullif(CASE WHEN sp IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN sa IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN sn IS NULL THEN 0 ELSE 0.1::DOUBLE END + CASE WHEN sf IS NULL THEN 0 ELSE 0.1::DOUBLE END, 0), 6) AS score FROM s""",
)
def dm_class_score_full(m):
    c = market.base(m.listings).filter(market.status_condition("active")).groupBy("complex_id").agg(F.avg(market.ppm2()).alias("p"), F.avg("area").alias("a"), F.count(F.lit(1)).alias("n"), F.avg("floor").alias("f"))
    return economics.class_scores(c, [("p", 0.4, False), ("a", 0.2, False), ("n", 0.1, True), ("f", 0.1, False)], "complex_id")


@book.query(
    "fil_rental_clean_live",
    f"""{L}, r AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'daily' ELSE 'monthly' END AS rp, id % 7 = 0 AS cf, CASE WHEN id % 8 = 0 THEN TRUE END AS rv, CASE WHEN id % 13 = 0 THEN 'x' WHEN id % 13 = 1 THEN ' ' END AS dup FROM listings),
 c AS (SELECT *, rp = 'monthly' AND NOT cf AND NOT coalesce(is_duplicate, FALSE) AND NOT coalesce(rv, FALSE) AND coalesce(trim(dup), '') = '' AS clean FROM r)
 SELECT district, count(*) FILTER (WHERE clean) AS n_clean, count(*) FILTER (WHERE clean AND coalesce(is_active, FALSE) AND archived_at IS NULL AND coalesce(last_seen BETWEEN {NOW} - INTERVAL 8760 HOUR AND {NOW}, FALSE)) AS n_live FROM c GROUP BY 1""",
)
def fil_rental_clean_live(m):
    i = F.col("id")
    rows = m.listings.withColumns({"rent_period": F.when(i % 5 == 0, "daily").otherwise("monthly"), "period_conflict": i % 7 == 0, "needs_review": F.when(i % 8 == 0, True), "duplicate_of": F.when(i % 13 == 0, "x").when(i % 13 == 1, " ")})
    return rows.groupBy("district").agg(F.count_if(economics.rental_clean()).alias("n_clean"), F.count_if(economics.rental_live(as_of(), 8760)).alias("n_live"))


@book.query(
    "ag_active_spans",
    f"""{L}, s AS (SELECT seller_id, min(first_seen) AS a, max(last_seen) AS b FROM listings GROUP BY 1 HAVING min(first_seen) < max(last_seen)), k0 AS (SELECT seller_id, archived_at AS x, archived_at + INTERVAL 40 DAY AS y FROM listings WHERE archived_at IS NOT NULL),
 k1 AS (SELECT *, max(y) OVER (PARTITION BY seller_id ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM k0), k2 AS (SELECT *, sum(CASE WHEN m IS NULL OR x > m THEN 1 ELSE 0 END) OVER (PARTITION BY seller_id ORDER BY x, y ROWS UNBOUNDED PRECEDING) AS g FROM k1),
 k AS (SELECT seller_id, min(x) AS x, max(y) AS y FROM k2 GROUP BY seller_id, g), e AS (SELECT s.seller_id, a, b, x, y FROM s LEFT JOIN k ON s.seller_id = k.seller_id AND x < b AND y > a),
 p AS (SELECT seller_id, coalesce(lag(y) OVER w, a) AS st, coalesce(x, b) AS en FROM e WINDOW w AS (PARTITION BY seller_id ORDER BY x) UNION ALL SELECT seller_id, max(y), max(b) FROM e WHERE x IS NOT NULL GROUP BY 1)
 SELECT seller_id, st AS start, en AS "end" FROM p WHERE st < en""",
)
def ag_active_spans(m):
    spans = m.listings.groupBy("seller_id").agg(F.min("first_seen").alias("start"), F.max("last_seen").alias("end")).filter(F.col("start") < F.col("end"))
    breaks = m.listings.filter("archived_at is not null").select("seller_id", F.col("archived_at").alias("start"), (F.col("archived_at") + F.expr("INTERVAL 40 DAYS")).alias("end"))
    return economics.active_spans(spans, breaks, ["seller_id"])


@book.query(
    "sc_json_patch",
    """SELECT event_id, '{"k":' || '"' || (props->>'k') || '","type":"' || event_type || '"}' AS patched FROM events""",
)
def sc_json_patch(m):
    return m.events.select("event_id", economics.json_patch(F.col("props"), {"type": F.col("event_type"), "gone": F.lit(None)}).alias("patched"))


@book.query("snk_day_partitions", "SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-05' THEN value * 2 ELSE value END AS value, CAST(ts AS DATE) AS day FROM events")
def snk_day_partitions(m):
    """All days are written, one is written again with other values, and twice over."""
    path = new_path(m.spark, "day-partitions")
    rows = m.events.select("event_id", "value", F.col("ts").cast("date").alias("day"))
    economics.write_day(rows, path, "day")
    again = rows.filter("day = date'2024-01-05'").withColumn("value", F.col("value") * 2)
    economics.write_day(again, path, "day")
    economics.write_day(again, path, "day")
    return m.spark.read.schema("event_id long, value double, day date").parquet(path)
