"""Scores, labels, geo layers and text functions as registered queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.functions import geo, stats, text
from kadastra.operators import market, scoring
from kadastra.plans.book import Book
from kadastra.plans.dashboards import BASE_SQL, NOW, WITH_CHANGES
from kadastra.sources.market import CHANGES_SQL, LISTINGS_SQL, as_of

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
L = f"WITH {LISTINGS_SQL}"
_MLON = repr(geo.M_LON)


def hex_sql(lat: str, lon: str, edge: float) -> str:
    """q and r of a hexagon in SQL, as columns q and r of a subquery over (x, y)."""
    s3 = repr(math.sqrt(3) / 3)
    two3 = repr(2 / 3)
    return f"(({lon} - 71.43::DOUBLE) * {_MLON}::DOUBLE * {s3}::DOUBLE - ({lat} - 51.128::DOUBLE) * 110574.0::DOUBLE / 3) / {edge}::DOUBLE AS fq, (({lat} - 51.128::DOUBLE) * 110574.0::DOUBLE * {two3}::DOUBLE) / {edge}::DOUBLE AS fr"


_ROUND = """SELECT *, CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS qd, CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS rd
 FROM (SELECT *, abs(rq - fq) AS dq, abs(rr - fr) AS dr, abs(rs - (-fq - fr)) AS ds FROM (SELECT *, round_even(fq, 0) AS rq, round_even(fr, 0) AS rr, round_even(-fq - fr, 0) AS rs FROM {src}))"""


def hexed(src: str, lat: str, lon: str, edge: float) -> str:
    """A CTE body: src with its hexagon (q, r)."""
    inner = f"(SELECT *, {hex_sql(lat, lon, edge)} FROM {src})"
    return f"SELECT *, CAST(qd AS BIGINT) AS q, CAST(rd AS BIGINT) AS r FROM ({_ROUND.format(src=inner)})"


@book.query("sc_hex_id", f"{L}, h AS ({hexed('listings', 'lat', 'lon', 100.0)}) SELECT id, q || ':' || r AS hex FROM h")
def sc_hex_id(m):
    return m.listings.select("id", geo.hex_id(F.col("lat"), F.col("lon")).alias("hex"))


_HEXSTATS = f"{BASE_SQL}, h AS ({hexed('(SELECT lat, lon, ppm2 FROM base WHERE active)', 'lat', 'lon', 400.0)}), c AS (SELECT q, r, count(*) AS n, round(avg(ppm2), 4) AS avg_ppm2 FROM h GROUP BY 1, 2)"


@book.query("ag_hex_stats", f"{_HEXSTATS} SELECT * FROM c")
def ag_hex_stats(m):
    return scoring.hex_stats(m.listings, 400.0)


@book.query(
    "ag_hex_ring",
    f"""{_HEXSTATS}, o AS (SELECT * FROM (VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) t(a, b)), g AS (SELECT c.q, c.r, sum(d.n) AS k, round(sum(d.n * d.avg_ppm2) / sum(d.n), 9) AS p FROM c, o JOIN c d ON d.q = c.q + a AND d.r = c.r + b GROUP BY 1, 2)
 SELECT c.*, CAST(coalesce(k, 0) AS BIGINT) AS ring_n, p AS ring_ppm2 FROM c LEFT JOIN g ON c.q = g.q AND c.r = g.r""",
)
def ag_hex_ring(m):
    return scoring.hex_with_ring(scoring.hex_stats(m.listings, 400.0))


@book.query(
    "ag_hex_score",
    f"""{L}, h AS ({hexed('(SELECT lat, lon, CAST(rooms AS DOUBLE) AS sv FROM listings)', 'lat', 'lon', 150.0)}), c AS (SELECT q, r, count(*) AS n, avg(sv) AS sev FROM h GROUP BY 1, 2),
 p AS (SELECT list_sort(list(n))[CAST(least(floor(count(*) * 0.9), count(*) - 1) AS BIGINT) + 1] AS p90 FROM c) SELECT q, r, n, round(least(n / CAST(p90 AS DOUBLE), 1.0::DOUBLE), 6) AS count_norm, round((n / CAST(p90 AS DOUBLE)) * (1 + 0.5 * sev) / 3, 6) AS score FROM c, p""",
)
def ag_hex_score(m):
    return scoring.hex_score(m.listings.withColumn("sv", F.col("rooms").cast("double")), "sv")


@book.query(
    "ag_rank_composite",
    f"{BASE_SQL}, c AS (SELECT complex_id, count(*) AS n, avg(price) AS p FROM base GROUP BY 1) SELECT complex_id, round(0.65 * (row_number() OVER (ORDER BY n, complex_id) - 1) / greatest(count(*) OVER () - 1, 1) + 0.35 * (row_number() OVER (ORDER BY p, complex_id) - 1) / greatest(count(*) OVER () - 1, 1), 9) AS hype FROM c",
)
def ag_rank_composite(m):
    c = market.base(m.listings).groupBy("complex_id").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("p"))
    return scoring.rank_composite(c, "complex_id", "n", "p").select("complex_id", "hype")


_E = 350.0
_CX = f"(q * {math.sqrt(3)!r}::DOUBLE + r * {math.sqrt(3) / 2!r}::DOUBLE) * {_E}::DOUBLE"


@book.query(
    "ag_kernel_density",
    f"""{L}, p AS (SELECT lat, lon, sum(area) / 20 AS w FROM listings GROUP BY 1, 2), h AS ({hexed('p', 'lat', 'lon', _E)}), o AS (SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM range(-6, 7) x(a), range(-6, 7) y(b) WHERE abs(a + b) <= 6),
 k AS (SELECT (lon - 71.43::DOUBLE) * {_MLON}::DOUBLE AS x, (lat - 51.128::DOUBLE) * 110574.0::DOUBLE AS y, w, h.q + a AS q, h.r + b AS r FROM h, o),
 d AS (SELECT q, r, w, power({_CX} - x, 2) + power(r * 1.5 * {_E} - y, 2) AS d2 FROM k), s AS (SELECT q, r, sum(CASE WHEN d2 <= 4410000 THEN w * exp(-d2 / 980000.0::DOUBLE) / (2 * 3.141592653589793::DOUBLE * 490000) * {1.5 * math.sqrt(3) * _E * _E!r}::DOUBLE END) AS people FROM d GROUP BY 1, 2)
 SELECT q, r, round(people, 4) AS people FROM s WHERE people >= 3""",
)
def ag_kernel_density(m):
    return scoring.kernel_density(m.listings.withColumn("w", F.col("area") / 20), "w")


@book.query(
    "ag_centroid_gate",
    f"""{L}, c AS (SELECT complex_id, quantile_cont(lat, 0.5) AS a, quantile_cont(lon, 0.5) AS o FROM listings GROUP BY 1),
 k AS (SELECT complex_id, lat, lon FROM listings JOIN c USING (complex_id) WHERE 2 * 6371000.0::DOUBLE * asin(sqrt(power(sin(radians(a - lat) / 2), 2) + cos(radians(lat)) * cos(radians(a)) * power(sin(radians(o - lon) / 2), 2))) <= 1500)
 SELECT complex_id, count(*) AS n, round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon FROM k GROUP BY 1 HAVING count(*) >= 3""",
)
def ag_centroid_gate(m):
    rows = m.listings.select("complex_id", "lat", "lon")
    centre = rows.groupBy("complex_id").agg(F.percentile("lat", F.lit(0.5)).alias("a"), F.percentile("lon", F.lit(0.5)).alias("o"))
    near = rows.join(centre, "complex_id").filter(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("a"), F.col("o")) * 1000 <= 1500)
    return near.groupBy("complex_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lat"), 8).alias("lat"), F.round(F.avg("lon"), 8).alias("lon")).filter("n >= 3")


_RING = [(51.10, 71.40), (51.15, 71.41), (51.16, 71.45), (51.12, 71.47), (51.11, 71.43)]


def _ring_sql() -> str:
    parts = []
    for (a, o), (b, p) in zip(_RING, _RING[1:] + _RING[:1], strict=True):
        parts.append(f"CASE WHEN ({a} > lat) <> ({b} > lat) AND lon < (lat - {a}::DOUBLE) * {(p - o) / (b - a)!r}::DOUBLE + {o}::DOUBLE THEN 1 ELSE 0 END")
    return f"({' + '.join(parts)}) % 2 = 1"


@book.query("sc_point_in_polygon", f"{L} SELECT id, {_ring_sql()} AS inside, lat BETWEEN 51.1 AND 51.15 AND lon BETWEEN 71.4 AND 71.45 AS in_box FROM listings")
def sc_point_in_polygon(m):
    return m.listings.select("id", geo.in_ring(F.col("lat"), F.col("lon"), _RING).alias("inside"), geo.in_box(F.col("lat"), F.col("lon"), 51.1, 51.15, 71.4, 71.45).alias("in_box"))


@book.query(
    "sc_name_and_address",
    """SELECT c_custkey, trim(regexp_replace(lower(trim(regexp_replace('Complex  «' || c_name || '» ', '["''«»“”]', '', 'g'))), '^(residential complex|complex|block) +', '')) AS name_key,
 regexp_extract(c_name, '([1-9][0-9]{0,3})$', 1) AS tail, md5(concat_ws('|', c_name, c_mktsegment)) AS fingerprint FROM customer""",
)
def sc_name_and_address(m):
    name = F.concat(F.lit("Complex  «"), F.col("c_name"), F.lit("» "))
    return m.customer.select("c_custkey", text.name_key(name).alias("name_key"), F.regexp_extract("c_name", "([1-9][0-9]{0,3})$", 1).alias("tail"), F.md5(F.concat_ws("|", "c_name", "c_mktsegment")).alias("fingerprint"))


@book.query(
    "sc_scrub_contacts",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[mail]', 'g'), '(^|[^A-Za-z0-9_])@[A-Za-z0-9_]{3,}', '\1[handle]', 'g'), '\+?[0-9][0-9()\- ]{8,}[0-9]', '[phone]', 'g')) AS digest FROM documents""",
)
def sc_scrub_contacts(m):
    return m.documents.select("doc_id", F.md5(text.scrub(F.col("text")).cast("binary")).alias("digest"))


@book.query(
    "sc_classifiers",
    """SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)widget|gear') THEN 'machine' WHEN regexp_matches(p_name, '(?i)ring|small') THEN 'small' ELSE 'other' END AS kind,
 CASE WHEN (CASE WHEN regexp_matches(p_name, '(?i)red|blue') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(p_name, '(?i)ring|gear') THEN 1 ELSE 0 END) = 1 THEN CASE WHEN regexp_matches(p_name, '(?i)red|blue') THEN 'colour' ELSE 'shape' END ELSE 'unknown' END AS only_one FROM part""",
)
def sc_classifiers(m):
    n = F.col("p_name")
    return m.part.select("p_partkey", text.first_hit(n, [("machine", "widget|gear"), ("small", "ring|small")], "other").alias("kind"), text.only_hit(n, [("colour", "red|blue"), ("shape", "ring|gear")], "unknown").alias("only_one"))


@book.query("sc_url_parts", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def sc_url_parts(m):
    return m.pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"))


@book.query("sc_identity_fold", "SELECT c_custkey, CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 15))::BIGINT % 10 AS INTEGER) AS fold FROM customer")
def sc_identity_fold(m):
    return m.customer.select("c_custkey", text.fold(F.col("c_custkey").cast("string")).alias("fold"))


@book.query("sc_token_overlap", "WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type) || ' ring', ' ')) AS b FROM part) SELECT p_partkey, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / least(len(a), len(b)), 6) AS overlap FROM p")
def sc_token_overlap(m):
    return m.part.select("p_partkey", F.round(text.token_overlap(F.col("p_name"), F.concat("p_type", F.lit(" ring"))), 6).alias("overlap"))


@book.query("sc_annuity", "SELECT o_orderkey, round(o_totalprice * 0.8 * (0.01::DOUBLE * power(1.01::DOUBLE, 240) / (power(1.01::DOUBLE, 240) - 1)), 4) AS payment FROM orders")
def sc_annuity(m):
    return m.orders.select("o_orderkey", F.round(scoring.annuity(F.col("o_totalprice") * 0.8, 12.0, 240), 4).alias("payment"))


# ---- scores


_KM = f"""{L}, o AS (SELECT housing_class, greatest(0.5::DOUBLE, floor((epoch_us(coalesce(archived_at, {NOW})) - epoch_us(first_seen)) / 86400000000.0::DOUBLE)) AS t, archived_at IS NOT NULL AS e FROM listings WHERE coalesce(archived_at, {NOW}) >= first_seen),
 g AS (SELECT housing_class, t, sum(CASE WHEN e THEN 1 ELSE 0 END) AS d, count(*) AS m FROM o GROUP BY 1, 2), a AS (SELECT *, sum(m) OVER (PARTITION BY housing_class ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n FROM g),
 k AS (SELECT housing_class, t, n, d, CASE WHEN max(CASE WHEN d = n THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - CAST(d AS DOUBLE) / n) ELSE 0 END) OVER w) END AS s FROM a WHERE d > 0 WINDOW w AS (PARTITION BY housing_class ORDER BY t ROWS UNBOUNDED PRECEDING))"""


def _observations(m):
    t = F.greatest(F.lit(0.5), F.floor(stats.days(F.coalesce("archived_at", as_of()), F.col("first_seen"))).cast("double"))
    return m.listings.filter(F.coalesce("archived_at", as_of()) >= F.col("first_seen")).select("housing_class", t.alias("t"), F.col("archived_at").isNotNull().alias("e"))


@book.query("dm_kaplan_meier", f"{_KM} SELECT housing_class, t, CAST(n AS BIGINT) AS n, CAST(d AS BIGINT) AS d, round(s, 6) AS survival FROM k")
def dm_kaplan_meier(m):
    return scoring.kaplan_meier(_observations(m), ["housing_class"], "t", "e").withColumn("survival", F.round("survival", 6))


@book.query("dm_km_quantile", f"{_KM} SELECT housing_class, min(t) AS t FROM k WHERE s <= 0.75 GROUP BY 1")
def dm_km_quantile(m):
    return scoring.km_quantile(scoring.kaplan_meier(_observations(m), ["housing_class"], "t", "e"), ["housing_class"], "t", 0.75)


@book.query(
    "dm_auc",
    "WITH r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS r FROM orders) SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)), 6) AS auc FROM r",
)
def dm_auc(m):
    return scoring.auc(m.orders.withColumn("y", F.col("o_orderstatus") == "F"), "o_totalprice", "y")


@book.query("dm_calibration", "WITH t AS (SELECT o_totalprice / 1000000 AS s, o_orderstatus = 'F' AS y, ntile(10) OVER (ORDER BY o_totalprice / 1000000, o_orderkey) AS bin FROM orders) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(CASE WHEN y THEN 1 ELSE 0 END), 6) AS rate FROM t GROUP BY 1")
def dm_calibration(m):
    rows = m.orders.select("o_orderkey", (F.col("o_totalprice") / 1000000).alias("s"), (F.col("o_orderstatus") == "F").alias("y"))
    return scoring.calibration(rows, "s", "y", "o_orderkey")


@book.query(
    "dm_class_model",
    """WITH f AS (SELECT p_partkey, p_type AS c, ln(p_retailprice) AS a, CAST(p_size AS DOUBLE) AS b FROM part), s AS (SELECT c, count(*) AS n, avg(a) AS ma, greatest(stddev_pop(a), 1e-6) AS sa, avg(b) AS mb, greatest(stddev_pop(b), 1e-6) AS sb FROM f GROUP BY 1)
 SELECT p_partkey, c AS predicted FROM (SELECT f.p_partkey, s.c, round(ln(n) - ln(sa) - power((a - ma) / sa, 2) / 2 - ln(sb) - power((b - mb) / sb, 2) / 2, 9) AS lp FROM f, s) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY lp DESC, c) = 1""",
)
def dm_class_model(m):
    rows = m.part.select("p_partkey", F.col("p_type").alias("label"), F.ln("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"))
    return scoring.gaussian_bayes(rows, "label", ["a", "b"], "p_partkey")


@book.query(
    "dm_class_share",
    f"{BASE_SQL}, c AS (SELECT complex_id, avg(ppm2) AS p FROM base WHERE active GROUP BY 1), s AS (SELECT complex_id, round((rank() OVER (ORDER BY p) - 1) * 100.0::DOUBLE / count(*) OVER (), 6) AS share FROM c) SELECT *, CASE WHEN share >= 90 THEN 'elite' WHEN share >= 65 THEN 'business' WHEN share >= 30 THEN 'comfort' ELSE 'economy' END AS label FROM s",
)
def dm_class_share(m):
    c = market.base(m.listings).filter(market.status_condition("active")).groupBy("complex_id").agg(F.avg(market.ppm2()).alias("p"))
    return scoring.class_share(c, "complex_id", "p")


@book.query("dm_net_yield", "SELECT o_orderkey, round_even(2500.0 * 12 * 100 / o_totalprice, 1) AS gross, round_even(2500.0 * 12 * (0.95::DOUBLE - 0.10::DOUBLE) * 100 / (o_totalprice * 1.02::DOUBLE), 1) AS net FROM orders")
def dm_net_yield(m):
    gross, net = scoring.net_yield(F.col("o_totalprice"), F.lit(2500.0))
    return m.orders.select("o_orderkey", gross.alias("gross"), net.alias("net"))


@book.query("dm_cash_flow", "SELECT s_suppkey, round(12 * (s_acctbal / 10 - 300) - 1000, 4) AS final, round(least(12 * (s_acctbal / 10 - 300), s_acctbal / 10 - 300) - 1000, 4) AS gap FROM supplier")
def dm_cash_flow(m):
    return scoring.cash_flow(m.supplier, "s_suppkey", F.col("s_acctbal") / 10, F.lit(300.0), F.lit(1000.0))


@book.query(
    "dm_risk_items",
    f"""{WITH_CHANGES}, c AS (SELECT listing_id, count(*) AS k FROM changes WHERE new_price < old_price GROUP BY 1), x AS (SELECT id, list_filter([CASE WHEN ppm2 < 3000 THEN 'cheap' END, CASE WHEN k >= 2 THEN 'cuts' END, CASE WHEN floor IN (1, 9) THEN 'floor' END], lambda r: r IS NOT NULL) AS items FROM base LEFT JOIN c ON listing_id = id)
 SELECT id, array_to_string(items, ',') AS items, CASE WHEN len(items) >= 2 THEN 'high' WHEN len(items) = 1 THEN 'medium' ELSE 'low' END AS level FROM x""",
)
def dm_risk_items(m):
    cuts = m.changes.filter("new_price < old_price").groupBy("listing_id").agg(F.count(F.lit(1)).alias("k"))
    items = F.array_compact(F.array(F.when(market.ppm2() < 3000, "cheap"), F.when(F.col("k") >= 2, "cuts"), F.when(F.col("floor").isin(1, 9), "floor")))
    rows = market.base(m.listings).join(cuts, F.col("id") == F.col("listing_id"), "left").select("id", items.alias("i"))
    return rows.select("id", F.array_join("i", ",").alias("items"), F.when(F.size("i") >= 2, "high").when(F.size("i") == 1, "medium").otherwise("low").alias("level"))


@book.query(
    "dm_daily_picks",
    f"""{BASE_SQL}, t AS (SELECT * FROM base WHERE active AND ppm2 IS NOT NULL), p AS (SELECT complex_id, rooms4, count(*) AS n, quantile_cont(ppm2, 0.25) AS a, quantile_cont(ppm2, 0.5) AS b, quantile_cont(ppm2, 0.75) AS c FROM t GROUP BY 1, 2),
 d AS (SELECT id, district, 1 - ppm2 / b AS disc FROM t JOIN p USING (complex_id, rooms4) WHERE n >= 5 AND (c - a) / b <= 0.8) SELECT district, id, round(disc, 6) AS discount FROM d WHERE disc BETWEEN 0.05 AND 0.6 QUALIFY row_number() OVER (PARTITION BY district ORDER BY disc DESC, id) <= 5""",
)
def dm_daily_picks(m):
    t = market.base(m.listings).filter(market.status_condition("active")).withColumn("ppm2", market.ppm2()).filter("ppm2 is not null").withColumn("rooms4", market.rooms_bucket())
    quart = F.percentile("ppm2", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    peers = t.groupBy("complex_id", "rooms4").agg(F.count(F.lit(1)).alias("n"), quart.alias("q")).filter((F.col("n") >= 5) & ((F.col("q")[2] - F.col("q")[0]) / F.col("q")[1] <= 0.8))
    d = t.join(peers, ["complex_id", "rooms4"]).withColumn("disc", 1 - F.col("ppm2") / F.col("q")[1]).filter("disc between 0.05 and 0.6")
    order = Window.partitionBy("district").orderBy(F.desc("disc"), "id")
    return d.withColumn("r", F.row_number().over(order)).filter("r <= 5").select("district", "id", F.round("disc", 6).alias("discount"))


@book.query(
    "dm_bargain",
    f"""{BASE_SQL}, g AS (SELECT district, avg(CASE WHEN (epoch_us({NOW}) - epoch_us(first_seen)) / 86400000000.0 >= 400 THEN 1.0::DOUBLE ELSE 0 END) AS old FROM base WHERE active GROUP BY 1)
 SELECT id, CAST(trunc(price * (1 - CASE WHEN old > 0.5 THEN 0.08::DOUBLE WHEN old > 0.25 THEN 0.05::DOUBLE ELSE 0.02::DOUBLE END)) AS BIGINT) AS target FROM base JOIN g USING (district) WHERE active""",
)
def dm_bargain(m):
    rows = market.base(m.listings).filter(market.status_condition("active"))
    old = rows.groupBy("district").agg(F.avg(F.when(stats.days(as_of(), F.col("first_seen")) >= 400, 1.0).otherwise(0.0)).alias("old"))
    step = F.when(F.col("old") > 0.5, 0.08).when(F.col("old") > 0.25, 0.05).otherwise(0.02)
    return rows.join(old, "district").select("id", (F.col("price") * (1 - step)).cast("long").alias("target"))


@book.query(
    "dm_developer_price_index",
    """WITH u AS (SELECT p_brand, p_size % 4 AS rooms, p_retailprice AS p FROM part), a AS (SELECT p_brand, rooms, quantile_cont(p, 0.5) AS v FROM u GROUP BY 1, 2), b AS (SELECT p_brand, quantile_cont(p, 0.5) AS v FROM u GROUP BY 1)
 SELECT s_suppkey, round(coalesce(a.v, b.v), 4) AS price FROM (SELECT s_suppkey, 'Brand#' || (s_suppkey % 25 + 1) AS br, CAST(s_suppkey % 6 AS INTEGER) AS rm FROM supplier) LEFT JOIN a ON a.p_brand = br AND a.rooms = rm LEFT JOIN b ON b.p_brand = br""",
)
def dm_developer_price_index(m):
    u = m.part.select("p_brand", (F.col("p_size") % 4).alias("rooms"), F.col("p_retailprice").alias("p"))
    a = u.groupBy("p_brand", "rooms").agg(F.percentile("p", F.lit(0.5)).alias("va"))
    b = u.groupBy(F.col("p_brand").alias("b_brand")).agg(F.percentile("p", F.lit(0.5)).alias("vb"))
    s = m.supplier.select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("br"), (F.col("s_suppkey") % 6).cast("int").alias("rm"))
    return s.join(a, (F.col("br") == F.col("p_brand")) & (F.col("rm") == F.col("rooms")), "left").join(b, F.col("br") == F.col("b_brand"), "left").select("s_suppkey", F.round(F.coalesce("va", "vb"), 4).alias("price"))


@book.query(
    "dm_hype_velocity",
    "SELECT user_id, round(sum(value * exp(-(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3600000000.0::DOUBLE / 48)), 6) AS decayed, round(CAST(count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30') AS DOUBLE) / (count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-24') / 7.0::DOUBLE + 1), 6) AS velocity FROM events GROUP BY 1",
)
def dm_hype_velocity(m):
    end = F.lit("2024-01-31").cast("timestamp")
    age_h = (F.unix_micros(end) - F.unix_micros("ts")) / F.lit(3_600_000_000.0)
    recent = F.count_if(F.col("ts") > F.lit("2024-01-30").cast("timestamp")) / (F.count_if(F.col("ts") > F.lit("2024-01-24").cast("timestamp")) / 7.0 + 1)
    return m.events.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.exp(-age_h / 48)), 6).alias("decayed"), F.round(recent, 6).alias("velocity"))


@book.query(
    "dm_reputation",
    f"""WITH r AS (SELECT s_nationkey AS dev, CASE WHEN (epoch_us({NOW}) - epoch_us(l_shipdate)) / 86400000000.0 <= 90 THEN 1.0::DOUBLE WHEN (epoch_us({NOW}) - epoch_us(l_shipdate)) / 86400000000.0 <= 365 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS w, CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 ELSE 0 END AS s FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_shipdate <= {NOW})
 SELECT dev, count(*) AS n, round(50 + 50 * sum(w * s) / sum(w), 4) AS score FROM r GROUP BY 1 HAVING count(*) >= 3""",
)
def dm_reputation(m):
    age = stats.days(as_of(), F.col("l_shipdate"))
    w = F.when(age <= 90, 1.0).when(age <= 365, 0.6).otherwise(0.3)
    s = F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    rows = m.lineitem.filter(F.col("l_shipdate") <= as_of()).join(m.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("dev"), w.alias("w"), s.alias("s"))
    return rows.groupBy("dev").agg(F.count(F.lit(1)).alias("n"), F.round(50 + 50 * F.sum(F.col("w") * F.col("s")) / F.sum("w"), 4).alias("score")).filter("n >= 3")


@book.query(
    "dm_data_quality",
    "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, avg(CASE WHEN value > 90 THEN 1.0::DOUBLE ELSE 0 END) AS bad FROM events GROUP BY 1), l AS (SELECT *, lag(n) OVER (ORDER BY day) AS pn, lag(bad) OVER (ORDER BY day) AS pb FROM d) SELECT day, n, CASE WHEN pn >= 5 THEN n < pn * 0.5 END AS volume_drop, CASE WHEN n >= 20 AND pn >= 20 THEN bad - pb >= 0.15 END AS rate_jump FROM l",
)
def dm_data_quality(m):
    d = m.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("value") > 90, 1.0).otherwise(0.0)).alias("bad"))
    w = Window.orderBy("day")
    l = d.withColumn("pn", F.lag("n").over(w)).withColumn("pb", F.lag("bad").over(w))  # noqa: E741
    return l.select("day", "n", F.when(F.col("pn") >= 5, F.col("n") < F.col("pn") * 0.5).alias("volume_drop"), F.when((F.col("n") >= 20) & (F.col("pn") >= 20), F.col("bad") - F.col("pb") >= 0.15).alias("rate_jump"))


@book.query(
    "dm_timeline",
    f"""WITH {LISTINGS_SQL}, {CHANGES_SQL} SELECT seller_id, id, 'seen' AS kind, CAST(first_seen AS DATE) AS day FROM listings UNION ALL SELECT seller_id, id, 'archived', CAST(archived_at AS DATE) FROM listings WHERE archived_at IS NOT NULL
 UNION ALL SELECT seller_id, id, 'price', CAST(changed_at AS DATE) FROM listings JOIN changes ON listing_id = id WHERE old_price IS NOT NULL""",
)
def dm_timeline(m):
    x = m.listings
    event = lambda df, kind, c: df.select("seller_id", "id", F.lit(kind).alias("kind"), F.to_date(c).alias("day"))
    moved = x.join(m.changes.filter("old_price is not null"), F.col("id") == F.col("listing_id"))
    return event(x, "seen", "first_seen").unionByName(event(x.filter("archived_at is not null"), "archived", "archived_at")).unionByName(event(moved, "price", "changed_at"))


@book.query("dm_review_dedupe", "SELECT role, md5(text) AS h, min(conv_id) AS first_conv, count(DISTINCT conv_id) AS seen_in FROM conversations GROUP BY 1, 2")
def dm_review_dedupe(m):
    return m.conversations.groupBy("role", F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("conv_id").alias("first_conv"), F.count_distinct("conv_id").alias("seen_in"))


@book.query(
    "dm_deposit_best",
    "WITH d AS (SELECT s_suppkey, s_nationkey, s_acctbal / 1000 AS rate FROM supplier) SELECT s_nationkey, arg_max(s_suppkey, rate) AS best, round(max(rate), 6) AS rate FROM d WHERE rate > 0 GROUP BY 1",
)
def dm_deposit_best(m):
    d = m.supplier.select("s_suppkey", "s_nationkey", (F.col("s_acctbal") / 1000).alias("rate")).filter("rate > 0")
    return d.groupBy("s_nationkey").agg(F.max_by("s_suppkey", "rate").alias("best"), F.round(F.max("rate"), 6).alias("rate"))


