"""Joins, windows, aggregates, top-k, set operations and snapshots as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.functions import geo, stats
from kadastra.operators import market, relational
from kadastra.plans.book import Book
from kadastra.plans.dashboards import BASE_SQL, NOW
from kadastra.sources.market import CHANGES_SQL, LISTINGS_SQL, as_of

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
L = f"WITH {LISTINGS_SQL}"
C = f"WITH {CHANGES_SQL}"
PLANAR = "sqrt(power(({a} - {b}) * 111000.0::DOUBLE, 2) + power(({c} - {d}) * cos(radians({a})) * 111000.0::DOUBLE, 2))"


def places(m):
    parts = m.part.select(F.col("p_partkey").alias("key"), "p_size", "p_brand", "p_type", "p_name")
    lat, lon = geo.pseudo_place(F.col("key") * 7 + 3)
    return parts.select("*", lat.alias("lat"), lon.alias("lon"))


PLACES_SQL = "places AS (SELECT p_partkey AS key, p_size, p_brand, p_type, p_name, 51.128 + (((p_partkey * 7 + 3) * 37) % 1000 - 500) / 10000.0::DOUBLE AS lat, 71.43 + (((p_partkey * 7 + 3) * 91) % 1000 - 500) / 10000.0::DOUBLE AS lon FROM part)"

# ---- joins


@book.query(
    "jn_best_match",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey END AS bound, ' ' || upper(p_name) || ' ' AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
 n AS (SELECT lower(trim(p_name)) AS k, min(p_partkey) AS id FROM part GROUP BY 1)
 SELECT coalesce(bound, n.id) AS matched_id, count(*) AS n FROM r LEFT JOIN n ON bound IS NULL AND lower(trim(r.name)) = n.k GROUP BY 1""",
)
def jn_best_match(m):
    rows = m.lineitem.join(m.part.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select(F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")).alias("bound"), F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("name"))
    return relational.best_match(rows, m.part, "bound", "name", "p_partkey", "p_name").groupBy("matched_id").agg(F.count(F.lit(1)).alias("n"))


@book.query(
    "jn_priority_chain",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS bound, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 40 AS INTEGER) END AS house, 'CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS nm FROM orders),
 h AS (SELECT c_nationkey AS hk, min(c_custkey) AS id FROM customer GROUP BY 1), u AS (SELECT lower(trim(c_name)) AS k, min(c_custkey) AS id FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1)
 SELECT o_orderkey, coalesce(c.c_custkey, h.id, u.id) AS resolved_id FROM r LEFT JOIN customer c ON c.c_custkey = bound LEFT JOIN h ON hk = house LEFT JOIN u ON lower(trim(nm)) = k""",
)
def jn_priority_chain(m):
    rows = m.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("bound"),
        F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_custkey") % 40).cast("int")).alias("house"),
        F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("nm"),
    )
    return relational.unique_name_match(rows, m.customer, "bound", "house", "nm", "c_custkey", "c_nationkey", "c_name").select("o_orderkey", "resolved_id")


#: Of listings o and later ones n that may be o again: strict, and how many there are.
RELIST_MATCH_SQL = """SELECT o.id, bool_or(o.floor IS NOT DISTINCT FROM n.floor AND n.area BETWEEN o.area * 0.95::DOUBLE AND o.area * 1.05::DOUBLE AND n.price BETWEEN o.price * 0.85::DOUBLE AND o.price * 1.15::DOUBLE) AS strict, count(*) AS k
  FROM listings o JOIN listings n ON o.complex_id = n.complex_id AND o.rooms = n.rooms AND o.id <> n.id AND n.first_seen > o.archived_at AND n.first_seen <= o.archived_at + INTERVAL 60 DAY
   AND n.area BETWEEN o.area * 0.9::DOUBLE AND o.area * 1.1::DOUBLE
  WHERE o.archived_at IS NOT NULL AND o.price IS NOT NULL AND n.price IS NOT NULL GROUP BY 1"""
RELISTS_SQL = f"""{L}, p AS ({RELIST_MATCH_SQL})
 SELECT l.id, coalesce(strict, FALSE) AS relisted, NOT coalesce(strict, FALSE) AND coalesce(k, 0) > 0 AS possibly_relisted FROM listings l LEFT JOIN p ON l.id = p.id WHERE archived_at IS NOT NULL"""


@book.query("jn_relists", RELISTS_SQL)
def jn_relists(m):
    return relational.relists(m.listings)


@book.query(
    "jn_expand_parents",
    "WITH e AS (SELECT c_custkey % 97 AS child, c_custkey % 10 AS parent FROM customer) SELECT member, count(*) AS n FROM (SELECT DISTINCT child AS member, child FROM e UNION SELECT DISTINCT parent + 1000, child FROM e) GROUP BY 1",
)
def jn_expand_parents(m):
    e = m.customer.select((F.col("c_custkey") % 97).alias("child"), (F.col("c_custkey") % 10).alias("parent"))
    own = e.select(F.col("child").alias("member"), "child")
    return own.unionByName(e.select((F.col("parent") + 1000).alias("member"), "child")).distinct().groupBy("member").agg(F.count(F.lit(1)).alias("n"))


@book.query(
    "jn_semi_anti_mark",
    f"""{C}, c AS (SELECT DISTINCT listing_id FROM changes WHERE new_price < old_price * 0.5)
 SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM c WHERE listing_id = p_partkey)) AS n_cut, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM c WHERE listing_id = p_partkey)) AS n_uncut FROM part GROUP BY 1""",
)
def jn_semi_anti_mark(m):
    cut = m.changes.filter(F.col("new_price") < F.col("old_price") * 0.5).select(F.col("listing_id").alias("p_partkey")).distinct()
    with_cut = m.part.join(cut, "p_partkey", "left_semi").withColumn("mark", F.lit(1))
    without = m.part.join(cut, "p_partkey", "left_anti").withColumn("mark", F.lit(0))
    return with_cut.unionByName(without).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mark") == 1).alias("n_cut"), F.count_if(F.col("mark") == 0).alias("n_uncut"))


@book.query(
    "jn_interval_containment",
    f"""{BASE_SQL}, c AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '2000-12-01', INTERVAL 1 MONTH)) AS DATE) AS d)
 SELECT d, district, count(*) AS active FROM c JOIN base ON first_seen <= d AND (archived_at IS NULL OR archived_at > d) GROUP BY 1, 2""",
)
def jn_interval_containment(m):
    rows = market.base(m.listings)
    months = m.spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("2000-12-01")), F.expr("INTERVAL 1 MONTH"))).alias("d"))
    inside = (F.col("first_seen") <= F.col("d").cast("timestamp")) & (F.col("archived_at").isNull() | (F.col("archived_at") > F.col("d").cast("timestamp")))
    return rows.join(F.broadcast(months), inside).groupBy("d", "district").agg(F.count(F.lit(1)).alias("active"))  # 48 rows are broadcast


@book.query(
    "jn_nearest_place",
    f"""WITH {PLACES_SQL}, s AS (SELECT s_suppkey AS l_id, 51.128 + ((s_suppkey * 37) % 1000 - 500) / 10000.0::DOUBLE AS lat, 71.43 + ((s_suppkey * 91) % 1000 - 500) / 10000.0::DOUBLE AS lon FROM supplier),
 d AS (SELECT l_id, key AS r_id, {PLANAR.format(a='s.lat', b='p.lat', c='s.lon', d='p.lon')} AS dm FROM s JOIN places p ON abs(s.lat - p.lat) <= 0.01 AND abs(s.lon - p.lon) <= 0.02),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY dm, r_id) AS rank FROM d WHERE dm <= 500)
 SELECT l_id, CAST(rank AS INTEGER) AS rank, r_id, round(dm, 4) AS dist_m FROM r WHERE rank <= 3""",
)
def jn_nearest_place(m):
    lat, lon = geo.pseudo_place(F.col("s_suppkey"))
    left = m.supplier.select(F.col("s_suppkey").alias("l_id"), lat.alias("l_lat"), lon.alias("l_lon"))
    right = places(m).select(F.col("key").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return relational.nearest_within(left, right, 500, 0.01, 3).select("l_id", "rank", "r_id", F.round("dist_m", 4).alias("dist_m"))


@book.query(
    "jn_nearest_with_margin",
    f"""WITH {PLACES_SQL}, s AS (SELECT s_suppkey AS l_id, 51.128 + ((s_suppkey * 37) % 1000 - 500) / 10000.0::DOUBLE AS lat, 71.43 + ((s_suppkey * 91) % 1000 - 500) / 10000.0::DOUBLE AS lon FROM supplier),
 d AS (SELECT l_id, key AS r_id, {PLANAR.format(a='s.lat', b='p.lat', c='s.lon', d='p.lon')} AS dm FROM s JOIN places p ON abs(s.lat - p.lat) <= 0.01 AND abs(s.lon - p.lon) <= 0.02 AND p.p_size <= 10),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY dm, r_id) AS rank FROM d WHERE dm <= 800),
 t AS (SELECT l_id, max(r_id) FILTER (WHERE rank = 1) AS r_id, max(dm) FILTER (WHERE rank = 1) AS d1, max(dm) FILTER (WHERE rank = 2) AS d2 FROM r GROUP BY 1)
 SELECT l_id, r_id FROM t WHERE d1 <= 300 AND (d2 IS NULL OR d2 - d1 >= 15)""",
)
def jn_nearest_with_margin(m):
    lat, lon = geo.pseudo_place(F.col("s_suppkey"))
    left = m.supplier.select(F.col("s_suppkey").alias("l_id"), lat.alias("l_lat"), lon.alias("l_lon"))
    right = places(m).filter("p_size <= 10").select(F.col("key").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return relational.nearest_with_margin(relational.nearest_within(left, right, 800, 0.015, 2), 300, 15)


@book.query(
    "jn_radius_fan_out",
    f"""{L}, {PLACES_SQL} SELECT p.key, count(*) AS n, round(avg({PLANAR.format(a='p.lat', b='l.lat', c='p.lon', d='l.lon')}), 3) AS mean_m FROM places p JOIN listings l ON abs(p.lat - l.lat) <= 0.006 AND abs(p.lon - l.lon) <= 0.01
 WHERE {PLANAR.format(a='p.lat', b='l.lat', c='p.lon', d='l.lon')} <= 300 AND p.p_size = 1 GROUP BY 1""",
)
def jn_radius_fan_out(m):
    left = places(m).filter("p_size = 1").select(F.col("key").alias("l_id"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    right = m.listings.select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    # listings at one place are counted first: all are as far from a place
    counted = right.groupBy("r_lat", "r_lon").agg(F.count(F.lit(1)).alias("m"))
    near = lambda own: relational.radius_pairs(own, counted, 300, 0.006).groupBy("l_id").agg(F.sum("m").alias("n"), F.round(F.sum(F.col("dist_m") * F.col("m")) / F.sum("m"), 3).alias("mean_m"))
    return relational.for_places(left, near).select(F.col("l_id").alias("key"), "n", "mean_m")


@book.query(
    "jn_comparables_fallback",
    f"""{BASE_SQL}, t AS (SELECT * FROM base WHERE active AND ppm2 IS NOT NULL), s1 AS (SELECT complex_id, rooms4, count(*) AS n, quantile_cont(ppm2, 0.5) AS v FROM t GROUP BY 1, 2), s2 AS (SELECT district, housing_class, rooms4, count(*) AS n, quantile_cont(ppm2, 0.5) AS v FROM t GROUP BY 1, 2, 3),
 s3 AS (SELECT rooms4, quantile_cont(ppm2, 0.5) AS v FROM t GROUP BY 1)
 SELECT t.id, CASE WHEN s1.n >= 15 THEN 1 WHEN s2.n >= 5 THEN 2 ELSE 3 END AS level, round(CASE WHEN s1.n >= 15 THEN s1.v WHEN s2.n >= 5 THEN s2.v ELSE s3.v END, 4) AS expected
 FROM t LEFT JOIN s1 USING (complex_id, rooms4) LEFT JOIN s2 ON t.district = s2.district AND t.housing_class = s2.housing_class AND t.rooms4 = s2.rooms4 LEFT JOIN s3 ON t.rooms4 = s3.rooms4""",
)
def jn_comparables_fallback(m):
    t = market.base(m.listings).filter(market.status_condition("active")).withColumn("ppm2", market.ppm2()).filter("ppm2 is not null").withColumn("rooms4", market.rooms_bucket())
    median = F.percentile("ppm2", F.lit(0.5))
    s1 = t.groupBy("complex_id", "rooms4").agg(F.count(F.lit(1)).alias("n1"), median.alias("v1"))
    s2 = t.groupBy("district", "housing_class", "rooms4").agg(F.count(F.lit(1)).alias("n2"), median.alias("v2"))
    s3 = t.groupBy("rooms4").agg(median.alias("v3"))
    joined = t.join(s1, ["complex_id", "rooms4"], "left").join(s2, ["district", "housing_class", "rooms4"], "left").join(s3, ["rooms4"], "left")
    level = F.when(F.col("n1") >= 15, 1).when(F.col("n2") >= 5, 2).otherwise(3)
    return joined.select("id", level.alias("level"), F.round(F.when(level == 1, F.col("v1")).when(level == 2, F.col("v2")).otherwise(F.col("v3")), 4).alias("expected"))


@book.query(
    "jn_trigram_match",
    """WITH p AS (SELECT p_partkey, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS t FROM part),
 b AS (SELECT DISTINCT p_type AS r_name FROM part), r AS (SELECT r_name, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(r_name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS t FROM b)
 SELECT p_partkey AS l_id, r_name AS r_id, round(len(list_intersect(p.t, r.t)) / CAST(len(p.t) + len(r.t) - len(list_intersect(p.t, r.t)) AS DOUBLE), 6) AS similarity FROM p, r WHERE len(list_intersect(p.t, r.t)) / CAST(len(p.t) + len(r.t) - len(list_intersect(p.t, r.t)) AS DOUBLE) >= 0.3""",
)
def jn_trigram_match(m):
    left = m.part.select(F.col("p_partkey").alias("l_id"), F.concat_ws(" ", "p_name", "p_type").alias("l_name"))
    right = m.part.select(F.col("p_type").alias("r_id"), F.col("p_type").alias("r_name")).distinct()
    return relational.trigram_pairs(left, right, 0.3).withColumn("similarity", F.round("similarity", 6))


@book.query(
    "jn_substring_longest",
    """WITH n AS (SELECT DISTINCT p_name FROM part), x AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part)
 SELECT p_name, w FROM (SELECT p_name, w, row_number() OVER (PARTITION BY p_name ORDER BY length(w) DESC, w) AS r FROM n JOIN x ON contains(p_name, w) OR contains(w, p_name)) WHERE r = 1""",
)
def jn_substring_longest(m):
    names = m.part.select("p_name").distinct()
    words = m.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w")).distinct()
    found = names.join(words, F.contains("p_name", "w") | F.contains("w", "p_name"))
    return relational.latest_per_key(found, ["p_name"], [F.length("w").desc(), F.col("w")])


@book.query("jn_scalar_bounds", "SELECT o_orderstatus, count(*) AS n FROM orders, (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM orders) WHERE o_totalprice > a + s GROUP BY 1")
def jn_scalar_bounds(m):
    bounds = m.orders.agg(F.avg("o_totalprice").alias("a"), F.stddev_pop("o_totalprice").alias("s"))
    return m.orders.crossJoin(F.broadcast(bounds)).filter(F.col("o_totalprice") > F.col("a") + F.col("s")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))  # one row


@book.query(
    "jn_blocked_linkage",
    f"""{L} SELECT a.id AS unit_id, b.id AS listing_id, CASE WHEN a.floor = b.floor AND abs(a.price - b.price) <= a.price * 0.02 THEN 'auto' WHEN a.floor = b.floor THEN 'review' ELSE 'skip' END AS decision
 FROM listings a JOIN listings b ON a.complex_id = b.complex_id AND a.rooms = b.rooms AND a.id < b.id AND abs(a.area - b.area) <= 1 WHERE a.seller_id = b.seller_id""",
)
def jn_blocked_linkage(m):
    a, b = m.listings.alias("a"), m.listings.alias("b")
    block = (F.col("a.complex_id") == F.col("b.complex_id")) & (F.col("a.rooms") == F.col("b.rooms")) & (F.col("a.seller_id") == F.col("b.seller_id"))
    pairs = a.join(b, block & (F.col("a.id") < F.col("b.id")) & (F.abs(F.col("a.area") - F.col("b.area")) <= 1))
    same = F.col("a.floor") == F.col("b.floor")
    decision = F.when(same & (F.abs(F.col("a.price") - F.col("b.price")) <= F.col("a.price") * 0.02), "auto").when(same, "review").otherwise("skip")
    return pairs.select(F.col("a.id").alias("unit_id"), F.col("b.id").alias("listing_id"), decision.alias("decision"))


# ---- windows


@book.query("wn_latest_per_key", f"{L} SELECT seller_id, id, price FROM listings QUALIFY row_number() OVER (PARTITION BY seller_id ORDER BY first_seen DESC, id) = 1")
def wn_latest_per_key(m):
    return relational.latest_per_key(m.listings, ["seller_id"], [F.col("first_seen").desc(), F.col("id")]).select("seller_id", "id", "price")


@book.query("wn_mode_by_frequency", "SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1")
def wn_mode_by_frequency(m):
    counted = m.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return relational.latest_per_key(counted, ["p_brand"], [F.col("n").desc(), F.col("p_type")])


@book.query("wn_chain_integrity", f"{C}, x AS (SELECT listing_id, old_price, lag(new_price) OVER (PARTITION BY listing_id ORDER BY seq) AS before FROM changes) SELECT listing_id, count(*) AS n, count(*) FILTER (WHERE old_price IS DISTINCT FROM before) AS broken FROM x GROUP BY 1")
def wn_chain_integrity(m):
    before = F.lag("new_price").over(Window.partitionBy("listing_id").orderBy("seq"))
    return m.changes.withColumn("before", before).groupBy("listing_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("old_price").eqNullSafe(F.col("before"))).alias("broken"))


@book.query("wn_total_on_every_row", "SELECT s_suppkey, s_nationkey, count(*) OVER (PARTITION BY s_nationkey) AS in_nation, count(*) OVER () AS total, max(s_acctbal) OVER () AS top FROM supplier")
def wn_total_on_every_row(m):
    each = m.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("in_nation"))
    whole = m.supplier.agg(F.count(F.lit(1)).alias("total"), F.max("s_acctbal").alias("top"))  # one row
    return m.supplier.join(each, "s_nationkey").crossJoin(F.broadcast(whole)).select("s_suppkey", "s_nationkey", "in_nation", "total", "top")


@book.query("wn_group_transform", f"{L} SELECT id, count(*) OVER w AS n, round(quantile_cont(price, 0.5) OVER w, 4) AS median, round(avg(price) OVER w, 6) AS mean FROM listings WINDOW w AS (PARTITION BY district, rooms)")
def wn_group_transform(m):
    w = Window.partitionBy("district", "rooms")
    return m.listings.select("id", F.count(F.lit(1)).over(w).alias("n"), F.round(F.percentile("price", F.lit(0.5)).over(w), 4).alias("median"), F.round(F.avg("price").over(w), 6).alias("mean"))


@book.query("wn_average_rank_share", "SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY p_brand), 6) AS share FROM part")
def wn_average_rank_share(m):
    return m.part.select("p_partkey", F.round(stats.average_rank_share(F.col("p_size"), "p_brand"), 6).alias("share"))


@book.query("wn_price_trajectory", f"{C} SELECT listing_id, arg_min(new_price, seq) AS first_price, arg_max(new_price, seq) AS last_price, min(new_price) AS lowest, max(new_price) AS highest, count(*) FILTER (WHERE new_price < old_price) AS n_cuts FROM changes GROUP BY 1")
def wn_price_trajectory(m):
    return m.changes.groupBy("listing_id").agg(
        F.min_by("new_price", "seq").alias("first_price"), F.max_by("new_price", "seq").alias("last_price"), F.min("new_price").alias("lowest"), F.max("new_price").alias("highest"), F.count_if(F.col("new_price") < F.col("old_price")).alias("n_cuts")
    )


@book.query(
    "wn_snapshot_delta",
    f"""WITH {CHANGES_SQL}, s AS (SELECT listing_id % 50 AS k, CAST(date_trunc('month', changed_at) AS DATE) AS month, quantile_cont(new_price, 0.5) AS v FROM changes GROUP BY 1, 2) SELECT k, month, round(v, 7) AS v, round(v - lag(v) OVER (PARTITION BY k ORDER BY month), 7) AS delta FROM s""",
)
def wn_snapshot_delta(m):
    s = m.changes.groupBy((F.col("listing_id") % 50).alias("k"), F.date_trunc("month", "changed_at").cast("date").alias("month")).agg(F.percentile("new_price", F.lit(0.5)).alias("v"))
    return s.select("k", "month", F.round("v", 7).alias("v"), F.round(F.col("v") - F.lag("v").over(Window.partitionBy("k").orderBy("month")), 7).alias("delta"))


@book.query(
    "wn_relist_confirmed",
    f"""{L}, o AS (SELECT id, seller_id, complex_id, first_seen, max(coalesce(archived_at, TIMESTAMP '2100-01-01')) OVER (PARTITION BY seller_id, complex_id ORDER BY first_seen, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM listings)
 SELECT id, coalesce(reach < first_seen, FALSE) AS relist FROM o""",
)
def wn_relist_confirmed(m):
    order = Window.partitionBy("seller_id", "complex_id").orderBy("first_seen", "id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.coalesce("archived_at", F.lit("2100-01-01").cast("timestamp"))).over(order)
    return m.listings.select("id", F.coalesce(reach < F.col("first_seen"), F.lit(False)).alias("relist"))


# ---- aggregates


@book.query("ag_conditional", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n_disc, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS q_f, round(quantile_cont(l_extendedprice, 0.9) FILTER (WHERE l_tax > 0), 4) AS p90 FROM lineitem GROUP BY 1")
def ag_conditional(m):
    return m.lineitem.groupBy("l_returnflag").agg(
        F.count_if(F.col("l_discount") > 0.05).alias("n_disc"), F.round(F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))), 6).alias("q_f"), F.round(F.percentile(F.when(F.col("l_tax") > 0, F.col("l_extendedprice")), F.lit(0.9)), 4).alias("p90")
    )


@book.query("ag_quantiles", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.25), 4) AS q25, CAST(trunc(quantile_cont(p_retailprice, 0.5)) AS BIGINT) AS q50_cut, round(quantile_cont(p_retailprice, 0.99), 4) AS q99 FROM part GROUP BY 1")
def ag_quantiles(m):
    return m.part.groupBy("p_brand").agg(F.round(stats.exact_quantile(F.col("p_retailprice"), 0.25), 4).alias("q25"), stats.truncated_quantile(F.col("p_retailprice"), 0.5).alias("q50_cut"), F.round(stats.exact_quantile(F.col("p_retailprice"), 0.99), 4).alias("q99"))


@book.query("ag_floor_index_quantile", "SELECT p_brand, list_sort(list(p_retailprice))[CAST(least(floor(count(*) * 0.9), count(*) - 1) AS BIGINT) + 1] AS p90 FROM part GROUP BY 1")
def ag_floor_index_quantile(m):
    return stats.floor_index_quantile(m.part, ["p_brand"], "p_retailprice", 0.9, "p90")


@book.query("ag_weighted_median", "WITH r AS (SELECT p_brand, p_retailprice AS v, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_size ROWS UNBOUNDED PRECEDING) AS run, sum(p_size) OVER (PARTITION BY p_brand) AS al FROM part) SELECT p_brand, min(v) AS median FROM r WHERE run >= al / 2.0 GROUP BY 1")
def ag_weighted_median(m):
    return stats.weighted_median(m.part, ["p_brand"], "p_retailprice", "p_size", "median")


@book.query("ag_grouping_sets", f"{L} SELECT district, housing_class, rooms, CAST(grouping(housing_class) AS TINYINT) AS g, count(*) AS n, round(quantile_cont(price, 0.5), 4) AS median FROM listings GROUP BY GROUPING SETS ((district, housing_class, rooms), (district))")
def ag_grouping_sets(m):
    sets = [[F.col("district"), F.col("housing_class"), F.col("rooms")], [F.col("district")]]
    return m.listings.groupingSets(sets, "district", "housing_class", "rooms").agg(F.grouping("housing_class").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.percentile("price", F.lit(0.5)), 4).alias("median"))


@book.query("ag_distinct_any_ordered", f"{L} SELECT complex_id, count(DISTINCT seller_id) AS sellers, bool_or(price > 450000) AS any_dear, arg_min(price, id) AS first_price, arg_max(price, id) AS last_price FROM listings GROUP BY 1 HAVING count(*) >= 3")
def ag_distinct_any_ordered(m):
    out = m.listings.groupBy("complex_id").agg(F.count_distinct("seller_id").alias("sellers"), F.bool_or(F.col("price") > 450000).alias("any_dear"), F.min_by("price", "id").alias("first_price"), F.max_by("price", "id").alias("last_price"), F.count(F.lit(1)).alias("_n"))
    return out.filter("_n >= 3").drop("_n")


@book.query("ag_mode", "SELECT user_id, event_type AS top_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def ag_mode(m):
    return m.events.groupBy("user_id").agg(F.mode("event_type", deterministic=True).alias("top_type"))


@book.query("ag_histogram", "SELECT CAST(floor(value / 5) * 5 AS BIGINT) AS bin, count(*) AS n, CAST(least(greatest(floor(min(value) / 10) + 1, 0), 11) AS BIGINT) AS lowest_bucket FROM events GROUP BY 1")
def ag_histogram(m):
    return m.events.groupBy((F.floor(F.col("value") / 5) * 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(F.width_bucket("value", F.lit(0.0), F.lit(100.0), F.lit(10))).alias("lowest_bucket"))


@book.query("ag_json", "SELECT r_regionkey, '[' || string_agg('{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def ag_json(m):
    item = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return m.region.join(m.nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("nations"))


@book.query(
    "ag_interval_union",
    f"""{L}, s AS (SELECT complex_id, first_seen AS a, coalesce(archived_at, {NOW}) AS b FROM listings WHERE coalesce(archived_at, {NOW}) > first_seen),
 r AS (SELECT *, max(b) OVER (PARTITION BY complex_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY complex_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM r),
 m AS (SELECT complex_id, isl, min(a) AS a, max(b) AS b FROM i GROUP BY 1, 2)
 SELECT complex_id, count(*) AS islands, CAST(sum(epoch_us(b) - epoch_us(a)) / 86400000000 AS DOUBLE) AS days FROM m GROUP BY 1""",
)
def ag_interval_union(m):
    s = m.listings.select("complex_id", F.col("first_seen").alias("a"), F.coalesce("archived_at", as_of()).alias("b")).filter("b > a")
    return relational.merged_spans(s, ["complex_id"], "a", "b").groupBy("complex_id").agg(F.count(F.lit(1)).alias("islands"), F.sum(stats.days(F.col("b"), F.col("a"))).alias("days"))


@book.query(
    "ag_seller_profile",
    f"""{L} SELECT seller_id, count(*) AS n_listings, round_even(count(*) FILTER (WHERE archived_at IS NOT NULL) / CAST(count(*) AS DOUBLE), 4) AS exit_rate, round_even(avg(floor((epoch_us(archived_at) - epoch_us(first_seen)) / 86400000000.0::DOUBLE)), 4) AS mean_tom, count(*) > 15 AS ambiguous FROM listings GROUP BY 1""",
)
def ag_seller_profile(m):
    return m.listings.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("n_listings"),
        F.bround(F.count("archived_at") / F.count(F.lit(1)), 4).alias("exit_rate"),
        F.bround(F.avg(stats.whole_days(F.col("archived_at"), F.col("first_seen"))), 4).alias("mean_tom"),
        (F.count(F.lit(1)) > 15).alias("ambiguous"),
    )


_SCOPES = "SELECT 'city' AS scope, 'all' AS name, price, rooms FROM t UNION ALL SELECT 'district', district, price, rooms FROM t UNION ALL SELECT 'complex', CAST(complex_id AS VARCHAR), price, rooms FROM t"


@book.query(
    "ag_rental_index",
    f"""{L}, t AS (SELECT * FROM listings WHERE is_active IS NOT FALSE), s AS ({_SCOPES}), r AS (SELECT scope, name, CAST(rooms AS VARCHAR) AS rooms, price FROM s UNION ALL SELECT scope, name, 'all', price FROM s)
 SELECT scope, name, rooms, count(*) AS n, CAST(trunc(quantile_cont(price, 0.25)) AS BIGINT) AS q1, CAST(trunc(quantile_cont(price, 0.5)) AS BIGINT) AS median, CAST(trunc(quantile_cont(price, 0.75)) AS BIGINT) AS q3 FROM r GROUP BY 1, 2, 3 HAVING count(*) >= CASE WHEN scope = 'complex' THEN 5 ELSE 10 END""",
)
def ag_rental_index(m):
    scope = lambda s, n: F.struct(F.lit(s).alias("scope"), n.cast("string").alias("name"))
    rows = m.listings.filter(market.status_condition("active")).select(
        "price", F.explode(F.array(scope("city", F.lit("all")), scope("district", F.col("district")), scope("complex", F.col("complex_id")))).alias("s"), F.array(F.col("rooms").cast("string"), F.lit("all")).alias("r")
    )
    rows = rows.select("price", "s.*", F.explode("r").alias("rooms"))
    out = rows.groupBy("scope", "name", "rooms").agg(F.count(F.lit(1)).alias("n"), *[stats.truncated_quantile(F.col("price"), q).alias(a) for q, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    return out.filter(F.col("n") >= F.when(F.col("scope") == "complex", 5).otherwise(10))


@book.query(
    "ag_area_anchor_cohorts",
    f"{L}, a AS (SELECT unnest([40, 60, 80, 120, 160]) AS anchor) SELECT anchor, district, count(*) AS n, round(quantile_cont(price, 0.5), 4) AS median FROM listings JOIN a ON abs(area / anchor - 1) <= 0.15 GROUP BY 1, 2 HAVING count(*) >= 10",
)
def ag_area_anchor_cohorts(m):
    anchor = F.explode(F.array(*[F.lit(x) for x in (40, 60, 80, 120, 160)]))
    rows = m.listings.select("district", "price", "area", anchor.alias("anchor")).filter(F.abs(F.col("area") / F.col("anchor") - 1) <= 0.15)
    return rows.groupBy("anchor", "district").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("price", F.lit(0.5)), 4).alias("median")).filter("n >= 10")


@book.query(
    "ag_exclusion_reasons",
    f"""{L}, r AS (SELECT list_filter([CASE WHEN price < 50000 THEN 'cheap' END, CASE WHEN area IS NULL OR area < 20 THEN 'small' END, CASE WHEN is_duplicate THEN 'duplicate' END, CASE WHEN is_active = FALSE THEN 'archived' END], lambda x: x IS NOT NULL) AS rs FROM listings),
 e AS (SELECT unnest(rs) AS reason, unnest(range(1, len(rs) + 1)) AS i FROM r) SELECT reason, count(*) AS n, count(*) FILTER (WHERE i = 1) AS n_primary FROM e GROUP BY 1""",
)
def ag_exclusion_reasons(m):
    reasons = F.array_compact(
        F.array(
            F.when(F.col("price") < 50000, "cheap"), F.when(F.col("area").isNull() | (F.col("area") < 20), "small"), F.when(F.col("is_duplicate"), "duplicate"), F.when(F.col("is_active").eqNullSafe(False), "archived")
        )
    )
    return m.listings.select(F.posexplode(reasons).alias("i", "reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("i") == 0).alias("n_primary"))


# ---- sorts, sets, recursion, snapshots


@book.query("tk_nulls_last", f"{L} SELECT id, archived_at::DATE AS archived, price FROM listings ORDER BY archived_at DESC NULLS LAST, id LIMIT 25")
def tk_nulls_last(m):
    return m.listings.orderBy(F.col("archived_at").desc_nulls_last(), "id").limit(25).select("id", F.to_date("archived_at").alias("archived"), "price")


@book.query("tk_offset_page", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20 OFFSET 20")
def tk_offset_page(m):
    return m.supplier.orderBy(F.desc("s_acctbal"), "s_suppkey").offset(20).limit(20).select("s_suppkey", "s_acctbal")


@book.query("tk_per_group", f"{L} SELECT district, id, price FROM listings QUALIFY row_number() OVER (PARTITION BY district ORDER BY price DESC, id) <= 3")
def tk_per_group(m):
    order = Window.partitionBy("district").orderBy(F.desc("price"), "id")
    return m.listings.withColumn("r", F.row_number().over(order)).filter("r <= 3").select("district", "id", "price")


@book.query("tk_stable_shuffle", "SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS k FROM customer ORDER BY k LIMIT 50")
def tk_stable_shuffle(m):
    return m.customer.select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("k")).orderBy("k").limit(50)


@book.query(
    "tk_tiered_queue",
    f"""{L}, q AS (SELECT id, 1 AS tier, first_seen AS k FROM listings WHERE price > 450000 UNION ALL SELECT id, 2, last_seen FROM listings WHERE last_seen < TIMESTAMP '1996-01-01' UNION ALL SELECT id, 3, first_seen FROM listings),
 d AS (SELECT id, tier, k FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier) = 1) SELECT id, tier FROM d ORDER BY tier, k, id LIMIT 2000""",
)
def tk_tiered_queue(m):
    x = m.listings
    tiers = (
        x.filter("price > 450000").select("id", F.lit(1).alias("tier"), F.col("first_seen").alias("k"))
        .unionByName(x.filter(F.col("last_seen") < F.lit("1996-01-01").cast("timestamp")).select("id", F.lit(2).alias("tier"), F.col("last_seen").alias("k")))
        .unionByName(x.select("id", F.lit(3).alias("tier"), F.col("first_seen").alias("k")))
    )
    return relational.latest_per_key(tiers, ["id"], [F.col("tier")]).orderBy("tier", "k", "id").limit(2000).select("id", "tier")


@book.query("st_set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def st_set_operations(m):
    a, b = m.customer.select("c_custkey"), m.orders.select(F.col("o_custkey").alias("c_custkey"))
    count = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.union(b).distinct(), "union").union(count(a.subtract(b), "except")).union(count(a.intersect(b), "intersect"))


@book.query(
    "st_redirects",
    """WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 3 AS target FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 0), w AS (SELECT node, target AS root FROM e UNION ALL SELECT w.node, e.target FROM w JOIN e ON w.root = e.node)
 SELECT node, min(root) AS root FROM w GROUP BY 1""",
)
def st_redirects(m):
    edges = m.part.filter("p_partkey % 3 = 0 and p_partkey > 0").select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 3").alias("target"))
    return relational.redirects(edges)


@book.query(
    "snk_upsert",
    "WITH ch AS (SELECT p_partkey, l_extendedprice / l_quantity AS p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1) SELECT p_partkey, p_retailprice FROM ch UNION ALL SELECT p_partkey, p_retailprice FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM ch)",
)
def snk_upsert(m):
    current = m.part.select("p_partkey", "p_retailprice")
    changes = m.lineitem.filter("l_returnflag = 'R'").join(current.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    changes = changes.select("p_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p_retailprice"), "l_shipdate", "l_orderkey", "l_linenumber")
    return relational.upsert(current, changes, ["p_partkey"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")])


@book.query(
    "snk_field_patch",
    "SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL AND s_acctbal > c_acctbal THEN s_acctbal ELSE c_acctbal END AS c_acctbal, CASE WHEN s_suppkey IS NOT NULL AND s_acctbal > c_acctbal AND s_suppkey % 2 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
)
def snk_field_patch(m):
    current = m.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    patches = m.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), F.when(F.col("s_suppkey") % 2 == 0, "PATCHED").alias("c_mktsegment"))
    return relational.patch(current, patches, "c_custkey", ["c_acctbal", "c_mktsegment"], F.col("_p_c_acctbal") > F.col("c_acctbal"))


@book.query("snk_price_changes", f"{C} SELECT listing_id, seq, old_price, new_price FROM changes WHERE old_price IS NOT NULL AND old_price <> new_price")
def snk_price_changes(m):
    return m.changes.filter("old_price is not null and old_price != new_price").select("listing_id", "seq", "old_price", "new_price")


@book.query("snk_geojson", f"""{L} SELECT id, '{{"type":"Point","coordinates":[' || CAST(CAST(round(lon, 4) * 10000 AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(lat, 4) * 10000 AS BIGINT) AS VARCHAR) || ']}}' AS geometry FROM listings WHERE is_active""")
def snk_geojson(m):
    tens = lambda c: F.round(F.round(c, 4) * 10000).cast("long")
    return m.listings.filter("is_active").select("id", F.to_json(F.struct(F.lit("Point").alias("type"), F.array(tens("lon"), tens("lat")).alias("coordinates"))).alias("geometry"))


@book.query(
    "sm_sessions",
    "WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT *, sum(CASE WHEN b IS NULL OR epoch_us(ts) - epoch_us(b) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, CAST(k AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2",
)
def sm_sessions(m):
    return relational.sessions(m.events, "user_id", "ts", 360).select("user_id", "session", "n")


@book.query("sm_tumbling_weeks", "SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def sm_tumbling_weeks(m):
    w = F.window("ts", "7 days", startTime="4 days")
    return m.events.groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select("event_type", F.col("w.start").cast("date").alias("week"), "n", "total")


@book.query("sm_look_back", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS n7 FROM events")
def sm_look_back(m):
    us = F.unix_micros("ts")
    w = Window.partitionBy("user_id").orderBy(us).rangeBetween(-7 * 86_400_000_000, 0)
    return m.events.select("event_id", F.count(F.lit(1)).over(w).alias("n7"))


@book.query("sm_rising_edge", f"{C}, y AS (SELECT listing_id, seq, 100000 / new_price AS yield FROM changes), e AS (SELECT *, lag(yield) OVER (PARTITION BY listing_id ORDER BY seq) AS b FROM y) SELECT listing_id, count(*) AS alerts FROM e WHERE yield >= 50 AND (b IS NULL OR b < 50) GROUP BY 1")
def sm_rising_edge(m):
    y = m.changes.withColumn("yield", F.lit(100000) / F.col("new_price"))
    before = F.lag("yield").over(Window.partitionBy("listing_id").orderBy("seq"))
    return y.withColumn("b", before).filter("yield >= 50 and (b is null or b < 50)").groupBy("listing_id").agg(F.count(F.lit(1)).alias("alerts"))


@book.query("sm_daily_cap", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts + INTERVAL 5 HOUR AS DATE) ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'purchase') WHERE r <= 1")
def sm_daily_cap(m):
    day = F.to_date(F.col("ts") + F.expr("INTERVAL 5 HOURS"))
    order = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    return m.events.filter("event_type = 'purchase'").withColumn("r", F.row_number().over(order)).filter("r <= 1").select("user_id", "event_id")


@book.query("src_json_props", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def src_json_props(m):
    return m.events.select("event_type", F.from_json("props", "k long").alias("p")).groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count(F.lit(1)).alias("n"))


