"""Rental, preference and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.functions import stats
from kadastra.operators import market, picks, ranking
from kadastra.plans.book import Book
from kadastra.plans.dashboards import BASE_SQL, NOW
from kadastra.sources.market import LISTINGS_SQL, as_of

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
L = f"WITH {LISTINGS_SQL}"


@book.query(
    "fil_rental_live",
    f"{L} SELECT district, count(*) AS n, count(*) FILTER (WHERE price BETWEEN 50000 AND 2000000 AND area BETWEEN 20 AND 300 AND rooms BETWEEN 1 AND 6) AS clean, count(*) FILTER (WHERE (epoch_us({NOW}) - epoch_us(last_seen)) / 3600000000.0 BETWEEN 0 AND 72) AS fresh FROM listings WHERE NOT is_duplicate GROUP BY 1",
)
def fil_rental_live(m):
    clean = F.col("price").between(50000, 2000000) & F.col("area").between(20, 300) & F.col("rooms").between(1, 6)
    hours = (F.unix_micros(as_of()) - F.unix_micros("last_seen")) / F.lit(3_600_000_000.0)
    return m.listings.filter("not is_duplicate").groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.count_if(clean).alias("clean"), F.count_if(hours.between(0, 72)).alias("fresh"))


@book.query(
    "fil_user_searches",
    f"{BASE_SQL} SELECT c_custkey, count(*) AS n FROM base JOIN customer ON price BETWEEN c_acctbal * 30 AND c_acctbal * 32 AND (c_nationkey % 5 = 0 OR rooms = c_nationkey % 5) AND c_mktsegment = housing_class WHERE active AND c_acctbal > 0 GROUP BY 1",
)
def fil_user_searches(m):
    """Listings in a range of prices are those before its end less those before its beginning, counted along one order: users and listings never meet."""
    rooms = (F.col("c_nationkey") % 5).cast("long")
    # a listing counts for its rooms, if a user can ask for them, and for users of any rooms, who are numbered 5
    rows = market.base(m.listings).filter(market.status_condition("active")).filter("price is not null and housing_class is not null")
    homes = rows.withColumn("r", F.explode(F.array(F.lit(5).cast("long"), F.when(F.abs("rooms") < 5, F.col("rooms").cast("long"))))).filter("r is not null")
    users = m.customer.filter("c_acctbal > 0 and c_mktsegment is not null and c_nationkey is not null")
    ends = users.withColumn("e", F.explode(F.array(F.struct((F.col("c_acctbal") * 30).alias("at"), F.lit(0).alias("side")), F.struct((F.col("c_acctbal") * 32).alias("at"), F.lit(2).alias("side")))))
    place = lambda df, cls, r, at, side, key, one: df.select(F.col(cls).alias("cls"), r.alias("r"), at.cast("double").alias("at"), side.alias("side"), F.col(key).alias("key"), F.lit(one).cast("long").alias("one"))
    wanted = place(ends, "c_mktsegment", F.when(rooms == 0, 5).otherwise(rooms).cast("long"), F.col("e.at"), F.col("e.side"), "c_custkey", 0)
    told = ranking.running(place(homes, "housing_class", F.col("r"), F.col("price"), F.lit(1), "id", 1).unionByName(wanted), ["cls", "r", "at", "side", "key"], ["one"])
    signed = F.when(F.col("side") == 2, F.col("one_before")).otherwise(-F.col("one_before"))
    return told.filter("side <> 1").groupBy(F.col("key").alias("c_custkey")).agg(F.sum(signed).alias("n")).filter("n > 0")


@book.query(
    "jn_relist_blocks",
    f"""{L}, o AS (SELECT * FROM listings WHERE archived_at IS NOT NULL AND area > 0) SELECT o.id, min(n.id) AS successor, count(DISTINCT n.id) AS candidates FROM o JOIN listings n ON o.seller_id = n.seller_id AND abs(o.area - n.area) <= 1 AND o.id <> n.id
 AND n.first_seen BETWEEN o.archived_at - INTERVAL 3 DAY AND o.archived_at + INTERVAL 90 DAY AND abs(n.price / o.price - 1) <= 0.5 GROUP BY 1""",
)
def jn_relist_blocks(m):
    old = m.listings.filter("archived_at is not null and area > 0").withColumn("bucket", F.explode(F.array(*[F.floor(F.col("area")) + d for d in (-1, 0, 1)])))
    new = m.listings.filter("area is not null").select(*[F.col(c).alias(f"n_{c}") for c in ("id", "seller_id", "area", "price", "first_seen")])
    span = F.col("n_first_seen").between(F.col("archived_at") - F.expr("INTERVAL 3 DAYS"), F.col("archived_at") + F.expr("INTERVAL 90 DAYS"))
    same = (F.col("seller_id") == F.col("n_seller_id")) & (F.col("bucket") == F.floor(F.col("n_area"))) & (F.abs(F.col("area") - F.col("n_area")) <= 1) & (F.col("id") != F.col("n_id"))
    found = old.join(new, same & span & (F.abs(F.col("n_price") / F.col("price") - 1) <= 0.5))
    return found.groupBy("id").agg(F.min("n_id").alias("successor"), F.count_distinct("n_id").alias("candidates"))


@book.query(
    "ag_top_weighted_median",
    """WITH r AS (SELECT p_brand, p_partkey, p_retailprice AS v, 1.0::DOUBLE / (1 + p_size) AS w, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part), t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY w DESC, p_partkey) AS k FROM r WHERE i <= 60),
 s AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY p_brand) AS al FROM t WHERE k <= 20) SELECT p_brand, min(v) AS median FROM s WHERE run >= al / 2 GROUP BY 1""",
)
def ag_top_weighted_median(m):
    w = Window.partitionBy("p_brand")
    rows = m.part.select("p_brand", "p_partkey", F.col("p_retailprice").alias("v"), (F.lit(1.0) / (1 + F.col("p_size"))).alias("w"))
    pool = rows.withColumn("i", F.row_number().over(w.orderBy("p_partkey"))).filter("i <= 60")
    top = pool.withColumn("k", F.row_number().over(w.orderBy(F.desc("w"), "p_partkey"))).filter("k <= 20")
    return stats.weighted_median(top, ["p_brand"], "v", "w", "median")


@book.query(
    "ag_yield_benchmarks",
    f"""{L}, y AS (SELECT district, housing_class, 3000.0::DOUBLE * 1200 / price AS y FROM listings WHERE price > 0), s AS (SELECT 'city' AS scope, '' AS name, y FROM y UNION ALL SELECT 'district', district, y FROM y UNION ALL SELECT 'class', housing_class, y FROM y UNION ALL SELECT 'district class', district || '/' || housing_class, y FROM y)
 SELECT scope, name, count(*) AS n, round(quantile_cont(y, 0.5), 6) AS median, round(quantile_cont(y, 0.9), 6) AS p90 FROM s GROUP BY 1, 2 HAVING count(*) >= 10""",
)
def ag_yield_benchmarks(m):
    scope = lambda s, n: F.struct(F.lit(s).alias("scope"), n.alias("name"))
    d, c = F.col("district"), F.col("housing_class")
    rows = m.listings.filter("price > 0").select((F.lit(3000.0) * 1200 / F.col("price")).alias("y"), F.explode(F.array(scope("city", F.lit("")), scope("district", d), scope("class", c), scope("district class", F.concat(d, F.lit("/"), c)))).alias("s"))
    return rows.groupBy("s.scope", "s.name").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("y", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("y", F.lit(0.9)), 6).alias("p90")).filter("n >= 10")


@book.query(
    "dm_preference_score",
    f"""{BASE_SQL} SELECT id, CAST(CASE WHEN price <= 200000 THEN 30 WHEN price <= 300000 THEN 15 ELSE 0 END + CASE WHEN rooms BETWEEN 3 AND 4 THEN 20 ELSE 0 END + CASE WHEN area >= 80 THEN 15 WHEN area >= 60 THEN 8 ELSE 0 END + CASE WHEN floor NOT IN (1, 9) THEN 10 ELSE 0 END AS INTEGER) AS score,
 concat_ws(',', CASE WHEN price <= 200000 THEN 'budget' END, CASE WHEN rooms BETWEEN 3 AND 4 THEN 'rooms' END, CASE WHEN area >= 80 THEN 'area' END) AS reasons FROM base WHERE active""",
)
def dm_preference_score(m):
    p, a = F.col("price"), F.col("area")
    roomy = F.col("rooms").between(3, 4)
    score = F.when(p <= 200000, 30).when(p <= 300000, 15).otherwise(0) + F.when(roomy, 20).otherwise(0) + F.when(a >= 80, 15).when(a >= 60, 8).otherwise(0) + F.when(~F.col("floor").isin(1, 9), 10).otherwise(0)
    reasons = F.concat_ws(",", F.when(p <= 200000, "budget"), F.when(roomy, "rooms"), F.when(a >= 80, "area"))
    return market.base(m.listings).filter(market.status_condition("active")).select("id", score.alias("score"), reasons.alias("reasons"))


@book.query(
    "dm_class_score",
    f"""{BASE_SQL}, c AS (SELECT complex_id, avg(ppm2) AS p, avg(area) AS a, count(*) AS n FROM base WHERE active GROUP BY 1), s AS (SELECT complex_id, (p - min(p) OVER ()) / nullif(max(p) OVER () - min(p) OVER (), 0) AS sp, (a - min(a) OVER ()) / nullif(max(a) OVER () - min(a) OVER (), 0) AS sa, 1 - CAST(n - min(n) OVER () AS DOUBLE) / nullif(max(n) OVER () - min(n) OVER (), 0) AS sn FROM c)
 SELECT complex_id, round((0.4::DOUBLE * sp + 0.2::DOUBLE * sa + 0.1::DOUBLE * sn) / 0.7::DOUBLE, 6) AS score FROM s""",
)
def dm_class_score(m):
    c = market.base(m.listings).filter(market.status_condition("active")).groupBy("complex_id").agg(F.avg(market.ppm2()).alias("p"), F.avg("area").alias("a"), F.count(F.lit(1)).alias("n"))
    ends = c.agg(*[f(x).alias(f"{n}_{x}") for x in ("p", "a", "n") for n, f in (("low", F.min), ("high", F.max))])  # one row
    c = c.crossJoin(F.broadcast(ends))
    share = lambda x: (F.col(x) - F.col(f"low_{x}")) / F.nullif((F.col(f"high_{x}") - F.col(f"low_{x}")).cast("double"), F.lit(0.0))
    c = c.withColumn("n", F.col("n").cast("double"))
    return c.select("complex_id", F.round((0.4 * share("p") + 0.2 * share("a") + 0.1 * (1 - share("n"))) / 0.7, 6).alias("score"))


@book.query(
    "dm_rent_estimate",
    f"""{L}, r AS (SELECT complex_id, rooms, count(*) AS n, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3 FROM listings WHERE archived_at IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5)
 SELECT l.id, round(q1, 4) AS low, round(q2, 4) AS rent, round(q3, 4) AS high FROM listings l JOIN r ON l.complex_id = r.complex_id AND l.rooms = r.rooms WHERE l.is_active""",
)
def dm_rent_estimate(m):
    q = F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    r = m.listings.filter("archived_at is not null").groupBy("complex_id", "rooms").agg(F.count(F.lit(1)).alias("n"), q.alias("q")).filter("n >= 5")
    return m.listings.filter("is_active").join(r, ["complex_id", "rooms"]).select("id", *[F.round(F.col("q")[i], 4).alias(a) for i, a in enumerate(("low", "rent", "high"))])


@book.query(
    "dm_buyer_alternatives",
    f"""{BASE_SQL}, t AS (SELECT * FROM base WHERE active), c AS (SELECT q.id AS base_id, t.id, CASE WHEN t.price < q.price THEN 2 ELSE 0 END + CASE WHEN t.area > q.area THEN 1 ELSE 0 END + CASE WHEN t.floor NOT IN (1, 9) THEN 1 ELSE 0 END AS points,
  sqrt(power((q.lat - t.lat) * 111000.0::DOUBLE, 2) + power((q.lon - t.lon) * cos(radians(q.lat)) * 111000.0::DOUBLE, 2)) AS d FROM t q JOIN t ON q.rooms = t.rooms AND q.id <> t.id AND abs(q.lat - t.lat) <= 0.01 AND abs(q.lon - t.lon) <= 0.02)
 SELECT base_id, id, points FROM c WHERE d <= 700 QUALIFY row_number() OVER (PARTITION BY base_id ORDER BY points DESC, round(d, 3), id) <= 3""",
)
def dm_buyer_alternatives(m):
    t = market.base(m.listings).filter(market.status_condition("active"))
    return picks.alternatives(t, t)
