"""Outcome labels and scores of listings as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.functions.stats import days
from kadastra.operators import deal, market, outcomes, scoring
from kadastra.plans.book import Book
from kadastra.plans.dashboards import BASE_SQL, NOW
from kadastra.plans.domain import hexed
from kadastra.plans.relational import RELIST_MATCH_SQL
from kadastra.sources.market import CHANGES_SQL, LISTINGS_SQL, as_of

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

# ---- outcome labels


def _labelled(m):
    """Labels of the market's listings; views are the quantities of an order's lines, details are fetched for two orders in three."""
    views = m.lineitem.groupBy(F.col("l_orderkey").alias("listing_id"), F.col("l_shipdate").alias("observed_at")).agg(F.max("l_quantity").alias("views_count"))
    return outcomes.outcome_labels(m.listings.withColumn("details_fetched", F.col("id") % 3 != 0), m.changes, views, as_of())


_LABELS_SQL = f"""WITH {LISTINGS_SQL}, {CHANGES_SQL}, rl AS ({RELIST_MATCH_SQL}),
 b AS (SELECT min(changed_at) AS hs FROM changes),
 cu AS (SELECT DISTINCT l.id FROM listings l JOIN changes c ON l.id = c.listing_id WHERE new_price < old_price AND changed_at <= first_seen + INTERVAL 30 DAY AND changed_at <= coalesce(archived_at, {NOW})),
 ev AS (SELECT l_orderkey AS vid, l_shipdate AS t, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
 vs AS (SELECT vid, min(t) AS v0, max(t) AS v1, arg_min(v, t) AS n0, arg_max(v, t) AS n1 FROM ev GROUP BY 1),
 x AS (SELECT l.*, cu.id IS NOT NULL AS cut, first_seen < hs AS unc, coalesce(strict, FALSE) AS strict, coalesce(k, 0) > 0 AND NOT coalesce(strict, FALSE) AS loose,
   (epoch_us(archived_at) - epoch_us(first_seen)) / 86400000000.0::DOUBLE AS life, (epoch_us({NOW}) - epoch_us(first_seen)) / 86400000000.0::DOUBLE AS age,
   {NOW} < archived_at + INTERVAL 60 DAY AS op, (epoch_us(v1) - epoch_us(v0)) / 86400000000.0::DOUBLE AS spread, n0, n1
   FROM listings l CROSS JOIN b LEFT JOIN cu ON cu.id = l.id LEFT JOIN rl ON rl.id = l.id LEFT JOIN vs ON vid = l.id),
 y AS (SELECT *, coalesce(life <= 2 AND id % 3 = 0, FALSE) AS removed, archived_at IS NOT NULL AND life <= 30 AS early FROM x),
 z AS (SELECT *, CASE WHEN early THEN CASE WHEN cut THEN FALSE WHEN unc THEN NULL ELSE TRUE END WHEN archived_at IS NOT NULL OR age > 30 THEN FALSE END AS d30 FROM y),
 labels AS (SELECT id, d30 AS disappeared_within_30d,
   CASE WHEN cut THEN TRUE WHEN unc THEN NULL WHEN early OR age >= 30 THEN FALSE END AS price_reduction_within_30d,
   CASE WHEN archived_at IS NOT NULL THEN life >= 90 WHEN age >= 90 THEN TRUE END AS survives_90d,
   CAST(trunc(life) AS INTEGER) AS time_on_market,
   CASE WHEN spread >= 1 THEN CAST(round(CAST((n1 - n0) / spread AS DECIMAL(18, 9)), 2) AS DOUBLE) END AS views_velocity,
   CASE WHEN d30 IS NULL THEN NULL WHEN NOT d30 OR removed OR strict THEN FALSE WHEN op THEN NULL ELSE TRUE END AS clean_disappearance_within_30d,
   CASE WHEN archived_at IS NULL THEN NULL WHEN strict THEN TRUE WHEN op THEN NULL ELSE FALSE END AS relisted_within_60d,
   CASE WHEN strict THEN FALSE WHEN archived_at IS NULL THEN NULL WHEN loose THEN TRUE WHEN op THEN NULL ELSE FALSE END AS possibly_relisted,
   removed AS possibly_moderation_removed, CAST(trunc(coalesce(life, age)) AS INTEGER) AS observation_days, archived_at IS NULL AS censored,
   nullif(concat_ws('; ', CASE WHEN unc THEN 'price history begins later' END, CASE WHEN removed THEN 'gone within two days, details unconfirmed' END, CASE WHEN strict THEN 'looks relisted' END,
     CASE WHEN loose THEN 'possibly relisted' END, CASE WHEN op THEN 'window of 60 days still open' END, CASE WHEN archived_at IS NULL THEN 'censored' END), '') AS outcome_notes FROM z)"""


@book.query("dm_outcome_labels", f"{_LABELS_SQL} SELECT * FROM labels")
def dm_outcome_labels(m):
    return _labelled(m)


@book.query("dm_outcome_report", _LABELS_SQL + " " + " UNION ALL ".join(f"SELECT '{c}' AS label, count({c}) AS resolved, count(*) FILTER (WHERE {c}) AS n_true FROM labels" for c in outcomes.LABELS))
def dm_outcome_report(m):
    return outcomes.outcome_report(_labelled(m))


# ---- deal score

_CLASSES = {"BUILDING": "elite", "AUTOMOBILE": "business", "MACHINERY": "comfort", "HOUSEHOLD": "economy"}
_FINISHES = list(deal.FINISH_ORDINAL)


def homes(m):
    """Active listings with what the deal score asks for, made up from their ids where the tables hold nothing like it."""
    rows = market.base(m.listings).filter(market.status_condition("active"))
    i = F.col("id")
    return rows.select(
        "id", "lat", "lon", "price", "area", "rooms", "floor", F.lit(9).alias("floors_total"), "complex_id",
        (F.col("complex_id") * 10 + i % 10).alias("house_id"),
        F.when(i % 13 != 0, (i % 35 + 1990).cast("int")).alias("year"),
        F.expr("CASE " + " ".join(f"WHEN housing_class = '{k}' THEN '{v}'" for k, v in _CLASSES.items()) + " END").alias("class"),
        F.expr("CASE " + " ".join(f"WHEN id % 8 = {n} THEN '{f}'" for n, f in enumerate(_FINISHES)) + " END").alias("finish"),
        F.when(i % 7 != 0, 2.5 + (i % 9) / 10.0).alias("ceiling"),
        (i % 6).cast("int").alias("rating"),
        F.when(i % 5 != 0, (i % 20).cast("double")).alias("yield_pct"),
        F.count(F.lit(1)).over(Window.partitionBy("complex_id")).alias("n_in_complex"),
        days(as_of(), F.col("first_seen")).alias("age_days"),
        (i % 3 == 0).alias("is_owner"),
    )


_HOMES_SQL = f"""{BASE_SQL}, homes AS (SELECT id, lat, lon, price, area, rooms, rooms4, floor, 9 AS floors_total, complex_id, complex_id * 10 + id % 10 AS house_id, CASE WHEN id % 13 <> 0 THEN CAST(id % 35 + 1990 AS INTEGER) END AS year,
  CASE {" ".join(f"WHEN housing_class = '{k}' THEN '{v}'" for k, v in _CLASSES.items())} END AS class, CASE {" ".join(f"WHEN id % 8 = {n} THEN '{f}'" for n, f in enumerate(_FINISHES))} END AS finish,
  CASE WHEN id % 7 <> 0 THEN 2.5::DOUBLE + (id % 9) / 10.0::DOUBLE END AS ceiling, CAST(id % 6 AS INTEGER) AS rating, CASE WHEN id % 5 <> 0 THEN CAST(id % 20 AS DOUBLE) END AS yield_pct, count(*) OVER (PARTITION BY complex_id) AS n_in_complex,
  (epoch_us({NOW}) - epoch_us(first_seen)) / 86400000000.0::DOUBLE AS age_days, id % 3 = 0 AS is_owner, price / area AS ppm2
  FROM base WHERE active)"""


def _ordinal_sql(values, column):
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {float(v)}::DOUBLE" for k, v in values.items()) + " END"


def _similarity_sql(a, b):
    known = lambda c: f"({a}.{c} IS NOT NULL AND {b}.{c} IS NOT NULL)"
    km = f"2 * 6371.0::DOUBLE * asin(sqrt(least(power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2), 1.0::DOUBLE)))"
    fade = lambda c, s: f"greatest(0.0::DOUBLE, 1 - abs({a}.{c} - {b}.{c}) / {s}::DOUBLE)"
    values = {
        "building": ("house_id", f"CASE WHEN {a}.house_id = {b}.house_id THEN 1 ELSE 0 END"),
        "complex": ("complex_id", f"CASE WHEN {a}.complex_id = {b}.complex_id THEN 1 ELSE 0 END"),
        "area": ("area", f"greatest(0.0::DOUBLE, 1 - abs({a}.area - {b}.area) / {a}.area / 0.15::DOUBLE)"),
        "floor": ("floor", f"1.0::DOUBLE / (1 + abs({a}.floor - {b}.floor))"),
        "year": ("year", fade("year", 10.0)),
        "class": ("class_ord", fade("class_ord", 65.0)),
        "finish": ("finish_ord", fade("finish_ord", 75.0)),
        "distance": ("lat", f"exp(-({km}) * 1000 / 500.0::DOUBLE)"),
    }
    top = " + ".join(f"CASE WHEN {known(c)} THEN {deal.FACTOR_WEIGHTS[k]}::DOUBLE * ({v}) ELSE 0 END" for k, (c, v) in values.items())
    return f"(({top}) / ({' + '.join(f'CASE WHEN {known(c)} THEN {deal.FACTOR_WEIGHTS[k]}::DOUBLE ELSE 0 END' for k, (c, _) in values.items())}))"


def _median_sql(pool):
    """(id, v): the weighted median of the most alike of the pairs (id, c_id, ppm2, s)."""
    return f"""SELECT id, min(ppm2) FILTER (WHERE run >= al / 2) AS v FROM (SELECT *, sum(s) OVER (PARTITION BY id ORDER BY ppm2, s ROWS UNBOUNDED PRECEDING) AS run, sum(s) OVER (PARTITION BY id) AS al FROM
  (SELECT * FROM {pool} WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, c_id) <= 20)) GROUP BY 1"""


_W = {k: v / sum(deal.PART_WEIGHTS.values()) for k, v in deal.PART_WEIGHTS.items()}
_SHARE = lambda pairs: "(" + " + ".join(f"coalesce({w}::DOUBLE * {c}, 0)" for w, c in pairs) + ") / nullif(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w}::DOUBLE END" for w, c in pairs) + ", 0)"
_DEAL_SQL = f"""{_HOMES_SQL}, h AS ({hexed(f"(SELECT *, {_ordinal_sql(deal.CLASS_ORDINAL, 'class')} AS class_ord, {_ordinal_sql(deal.FINISH_ORDINAL, 'finish')} AS finish_ord FROM homes WHERE price > 0 AND area > 0)", 'lat', 'lon', 400.0)}),
 k AS (SELECT *, row_number() OVER (PARTITION BY complex_id, rooms4 ORDER BY area, id) AS ar, row_number() OVER (PARTITION BY rooms4, q, r ORDER BY id) AS hr, count(*) OVER (PARTITION BY rooms4, q, r) - 1 AS hn FROM h),
 bp AS (SELECT t.id, c.id AS c_id, c.ppm2, {_similarity_sql('t', 'c')} AS s FROM k t JOIN k c ON t.complex_id = c.complex_id AND t.rooms4 = c.rooms4 AND t.id <> c.id AND abs(c.ar - t.ar) <= 30 AND c.area BETWEEN t.area * 0.85::DOUBLE AND t.area * 1.15::DOUBLE),
 hp AS (SELECT t.id, c.id AS c_id, c.ppm2, {_similarity_sql('t', 'c')} AS s FROM k t JOIN k c ON t.rooms4 = c.rooms4 AND t.q = c.q AND t.r = c.r AND t.id <> c.id AND c.hr <= 61 QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY c.id) <= 60),
 o AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b})" for a, b in ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)))}) v(da, db)),
 near AS (SELECT k.id, k.rooms4, q + da AS q, r + db AS r FROM k, o),
 cells AS (SELECT DISTINCT rooms4, q, r FROM k),
 rp0 AS (SELECT n.rooms4, n.q, n.r, n.id FROM near n JOIN cells USING (rooms4, q, r) QUALIFY row_number() OVER (PARTITION BY n.rooms4, n.q, n.r ORDER BY n.id) <= 60),
 rn AS (SELECT rooms4, q, r, count(*) AS ring_n FROM near GROUP BY 1, 2, 3),
 rp AS (SELECT t.id, c.id AS c_id, c.ppm2, {_similarity_sql('t', 'c')} AS s FROM k t JOIN rp0 USING (rooms4, q, r) JOIN k c ON c.id = rp0.id),
 bm AS ({_median_sql('bp')}), hm AS ({_median_sql('hp')}), rm AS ({_median_sql('rp')}), bn AS (SELECT id, count(*) AS b_n FROM bp GROUP BY 1),
 city AS (SELECT rooms4, quantile_cont(ppm2, 0.5) AS city FROM k GROUP BY 1),
 e AS (SELECT k.*, coalesce(b_n, 0) >= 3 AS b, hn >= 3 AS d0, coalesce(ring_n, 0) >= 5 AS d1, coalesce(ring_n, 0) AS ring_n, CASE WHEN coalesce(b_n, 0) >= 3 THEN bm.v ELSE {_SHARE([(0.35, 'city'), (1.0, '(CASE WHEN hn >= 3 THEN hm.v END)'), (0.7, '(CASE WHEN coalesce(ring_n, 0) >= 5 THEN rm.v END)')])} END AS raw
   FROM k JOIN city USING (rooms4) LEFT JOIN bn ON bn.id = k.id LEFT JOIN bm ON bm.id = k.id LEFT JOIN hm ON hm.id = k.id LEFT JOIN rm ON rm.id = k.id LEFT JOIN rn ON rn.rooms4 = k.rooms4 AND rn.q = k.q AND rn.r = k.r),
 f AS (SELECT *, raw * coalesce({_ordinal_sql(deal.CLASS_FACTOR, 'class')}, 1.0::DOUBLE) * CASE WHEN ceiling IS NULL THEN 1.0::DOUBLE ELSE 1 + greatest(-0.12::DOUBLE, least(0.18::DOUBLE, (ceiling - 2.7::DOUBLE) / 0.10::DOUBLE * 0.06::DOUBLE)) END AS expected FROM e),
 g AS (SELECT *, expected / ppm2 AS di, CASE WHEN year >= 2022 THEN 100.0::DOUBLE WHEN year >= 2018 THEN 80 WHEN year >= 2012 THEN 60 WHEN year >= 2000 THEN 40 WHEN year IS NOT NULL THEN 20 END AS ys, CASE WHEN rating > 0 THEN rating / 5.0::DOUBLE * 100 END AS rat, coalesce(yield_pct, 0) AS yp,
   CASE WHEN n_in_complex <= 3 THEN 90 WHEN n_in_complex <= 8 THEN 60 ELSE 30 END AS su, CASE WHEN age_days <= 7 THEN 90 WHEN age_days <= 30 THEN 60 ELSE 35 END AS ag FROM f),
 p AS (SELECT *, greatest(0, least(100, round_even(50 + (di - 1) * 200, 0))) AS ps, coalesce(round_even({_SHARE([(0.45, 'class_ord'), (0.35, 'ys'), (0.2, 'rat'), (0.12, 'finish_ord')])}, 0), 50) AS qs,
   round_even(greatest(0, least(100, round_even(yp / 15 * 100, 0))) * 0.6::DOUBLE + (su * 0.5::DOUBLE + ag * 0.5::DOUBLE) * 0.4::DOUBLE, 0) AS ms, 100 - CASE WHEN floor = 1 THEN 40 WHEN floor = floors_total THEN 25 ELSE 0 END - CASE WHEN is_owner THEN 0 ELSE 30 END AS ri FROM g)
 SELECT id, round(expected, 4) AS expected, round(di, 6) AS deal_index, CAST(ps AS INTEGER) AS price_score, CAST(qs AS INTEGER) AS quality_score, CAST(ms AS INTEGER) AS market_score, CAST(ri AS INTEGER) AS risk_score,
  CAST(round_even(ps * {_W['price']}::DOUBLE + qs * {_W['quality']}::DOUBLE + ms * {_W['market']}::DOUBLE, 0) AS INTEGER) AS deal,
  CAST(CASE WHEN d0 OR d1 THEN 30 ELSE 0 END + CASE WHEN d0 THEN 10 ELSE 0 END + CASE WHEN class_ord IS NULL THEN 0 ELSE 20 END + CASE WHEN year IS NULL THEN 0 ELSE 15 END + CASE WHEN yp > 0 THEN 15 ELSE 0 END + CASE WHEN rating > 0 THEN 10 ELSE 0 END AS INTEGER) AS confidence,
  CAST(hn AS BIGINT) AS n_hex, CAST(ring_n AS BIGINT) AS n_ring, CASE WHEN b THEN 'building' WHEN d0 AND d1 THEN 'hex+ring+city' WHEN d1 THEN 'ring+city' WHEN d0 THEN 'hex+city' ELSE 'city' END AS source FROM p"""


@book.query("dm_deal_score", _DEAL_SQL)
def dm_deal_score(m):
    return deal.deal_scores(homes(m))


@book.query(
    "dm_comparable_score",
    f"""{_HOMES_SQL}, k AS (SELECT *, {_ordinal_sql(deal.CLASS_ORDINAL, 'class')} AS class_ord, {_ordinal_sql(deal.FINISH_ORDINAL, 'finish')} AS finish_ord, row_number() OVER (PARTITION BY complex_id ORDER BY id) AS n FROM homes)
 SELECT a.id AS a_id, b.id AS b_id, round({_similarity_sql('a', 'b')}, 6) AS score FROM k a JOIN k b ON a.complex_id = b.complex_id AND b.n = a.n + 1""",
)
def dm_comparable_score(m):
    """Each home against the next of its building."""
    ordinals = (deal.lookup(deal.CLASS_ORDINAL, F.col("class")).alias("class_ord"), deal.lookup(deal.FINISH_ORDINAL, F.col("finish")).alias("finish_ord"))
    rows = homes(m).select("id", "complex_id", F.struct("id", "house_id", "complex_id", "area", "floor", "year", *ordinals, "lat", "lon").alias("own"))
    after = F.lead("own").over(Window.partitionBy("complex_id").orderBy("id"))
    return rows.select("own", after.alias("other")).filter("other is not null").select(F.col("own.id").alias("a_id"), F.col("other.id").alias("b_id"), F.round(deal.similarity(F.col("own"), F.col("other")), 6).alias("score"))


# ---- scores of investors and primary offers

_PLACES = {"brazil": 25, "canada": 25, "france": 18, "germany": 14, "china": 10}


@book.query(
    "dm_investment_score",
    f"""{BASE_SQL}, a AS (SELECT id, area, price, lower(coalesce(district, '')) || ' ' || CASE WHEN id % 4 = 0 THEN 'warm mall 2024' WHEN id % 4 = 1 THEN 'security' ELSE '' END AS t, id % 25 AS y, count(*) OVER (PARTITION BY complex_id, rooms4) AS n, CASE WHEN id % 2 = 0 THEN 'garage' ELSE 'storage' END AS kind FROM base WHERE active),
 l AS (SELECT *, CASE {" ".join(f"WHEN contains(t, '{k}') THEN {v}" for k, v in _PLACES.items())} ELSE 0 END AS l0 FROM a),
 s AS (SELECT id, CASE WHEN y >= 20 THEN 25 WHEN y >= 15 THEN 20 WHEN y >= 12 THEN 15 ELSE 5 END AS yield, l0 + CASE WHEN contains(t, 'mall') AND l0 < 25 THEN least(5, 25 - l0) ELSE 0 END AS location, CASE WHEN n <= 2 THEN 20 WHEN n <= 5 THEN 12 ELSE 5 END AS supply,
  least(15, CASE WHEN area IS NULL OR area = 0 THEN 4 WHEN kind = 'garage' THEN CASE WHEN area BETWEEN 13 AND 20 THEN 8 WHEN area < 10 THEN 3 ELSE 5 END WHEN area BETWEEN 6 AND 15 THEN 8 WHEN area < 4 THEN 2 WHEN area > 25 THEN 4 ELSE 6 END + CASE WHEN price * 40 <= 4000000 THEN 7 WHEN price * 40 <= 7000000 THEN 4 ELSE 1 END) AS liquidity,
  least(15, CASE WHEN contains(t, 'warm') THEN 6 ELSE 0 END + CASE WHEN contains(t, 'security') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '20(2[0-9]|3[0-9])') THEN 5 ELSE 0 END) AS quality FROM l)
 SELECT id, CAST(yield AS INTEGER) AS yield, CAST(location AS INTEGER) AS location, CAST(supply AS INTEGER) AS supply, CAST(liquidity AS INTEGER) AS liquidity, CAST(quality AS INTEGER) AS quality, CAST(yield + location + supply + liquidity + quality AS INTEGER) AS total FROM s""",
)
def dm_investment_score(m):
    rows = market.base(m.listings).filter(market.status_condition("active")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("complex_id", market.rooms_bucket())))
    text = F.concat_ws(" ", F.coalesce("district", F.lit("")), F.when(F.col("id") % 4 == 0, "warm mall 2024").when(F.col("id") % 4 == 1, "security").otherwise(""))
    kind = F.when(F.col("id") % 2 == 0, "garage").otherwise("storage")
    score = deal.investment_score(F.col("id") % 25, text, F.col("n"), F.col("area"), F.col("price") * 40, kind, _PLACES, ["mall"])
    return rows.select("id", score.alias("s")).select("id", "s.*")


@book.query(
    "dm_primary_score",
    f"""{BASE_SQL}, s AS (SELECT district, quantile_cont(ppm2, 0.5) AS sec FROM base WHERE ppm2 IS NOT NULL AND archived_at IS NOT NULL GROUP BY 1),
 a AS (SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE complex_id END AS dev, CAST(1998 + id % 6 AS INTEGER) AS y, CASE WHEN id % 7 = 0 THEN 'house completed' WHEN id % 7 = 1 THEN 'start of sales' ELSE '' END AS t, ppm2, sec FROM base LEFT JOIN s ON base.district = s.district WHERE active),
 b AS (SELECT id, CASE WHEN dev IS NULL THEN 10 WHEN dev < 10 THEN 30 ELSE 18 END AS developer, CASE WHEN contains(t, 'completed') THEN 20 WHEN contains(t, 'start of sales') THEN 5 WHEN y - 2000 <= 0 THEN 18 WHEN y - 2000 = 1 THEN 14 ELSE 8 END AS stage,
  CASE WHEN ppm2 IS NULL OR sec IS NULL OR sec <= 0 THEN 12 WHEN (sec - ppm2) / sec * 100 > 40 THEN 15 WHEN (sec - ppm2) / sec * 100 >= 15 THEN 30 WHEN (sec - ppm2) / sec * 100 >= 5 THEN 20 WHEN (sec - ppm2) / sec * 100 >= -5 THEN 10 ELSE 5 END AS discount FROM a)
 SELECT id, CAST(developer AS INTEGER) AS developer, CAST(stage AS INTEGER) AS stage, CAST(discount AS INTEGER) AS discount, CAST(least(100, round_even((developer + stage + discount) * 100 / 80.0::DOUBLE, 0)) AS INTEGER) AS total FROM b""",
)
def dm_primary_score(m):
    rows = market.base(m.listings).withColumn("ppm2", market.ppm2())
    second = rows.filter("ppm2 is not null and archived_at is not null").groupBy("district").agg(F.percentile("ppm2", F.lit(0.5)).alias("sec"))
    developer = F.when(F.col("id") % 5 != 0, F.col("complex_id").cast("string"))
    text = F.when(F.col("id") % 7 == 0, "house completed").when(F.col("id") % 7 == 1, "start of sales").otherwise("")
    score = deal.primary_score(developer, F.col("complex_id") < 10, (F.col("id") % 6 + 1998).cast("int"), 2000, text, F.col("ppm2"), F.col("sec"))
    return rows.filter(market.status_condition("active")).join(F.broadcast(second), "district", "left").select("id", score.alias("s")).select("id", "s.*")  # at most one row for each nation


@book.query(
    "dm_ranking_quality",
    """WITH t AS (SELECT o_orderkey AS k, o_totalprice AS s, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, k) AS i, count(*) OVER () AS n, sum(y) OVER (ORDER BY s DESC, k ROWS UNBOUNDED PRECEDING) AS run, avg(y) OVER () AS b FROM t)
 SELECT round(avg(run / i) FILTER (WHERE y = 1), 6) AS average_precision, round(avg(y) FILTER (WHERE i <= greatest(1, floor(n * 0.05::DOUBLE))) / nullif(max(b), 0), 6) AS lift_5, round(avg(y) FILTER (WHERE i <= greatest(1, floor(n * 0.1::DOUBLE))) / nullif(max(b), 0), 6) AS lift_10,
  round(avg(y) FILTER (WHERE i <= greatest(1, floor(n * 0.2::DOUBLE))) / nullif(max(b), 0), 6) AS lift_20 FROM r""",
)
def dm_ranking_quality(m):
    rows = m.orders.select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("y"))
    return scoring.average_precision(rows, "o_totalprice", "y", "o_orderkey").crossJoin(scoring.lift_at(rows, "o_totalprice", "y", "o_orderkey"))  # one row each
