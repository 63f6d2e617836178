"""Market dashboards as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kadastra.operators import market
from kadastra.plans.book import Book
from kadastra.sources.market import AS_OF, CHANGES_SQL, LISTINGS_SQL, as_of

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

NOW = f"TIMESTAMP '{AS_OF}'"
BASE_SQL = f"""WITH {LISTINGS_SQL}, base AS (
  SELECT *, CASE WHEN area > 0 AND price > 0 THEN price / area END AS ppm2, least(rooms, 4) AS rooms4,
    CASE WHEN area < 40 THEN '<40' WHEN area < 60 THEN '40-59' WHEN area < 80 THEN '60-79' WHEN area < 120 THEN '80-119' WHEN area >= 120 THEN '120+' ELSE 'unknown' END AS area_bucket,
    (epoch_us(archived_at) - epoch_us(first_seen)) / 86400000000.0::DOUBLE AS life,
    is_active IS DISTINCT FROM FALSE AS active
  FROM listings WHERE NOT coalesce(is_duplicate, FALSE)
    AND NOT coalesce(archived_at IS NOT NULL AND (epoch_us(least(last_seen, archived_at)) - epoch_us(first_seen)) / 86400000000.0 < 2, FALSE))"""
WITH_CHANGES = f"{BASE_SQL}, {CHANGES_SQL}"


def start(n):
    return f"({NOW} - INTERVAL {n} DAY)"


def alive(t):
    return f"(first_seen <= {t} AND (archived_at IS NULL OR archived_at > {t}))"


def gone(n):
    return f"(archived_at IS NOT NULL AND archived_at > {start(n)} AND archived_at <= {NOW})"


def _corridors(by):
    return f"""{BASE_SQL}, r AS (SELECT {by} AS segment, ppm2 FROM base WHERE active AND ppm2 IS NOT NULL),
e AS (SELECT segment, quantile_cont(ppm2, 0.01) AS lo, quantile_cont(ppm2, 0.99) AS hi FROM r GROUP BY 1)
SELECT r.segment, count(*) AS n, round(quantile_cont(ppm2, 0.25), 4) AS p25, round(quantile_cont(ppm2, 0.5), 4) AS p50, round(quantile_cont(ppm2, 0.75), 4) AS p75
FROM r JOIN e ON r.segment IS NOT DISTINCT FROM e.segment WHERE ppm2 BETWEEN lo AND hi GROUP BY 1 HAVING count(*) >= 20"""


@book.query("price_corridors", _corridors("housing_class"))
def price_corridors(m):
    return market.price_corridors(m.listings, "housing_class")


@book.query("price_corridors_by_district", _corridors("district"))
def price_corridors_by_district(m):
    return market.price_corridors(m.listings, "district")


@book.query(
    "overview_kpis",
    f"""{BASE_SQL} SELECT count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE first_seen > {start(90)} AND first_seen <= {NOW}) AS new_supply,
 count(*) FILTER (WHERE {gone(90)}) AS exits, round(quantile_cont(price, 0.5) FILTER (WHERE active), 4) AS median_price,
 round(quantile_cont(ppm2, 0.5) FILTER (WHERE active), 4) AS median_ppm2, count(DISTINCT complex_id) FILTER (WHERE active) AS complexes,
 count(DISTINCT district) FILTER (WHERE active) AS districts, round(quantile_cont(life, 0.5) FILTER (WHERE {gone(90)}), 4) AS median_exit_days FROM base""",
)
def overview_kpis(m):
    return market.overview(m.listings, as_of(), 90)


@book.query(
    "overview_kpis_filtered",
    f"""{BASE_SQL} SELECT count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE first_seen > {start(365)} AND first_seen <= {NOW}) AS new_supply,
 count(*) FILTER (WHERE {gone(365)}) AS exits, round(quantile_cont(price, 0.5) FILTER (WHERE active), 4) AS median_price,
 round(quantile_cont(ppm2, 0.5) FILTER (WHERE active), 4) AS median_ppm2, count(DISTINCT complex_id) FILTER (WHERE active) AS complexes,
 count(DISTINCT district) FILTER (WHERE active) AS districts, round(quantile_cont(life, 0.5) FILTER (WHERE {gone(365)}), 4) AS median_exit_days
 FROM base WHERE housing_class = 'BUILDING' AND rooms >= 4""",
)
def overview_kpis_filtered(m):
    chosen = market.normalize_filters({"period": "365", "class": "BUILDING", "rooms": 4, "status": "nonsense"})
    return market.overview(m.listings, as_of(), chosen.period_days, chosen)


@book.query("supply_structure", f"{BASE_SQL}, s AS (SELECT rooms4 AS segment, count(*) AS n FROM base WHERE active GROUP BY 1) SELECT segment, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 4) AS share_pct FROM s")
def supply_structure(m):
    return market.supply_structure(m.listings, market.rooms_bucket())


@book.query(
    "new_against_exits",
    f"""{BASE_SQL}, a AS (SELECT CAST(date_trunc('week', first_seen) AS DATE) AS bucket, count(*) AS new_count FROM base GROUP BY 1),
 b AS (SELECT CAST(date_trunc('week', archived_at) AS DATE) AS bucket, count(*) AS exit_count FROM base WHERE archived_at IS NOT NULL GROUP BY 1)
 SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(new_count, 0) AS new_count, coalesce(exit_count, 0) AS exit_count, coalesce(new_count, 0) - coalesce(exit_count, 0) AS net
 FROM a FULL JOIN b ON a.bucket = b.bucket""",
)
def new_against_exits(m):
    return market.new_against_exits(m.listings)


@book.query(
    "market_dynamics_active",
    f"""{BASE_SQL}, c AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '2000-06-30', INTERVAL 1 DAY)) AS DATE) AS d)
 SELECT d, count(id) AS active FROM c LEFT JOIN base ON first_seen <= d AND (archived_at IS NULL OR archived_at > d) GROUP BY 1""",
)
def market_dynamics_active(m):
    return market.active_by_day(m.listings, "1998-01-01", "2000-06-30")


_ABSORB = f"count(*) FILTER (WHERE {alive(start(90))}) AS n_start, count(*) FILTER (WHERE {alive(NOW)}) AS n_now, count(*) FILTER (WHERE {gone(90)}) AS exits"
_ABSORBED = "round(exits * 100.0::DOUBLE / nullif(n_start, 0), 4) AS exit_rate_pct, round(CASE WHEN exits > 0 THEN n_now / (exits * 30.0::DOUBLE / 90) END, 4) AS months_of_stock, CASE WHEN exits > 0 THEN 'OK' ELSE 'INSUFFICIENT' END AS status"


@book.query("absorption_kpis", f"{BASE_SQL}, a AS (SELECT {_ABSORB} FROM base) SELECT *, {_ABSORBED} FROM a")
def absorption_kpis(m):
    return market.absorption(m.listings, as_of(), 90)


@book.query("absorption_by_district", f"{BASE_SQL}, a AS (SELECT district AS segment, {_ABSORB} FROM base GROUP BY 1) SELECT *, {_ABSORBED} FROM a")
def absorption_by_district(m):
    return market.absorption(m.listings, as_of(), 90, "district")


@book.query(
    "supply_funnel",
    f"""{BASE_SQL}, a AS (SELECT count(*) FILTER (WHERE {alive(start(90))}) AS active_start, count(*) FILTER (WHERE first_seen > {start(90)} AND first_seen <= {NOW}) AS new_count,
 count(*) FILTER (WHERE {gone(90)} AND archived_at >= first_seen) AS exit_count, count(*) FILTER (WHERE {alive(NOW)}) AS active_measured FROM base)
 SELECT *, active_start + new_count - exit_count AS active_end, abs(active_start + new_count - exit_count - active_measured) <= greatest(5, CAST(round_even(active_start * 0.005, 0) AS BIGINT)) AS consistent FROM a""",
)
def supply_funnel(m):
    return market.supply_funnel(m.listings, as_of(), 90)


@book.query(
    "segment_exit_speed",
    f"""{BASE_SQL} SELECT housing_class AS segment, {_ABSORB}, round(quantile_cont(life, 0.5) FILTER (WHERE {gone(90)}), 4) AS median_dom, count(*) FILTER (WHERE {alive(start(90))}) < 20 AS insufficient FROM base GROUP BY 1""",
)
def segment_exit_speed(m):
    return market.segment_exit_speed(m.listings, "housing_class", as_of(), 90)


@book.query(
    "price_vs_liquidity",
    f"""{BASE_SQL}, a AS (SELECT district, housing_class, count(*) FILTER (WHERE {alive(start(90))}) AS n_start, count(*) FILTER (WHERE {gone(90)}) AS exits,
 round(quantile_cont(ppm2, 0.5) FILTER (WHERE {alive(NOW)}), 4) AS median_ppm2 FROM base GROUP BY 1, 2) SELECT *, round(exits * 100.0::DOUBLE / n_start, 4) AS exit_rate_pct FROM a WHERE n_start >= 20""",
)
def price_vs_liquidity(m):
    return market.price_vs_liquidity(m.listings, as_of(), 90)


@book.query(
    "segment_table",
    f"""{WITH_CHANGES}, f AS (SELECT DISTINCT listing_id FROM changes WHERE new_price < old_price AND changed_at > {start(90)} AND changed_at <= {NOW})
 SELECT district, count(*) FILTER (WHERE {alive(NOW)}) AS n_active, round(quantile_cont(ppm2, 0.5) FILTER (WHERE {alive(NOW)}), 4) AS median_ppm2,
 round(avg(CASE WHEN listing_id IS NULL THEN 0 ELSE 1 END) FILTER (WHERE {alive(NOW)}), 6) AS drop_share, round(quantile_cont(life, 0.5) FILTER (WHERE {gone(90)}), 4) AS median_dom
 FROM base LEFT JOIN f ON id = listing_id GROUP BY 1""",
)
def segment_table(m):
    return market.segment_table(m.listings, m.changes, as_of(), 90)


@book.query(
    "price_drop_buckets",
    f"""{WITH_CHANGES}, f AS (SELECT listing_id, arg_min(old_price, seq) AS b, arg_max(new_price, seq) AS a FROM changes WHERE old_price IS NOT NULL GROUP BY 1),
 d AS (SELECT (b - a) / b * 100 AS dr FROM base LEFT JOIN f ON id = listing_id WHERE archived_at IS NOT NULL)
 SELECT CASE WHEN dr IS NULL OR dr <= 0 THEN 'none' WHEN dr < 5 THEN '<5' WHEN dr <= 10 THEN '5-10' ELSE '>10' END AS bucket, count(*) AS n FROM d GROUP BY 1""",
)
def price_drop_buckets(m):
    return market.price_drop_buckets(m.listings, m.changes)


@book.query(
    "bargaining_by_segment",
    f"""{WITH_CHANGES}, f AS (SELECT listing_id, arg_min(old_price, seq) AS b, min(new_price) AS lo FROM changes WHERE old_price IS NOT NULL GROUP BY 1),
 d AS (SELECT district AS segment, CASE WHEN lo < b THEN (b - lo) / b * 100 END AS x FROM base LEFT JOIN f ON id = listing_id
   WHERE NOT EXISTS (SELECT 1 FROM listings r WHERE r.id = base.id AND r.archived_at IS NOT NULL AND r.last_seen > r.archived_at))
 SELECT segment, count(*) AS n, round(avg(CASE WHEN x IS NULL THEN 0 ELSE 1 END), 6) AS cut_share, round(quantile_cont(x, 0.5), 4) AS median_discount, round(quantile_cont(x, 0.9), 4) AS p90_discount FROM d GROUP BY 1""",
)
def bargaining_by_segment(m):
    return market.bargaining(m.listings, m.changes, "district")


@book.query(
    "layout_demand_matrix",
    f"""{BASE_SQL}, c AS (SELECT rooms4 AS rooms, area_bucket, count(*) FILTER (WHERE {alive(start(365))}) AS n_start, count(*) FILTER (WHERE {alive(start(365))} AND {gone(365)}) AS exits FROM base GROUP BY 1, 2),
 s AS (SELECT *, round(n_start * 100.0::DOUBLE / nullif(sum(n_start) OVER (), 0), 4) AS share_pct,
   round((CAST(exits AS DOUBLE) / nullif(n_start, 0)) / nullif(CAST(sum(exits) OVER () AS DOUBLE) / nullif(sum(n_start) OVER (), 0), 0), 4) AS demand_index FROM c)
 SELECT *, CASE WHEN n_start < 20 THEN 'little data' WHEN demand_index >= 1.15 THEN CASE WHEN share_pct < 10 THEN 'deficit' ELSE 'sells fast' END
   WHEN demand_index <= 0.85 THEN CASE WHEN share_pct >= 10 THEN 'surplus' ELSE 'slow' END ELSE 'balanced' END AS verdict FROM s""",
)
def layout_demand_matrix(m):
    return market.layout_demand(m.listings, as_of(), 365)


@book.query(
    "short_lived_stats",
    f"""WITH {LISTINGS_SQL}, s AS (SELECT district, CASE WHEN archived_at IS NOT NULL AND (epoch_us(least(last_seen, archived_at)) - epoch_us(first_seen)) / 86400000000.0 < 2 THEN 1 ELSE 0 END AS sl FROM listings WHERE NOT is_duplicate)
 SELECT district, count(*) AS n, count(*) FILTER (WHERE sl = 1) AS n_short, round(avg(sl), 6) AS short_share FROM s GROUP BY 1""",
)
def short_lived_stats(m):
    return market.short_lived_stats(m.listings)


_CELLS = f"""{BASE_SQL}, cells AS (SELECT CAST(date_trunc('week', first_seen) AS DATE) AS week, district, rooms4 AS rooms, count(CASE WHEN area > 0 THEN 1 END) AS n, quantile_cont(CASE WHEN area > 0 THEN price / area END, 0.5) AS med
  FROM base GROUP BY ALL HAVING count(CASE WHEN area > 0 THEN 1 END) > 0)"""


@book.query(
    "chain_price_index",
    f"""{_CELLS}, p AS (SELECT week, row_number() OVER (ORDER BY week) AS i FROM (SELECT DISTINCT week FROM cells)),
 c AS (SELECT cells.*, i FROM cells JOIN p USING (week) WHERE n >= 2),
 l AS (SELECT c.i, sum(q.n * c.med) / sum(q.n * q.med) AS link, count(*) AS common FROM c JOIN c q ON c.i = q.i + 1 AND c.district = q.district AND c.rooms = q.rooms GROUP BY 1)
 SELECT week, round(100 * exp(sum(ln(coalesce(link, 1.0))) OVER (ORDER BY week)), 4) AS index_value, link IS NOT NULL AS linked, coalesce(common, 0) AS common_cells FROM p LEFT JOIN l ON p.i = l.i""",
)
def chain_price_index(m):
    return market.chain_index(market.cells_by_week(m.listings), ["district", "rooms"], 2)


@book.query(
    "price_trend_by_day",
    f"""WITH {CHANGES_SQL}, p AS (SELECT CAST(changed_at AS DATE) AS day, (new_price - old_price) / old_price * 100 AS x FROM changes WHERE old_price IS NOT NULL AND old_price > 0 AND new_price <> old_price)
 SELECT day, count(*) FILTER (WHERE x > 0) AS n_up, count(*) FILTER (WHERE x < 0) AS n_down, round(avg(x) FILTER (WHERE x > 0), 4) AS mean_up, round(avg(x) FILTER (WHERE x < 0), 4) AS mean_down FROM p GROUP BY 1""",
)
def price_trend_by_day(m):
    return market.price_trend(m.changes)


@book.query(
    "floor_performance",
    f"""{BASE_SQL} SELECT CASE floor WHEN 1 THEN 'first' WHEN 9 THEN 'last' ELSE 'middle' END AS position, count(*) AS n, round(quantile_cont(ppm2, 0.5), 4) AS median_ppm2, round(avg(floor(life)), 4) AS mean_dom FROM base GROUP BY 1""",
)
def floor_performance(m):
    return market.floor_performance(m.listings)


@book.query("district_rooms_prices", f"{BASE_SQL} SELECT district, rooms4 AS rooms, count(*) AS n, round(quantile_cont(ppm2, 0.5), 4) AS median_ppm2 FROM base WHERE active GROUP BY 1, 2")
def district_rooms_prices(m):
    return market.district_rooms_prices(m.listings)


@book.query(
    "complex_stats",
    f"""{WITH_CHANGES}, f AS (SELECT DISTINCT listing_id FROM changes WHERE new_price < old_price AND changed_at > {start(30)} AND changed_at <= {NOW})
 SELECT complex_id, count(*) FILTER (WHERE active) AS n_active, round(avg(ppm2) FILTER (WHERE active), 4) AS avg_ppm2,
 round(avg((epoch_us({NOW}) - epoch_us(first_seen)) / 86400000000.0::DOUBLE) FILTER (WHERE active), 4) AS avg_dom_days,
 round(avg(CASE WHEN listing_id IS NULL THEN 0 ELSE 1 END) FILTER (WHERE active), 6) AS price_drop_share
 FROM base LEFT JOIN f ON id = listing_id GROUP BY 1 HAVING count(*) FILTER (WHERE active) > 0""",
)
def complex_stats(m):
    return market.complex_stats(m.listings, m.changes, as_of(), 30)


@book.query(
    "price_as_of",
    f"""{WITH_CHANGES}, u AS (SELECT listing_id, arg_max(new_price, seq) AS p FROM changes WHERE changed_at <= {NOW} GROUP BY 1), f AS (SELECT listing_id, first(old_price ORDER BY seq) AS o FROM changes GROUP BY 1)
 SELECT id, coalesce(p, o, price) AS price_at FROM listings LEFT JOIN u ON u.listing_id = id LEFT JOIN f ON f.listing_id = id""",
)
def price_as_of(m):
    return market.price_as_of(m.listings, m.changes, as_of()).select("id", "price_at")


@book.query(
    "data_freshness",
    """SELECT 'orders' AS source, max(o_orderdate)::DATE AS latest, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', max(l_shipdate)::DATE, count(*) FROM lineitem UNION ALL SELECT 'events', max(ts)::DATE, count(*) FROM events""",
)
def data_freshness(m):
    parts = [(m.orders, "orders", "o_orderdate"), (m.lineitem, "lineitem", "l_shipdate"), (m.events, "events", "ts")]
    frames = [df.agg(F.to_date(F.max(c)).alias("latest"), F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("source"), "latest", "n") for df, n, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
