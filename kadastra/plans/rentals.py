"""The rental index, price cells and the audit of names as registered queries. Listings stand for flats to let: a third of them by the day, the archived ones as removed."""

from __future__ import annotations

from pyspark.sql import functions as F

from kadastra.functions import geo
from kadastra.operators import audits, rental_index
from kadastra.plans.book import Book
from kadastra.sources.market import AS_OF, LISTINGS_SQL, as_of

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
NOW = f"TIMESTAMP '{AS_OF}'"
_KEY = ", ".join(rental_index.KEY)
_LEAST = "CASE scope " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in rental_index.LEAST.items()) + " END"


def _scoped(rows: str, extra: str) -> str:
    """Rows once for each known scope and furnishing label."""
    names = {"complex": "CAST(complex_id AS VARCHAR)", "district": "nullif(district, '')", "city": "city", "hex": "hex_id"}
    own = " UNION ALL ".join(f"SELECT '{s}' AS scope, {n} AS name, rooms, rent_period, furnishing AS f, {extra} FROM {rows} WHERE {n} IS NOT NULL" for s, n in names.items())
    return f"(SELECT scope, name, rooms, rent_period, NULL AS furnishing, * EXCLUDE (scope, name, rooms, rent_period, f) FROM ({own}) UNION ALL SELECT scope, name, rooms, rent_period, f, * EXCLUDE (scope, name, rooms, rent_period, f) FROM ({own}) WHERE f IS NOT NULL)"


@book.query(
    "ag_rental_index_scopes",
    f"""WITH {LISTINGS_SQL}, b AS (SELECT id, 'astana' AS city, district, CASE WHEN id % 5 <> 0 THEN complex_id END AS complex_id, CASE WHEN id % 7 <> 0 THEN (id % 9) || ':' || (id % 4) END AS hex_id, least(rooms, 3) AS rooms, CASE WHEN id % 3 = 0 THEN 'daily' ELSE 'monthly' END AS rent_period,
   CASE id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'full' END AS furnishing, floor(price / 10) AS price, area, is_active FROM listings),
 ob AS (SELECT b.* EXCLUDE (price), price + j AS price, {NOW} - to_hours(CAST((id * 7 + j * 41) % 130 * 24 + id % 24 AS INTEGER)) AS observed_at FROM b, range(0, 3) AS t(j)),
 lv AS (SELECT *, {NOW} - to_hours(CAST(id % 90 AS INTEGER)) AS last_seen FROM b WHERE is_active AND id % 90 <= 72),
 dl AS (SELECT * FROM (SELECT * EXCLUDE (is_active), 0 AS live FROM ob WHERE rent_period = 'daily' UNION ALL BY NAME SELECT * EXCLUDE (is_active, last_seen), last_seen - to_hours(CAST(id % 5 AS INTEGER)) AS observed_at, 1 AS live FROM lv WHERE rent_period = 'daily' AND id % 90 + id % 5 <= 72 AND id % 13 <> 0)
   WHERE observed_at <= {NOW} AND observed_at >= {NOW} - INTERVAL 90 DAYS QUALIFY row_number() OVER (PARTITION BY id ORDER BY observed_at DESC, live DESC, price DESC) = 1),
 mo AS (SELECT * EXCLUDE (is_active, last_seen), last_seen AS observed_at FROM lv WHERE rent_period = 'monthly'),
 al AS (SELECT * EXCLUDE (live) FROM dl UNION ALL BY NAME SELECT * FROM mo),
 sp AS (SELECT *, 30 AS window_days FROM al WHERE observed_at >= {NOW} - INTERVAL 30 DAYS UNION ALL SELECT *, 90 FROM al WHERE rent_period = 'daily'),
 sr AS (SELECT * FROM {_scoped("sp", "window_days, price, CASE WHEN area BETWEEN 20 AND 300 THEN price / area END AS ppm2, observed_at")}),
 su AS (SELECT {_KEY}, window_days, count(*) AS sample_count, floor(avg(price)) AS avg_price, min(observed_at) AS oldest, max(observed_at) AS newest, floor(quantile_cont(price, 0.5)) AS median_price, floor(quantile_cont(price, 0.25)) AS p25_price, floor(quantile_cont(price, 0.75)) AS p75_price, floor(quantile_cont(ppm2, 0.5)) AS price_per_sqm
   FROM sr GROUP BY ALL HAVING count(*) >= {_LEAST} AND max(observed_at) >= {NOW} - INTERVAL 72 HOURS),
 ch AS (SELECT * FROM su QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY window_days) = 1),
 ac AS (SELECT {_KEY}, count(DISTINCT id) AS active_supply FROM {_scoped("lv", "id")} GROUP BY ALL),
 rm AS (SELECT *, {NOW} - to_hours(CAST(id % 40 * 24 AS INTEGER)) AS gone FROM b WHERE NOT is_active AND rent_period = 'monthly' AND id % 40 <= 30 AND id % 6 <> 0 AND id % 80 <= 72 AND id % 50 >= 2 AND id % 50 * 24 >= id % 80),
 rs AS (SELECT * FROM {_scoped("rm", "id % 50 AS up")}),
 rc AS (SELECT {_KEY}, count(*) AS gone, quantile_cont(up::DOUBLE, 0.5) AS up FROM rs GROUP BY ALL),
 jo AS (SELECT ch.*, active_supply, gone, up, ch.rent_period = 'monthly' AND coalesce(gone >= {_LEAST.replace("scope", "ch.scope")}, FALSE) AS told FROM ch JOIN ac ON ch.scope = ac.scope AND ch.name = ac.name AND ch.rooms = ac.rooms AND ch.rent_period = ac.rent_period AND ch.furnishing IS NOT DISTINCT FROM ac.furnishing
   LEFT JOIN rc ON ch.scope = rc.scope AND ch.name = rc.name AND ch.rooms = rc.rooms AND ch.rent_period = rc.rent_period AND ch.furnishing IS NOT DISTINCT FROM rc.furnishing)
 SELECT {_KEY}, window_days, sample_count, CAST(median_price AS BIGINT) AS median_price, CAST(avg_price AS BIGINT) AS avg_price, CAST(p25_price AS BIGINT) AS p25_price, CAST(p75_price AS BIGINT) AS p75_price, CAST(price_per_sqm AS BIGINT) AS price_per_sqm, epoch_us(oldest) // 1000000 AS oldest, epoch_us(newest) // 1000000 AS newest, active_supply,
   CASE WHEN told THEN round(up, 1) END AS median_dom_days, CASE WHEN told THEN gone END AS gone_30d, CASE WHEN told THEN round(active_supply / gone, 2) END AS months_of_supply FROM jo""",
)
def ag_rental_index_scopes(m):
    i = F.col("id")
    before = lambda hours: F.timestamp_micros(F.unix_micros(as_of()) - hours.cast("long") * 3_600_000_000)
    base = m.listings.select(
        "id", F.lit("astana").alias("city"), "district", F.when(i % 5 != 0, F.col("complex_id")).alias("complex_id"), F.when(i % 7 != 0, F.concat_ws(":", (i % 9).cast("string"), (i % 4).cast("string"))).alias("hex_id"), F.least("rooms", F.lit(3)).alias("rooms"),
        F.when(i % 3 == 0, "daily").otherwise("monthly").alias("rent_period"), F.when(i % 4 == 0, "none").when(i % 4 == 1, "full").alias("furnishing"), F.floor(F.col("price") / 10).cast("double").alias("price"), "area", "is_active",
    )
    j = F.col("j")
    observations = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("price", F.col("price") + j).withColumn("observed_at", before((i * 7 + j * 41) % 130 * 24 + i % 24))
    live = base.filter("is_active").withColumn("last_seen", before(i % 90)).withColumn("episode_last_seen", F.when(i % 13 != 0, before(i % 90 + i % 5))).withColumn("episode_started", before(i % 90 + 240))
    gone = i % 40 * 24
    removed = base.filter("not is_active").withColumns(
        {"archived_at": before(gone), "first_proof": before(gone + i % 50 * 24), "last_proof": before(gone + i % 80), "episode_last_seen": before(gone), "episode_started": before(gone + 2400), "proofs": F.when(i % 6 == 0, 1).otherwise(3)}
    )
    seconds = lambda c: F.unix_seconds(c).alias(c)
    out = rental_index.build(observations, live, removed, as_of())
    return out.select(*[seconds(c) if c in ("oldest", "newest") else c for c in out.columns])


@book.query(
    "ag_hex_price_cells",
    f"""WITH {LISTINGS_SQL}, xy AS (SELECT *, (lon - {geo.LON0}) * {geo.M_LON!r}::DOUBLE AS x, (lat - {geo.LAT0}) * {geo.M_LAT}::DOUBLE AS y FROM listings WHERE NOT is_duplicate AND price > 50000 AND area > 0),
 ax AS (SELECT *, (x * (sqrt(3) / 3) - y / 3) / 300 AS fq, y * (2 / 3.0::DOUBLE) / 300 AS fr FROM xy), rd AS (SELECT *, round_even(fq, 0) AS a, round_even(fr, 0) AS b, round_even(-fq - fr, 0) AS g FROM ax),
 o AS (SELECT price / area AS u, coalesce(is_active, TRUE) AS live, archived_at, CAST(CASE WHEN abs(a - fq) > abs(b - fr) AND abs(a - fq) > abs(g + fq + fr) THEN -b - g ELSE a END AS BIGINT) AS q,
   CAST(CASE WHEN NOT (abs(a - fq) > abs(b - fr) AND abs(a - fq) > abs(g + fq + fr)) AND abs(b - fr) > abs(g + fq + fr) THEN -a - g ELSE b END AS BIGINT) AS r FROM rd),
 c AS (SELECT q, r, count(*) FILTER (WHERE live) AS n, avg(u) FILTER (WHERE live) AS m, count(*) FILTER (WHERE NOT live AND archived_at > TIMESTAMP '1995-06-01' - INTERVAL 900 DAYS) AS old_n, avg(u) FILTER (WHERE NOT live AND archived_at > TIMESTAMP '1995-06-01' - INTERVAL 900 DAYS) AS old_m FROM o GROUP BY 1, 2),
 d AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, -1), (3, 0, -1), (4, -1, 0), (5, -1, 1), (6, 0, 1)) t(place, dq, dr)),
 w AS (SELECT q, r, CAST(place AS INTEGER) AS place, q + dq AS c_q, r + dr AS c_r FROM c, d)
 SELECT w.q, w.r, place, c_q, c_r, coalesce(CASE WHEN coalesce(n, 0) = 0 AND old_n > 0 THEN old_n ELSE n END, 0) AS n, round(CASE WHEN coalesce(n, 0) = 0 AND old_n > 0 THEN old_m ELSE m END, 4) AS avg_m2, coalesce(coalesce(n, 0) = 0 AND old_n > 0, FALSE) AS archived FROM w LEFT JOIN c ON c.q = c_q AND c.r = c_r""",
)
def ag_hex_price_cells(m):
    return audits.price_cells(m.listings, F.lit("1995-06-01 00:00:00").cast("timestamp"), 300.0, 900, 50_000.0)


@book.query(
    "dm_street_audit",
    r"""WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN 'ЖК Абай ' || (c_custkey % 40) WHEN 1 THEN 'Сарыарка' WHEN 2 THEN 'жк' WHEN 3 THEN 'Q' || (c_custkey % 10) ELSE 'Park ' || (c_custkey % 60) END AS name, c_custkey % 11 = 0 AS card, c_custkey % 5 = 0 AS other FROM customer WHERE c_custkey % 13 <> 0),
 l AS (SELECT k, lower(trim(regexp_replace(name, '^\s*(ЖК|жк)\s+', ''))) AS bare, name, other FROM c WHERE NOT card),
 o AS (SELECT n.name AS complex_name, CASE o_orderkey % 4 WHEN 0 THEN 'Сарыарка р-н, абай ' || (o_custkey % 40) WHEN 1 THEN n.name || ' р-н' ELSE lower(n.name) || ' 5' END AS address FROM orders JOIN (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'ЖК Абай ' || (c_custkey % 40) WHEN 1 THEN 'Сарыарка' WHEN 2 THEN 'жк' WHEN 3 THEN 'Q' || (c_custkey % 10) ELSE 'Park ' || (c_custkey % 60) END AS name FROM customer) n ON n.c_custkey = o_custkey),
 j AS (SELECT k, bare, other, count(*) AS listings, count(*) FILTER (WHERE contains(lower(address), bare) AND NOT regexp_matches(substr(lower(address), instr(lower(address), bare) + length(bare)), '^\s+(р-н|район|ауданы|аудан)')) AS street_hits FROM l JOIN o ON lower(trim(complex_name)) = lower(trim(name)) GROUP BY 1, 2, 3 HAVING count(*) >= 3),
 v AS (SELECT *, street_hits / listings AS share, bare = 'жк' OR (length(bare) < 4 AND NOT other) AS junk FROM j)
 SELECT k AS id, listings, street_hits, round(share, 4) AS share, CASE WHEN junk AND share < 0.6 THEN 'junk' ELSE 'street' END AS reason FROM v WHERE junk OR (share >= 0.6 AND bare <> 'сарыарка')""",
)
def dm_street_audit(m):
    """Customers as complexes and orders as their listings, some of which have the name in the address."""
    k = F.col("c_custkey")
    name = F.when(k % 7 == 0, F.concat(F.lit("ЖК Абай "), (k % 40).cast("string"))).when(k % 7 == 1, "Сарыарка").when(k % 7 == 2, "жк").when(k % 7 == 3, F.concat(F.lit("Q"), (k % 10).cast("string"))).otherwise(F.concat(F.lit("Park "), (k % 60).cast("string")))
    complexes = m.customer.filter(k % 13 != 0).select(k.alias("id"), name.alias("name"), F.lit(False).alias("is_street"), (k % 11 == 0).alias("card"), (k % 5 == 0).alias("other_card"))
    named = m.orders.join(m.customer.select(k, name.alias("complex_name")), F.col("o_custkey") == k)
    kind = F.col("o_orderkey") % 4
    address = F.when(kind == 0, F.concat(F.lit("Сарыарка р-н, абай "), (F.col("o_custkey") % 40).cast("string"))).when(kind == 1, F.concat("complex_name", F.lit(" р-н"))).otherwise(F.concat(F.lower("complex_name"), F.lit(" 5")))
    return audits.street_audit(complexes, named.select("complex_name", address.alias("address")))
