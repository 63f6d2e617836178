"""Rental index over several scopes at once: hexagon, complex, district and city, each with and without furnishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra.operators import quantiles
from kadastra.shared import cut

# Windows in days, hours that a price stays fresh, least samples by scope, sane areas, bounds of a removal.
DAILY_WINDOWS, MONTHLY_WINDOW, FRESH_HOURS = (30, 90), 30, 72
LEAST = {"hex": 5, "complex": 5, "district": 10, "city": 10}
AREAS = (20, 300)
REMOVED_DAYS, LEAST_DAYS_UP, LEAST_PROOFS = 30, 2, 2
KEY = ["scope", "name", "rooms", "rent_period", "furnishing"]


def _hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000.0)


def scoped(rows: DataFrame) -> DataFrame:
    """rows once for each scope whose name they know, for all furnishings (null) and for their own, if it is known."""
    names = {"complex": F.col("complex_id").cast("string"), "district": F.nullif("district", F.lit("")), "city": F.col("city"), "hex": F.col("hex_id")}
    each = F.array(*[F.struct(F.lit(s).alias("scope"), n.alias("name")) for s, n in names.items()])
    labels = F.when(F.col("furnishing").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit(None).cast("string"), F.col("furnishing")))
    wide = rows.withColumn("_s", F.explode(F.filter(each, lambda s: s["name"].isNotNull()))).withColumn("furnishing", F.explode(labels))
    return wide.select("_s.scope", "_s.name", "*").drop("_s")


def latest_daily(observations: DataFrame, live: DataFrame, now: Column) -> DataFrame:
    """One row per daily listing: its last observation, a live listing's current episode counting as one if it was seen in the last FRESH_HOURS;
    an updated room or district leaves no trace in its former segment."""
    columns = ["id", "city", "district", "complex_id", "hex_id", "rooms", "rent_period", "furnishing", "price", "area", "observed_at"]
    seen = F.col("episode_last_seen")
    running = live.filter((F.col("rent_period") == "daily") & (F.col("episode_started") <= seen) & (seen <= F.col("last_seen")) & (seen <= now) & (_hours(now, seen) <= FRESH_HOURS))
    both = observations.filter("rent_period = 'daily'").select(*columns, F.lit(0).alias("_live")).unionByName(running.withColumn("observed_at", seen).select(*columns, F.lit(1).alias("_live")))
    both = both.filter((F.col("observed_at") <= now) & (_hours(now, F.col("observed_at")) <= 24 * DAILY_WINDOWS[-1]))
    return both.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("observed_at", "_live", "price")).alias("r")).select("r.*")


def build(observations: DataFrame, live: DataFrame, removed: DataFrame, now: Column) -> DataFrame:
    """One row per segment (KEY) with a distribution of rents, its window, active supply, and for monthly rents removals of the last 30 days.

    observations: id, city, district, complex_id, hex_id, rooms, rent_period, furnishing, price, area, observed_at. live adds last_seen,
    episode_started and episode_last_seen; removed: first_proof, last_proof, proofs, episode_started, episode_last_seen, archived_at.

    Daily rents are taken over 30 days or, if these don't suffice, over 90; monthly ones from what was seen in the last 72 hours. The newest must be
    fresh, and a segment without active supply is left out. Removals count if the listing was proven twice and up for two days, and
    enough of them are there. Removal times say nothing of vacancy. Quantiles are exact by range partitions, as a city is one group.
    """
    fresh_live = live.filter((F.col("last_seen") <= now) & (_hours(now, F.col("last_seen")) <= FRESH_HOURS))
    daily = latest_daily(observations, fresh_live, now)
    monthly = fresh_live.filter("rent_period = 'monthly'").withColumn("observed_at", F.col("last_seen")).select(*daily.columns)
    age = _hours(now, F.col("observed_at")) / 24
    spans = F.when(F.col("rent_period") == "monthly", F.array(F.lit(MONTHLY_WINDOW))).when(age <= DAILY_WINDOWS[0], F.array(*map(F.lit, DAILY_WINDOWS))).otherwise(F.array(F.lit(DAILY_WINDOWS[1])))
    rows = scoped(daily.unionByName(monthly).withColumn("window_days", F.explode(spans)))
    ppm2 = F.when(F.col("area").between(*AREAS), F.col("price") / F.col("area"))
    rows = cut(rows.select(*KEY, "window_days", F.col("price").cast("double").alias("price"), ppm2.alias("ppm2"), "observed_at"))
    by = [*KEY, "window_days"]
    least = F.coalesce(*[F.when(F.col("scope") == s, n) for s, n in LEAST.items()])
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("sample_count"), F.avg("price").alias("avg_price"), F.min("observed_at").alias("oldest"), F.max("observed_at").alias("newest"))
    enough = sums.filter((F.col("sample_count") >= least) & (_hours(now, F.col("newest")) <= FRESH_HOURS))
    chosen = cut(enough.groupBy(*KEY).agg(F.min("window_days").alias("window_days"), F.min_by(F.struct("sample_count", "avg_price", "oldest", "newest"), "window_days").alias("d")).select(*by, "d.*"))
    same = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    kept = rows.alias("x").join(chosen.select(*by).alias("y"), same("x", "y", by), "left_semi").select("x.*")
    q = quantiles.quantiles(kept, by, "price", {"p25_price": 0.25, "median_price": 0.5, "p75_price": 0.75})
    m2 = quantiles.quantiles(kept, by, "ppm2", {"price_per_sqm": 0.5})
    active = scoped(fresh_live).groupBy(*KEY).agg(F.count_distinct("id").alias("active_supply"))
    gone, first = F.col("archived_at"), F.col("first_proof")
    proven = (F.col("proofs") >= LEAST_PROOFS) & (F.col("episode_started") <= first) & (first <= F.col("last_proof")) & (F.col("last_proof") <= F.col("episode_last_seen")) & (F.col("episode_last_seen") <= gone)
    recent = (gone <= now) & (_hours(now, gone) <= 24 * REMOVED_DAYS) & (_hours(gone, F.col("last_proof")) <= FRESH_HOURS) & (_hours(gone, first) >= 24 * LEAST_DAYS_UP)
    left = cut(scoped(removed.filter((F.col("rent_period") == "monthly") & proven & recent).withColumn("up", _hours(gone, first) / 24)).select(*KEY, "up"))
    removals = left.groupBy(*KEY).agg(F.count(F.lit(1)).alias("gone"))
    up = quantiles.quantiles(left, KEY, "up", {"up": 0.5})
    out = chosen.alias("c").join(q.alias("q"), same("c", "q", by)).join(m2.alias("m"), same("c", "m", by), "left").join(active.alias("a"), same("c", "a", KEY))
    out = out.join(removals.alias("r"), same("c", "r", KEY), "left").join(up.alias("u"), same("c", "u", KEY), "left")
    told = (F.col("c.rent_period") == "monthly") & (F.col("r.gone") >= F.coalesce(*[F.when(F.col("c.scope") == s, n) for s, n in LEAST.items()]))
    whole = lambda c: F.floor(F.col(c)).cast("long")
    return out.select(
        *[F.col(f"c.{k}").alias(k) for k in by], "c.sample_count", whole("q.median_price").alias("median_price"), whole("c.avg_price").alias("avg_price"), whole("q.p25_price").alias("p25_price"), whole("q.p75_price").alias("p75_price"),
        whole("m.price_per_sqm").alias("price_per_sqm"), F.col("c.oldest").alias("oldest"), F.col("c.newest").alias("newest"), F.col("a.active_supply").alias("active_supply"),
        F.when(told, F.round("u.up", 1)).alias("median_dom_days"), F.when(told, F.col("r.gone")).alias("gone_30d"), F.when(told, F.round(F.col("a.active_supply") / F.col("r.gone"), 2)).alias("months_of_supply"),
    )
