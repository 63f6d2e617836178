"""Market metrics over a listing table: filters, price corridors, supply, exits, absorption, demand, price index.

Every function takes the listings (id, price, area, rooms, district, housing_class, first_seen, last_seen, archived_at,
is_active, is_duplicate ...) and an explicit as_of; none reads the clock. Leaving the market is called an exit, never a sale.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.functions.stats import days, exact_quantile, whole_days

#: Segments with fewer rows are flagged or dropped.
MIN_SEGMENT = 20
SHORT_LIVED_DAYS = 2
ROOM_CAP = 4


# ---- filters


@dataclass(frozen=True)
class Filters:
    """Dashboard filters after whitelisting: what is unknown falls back to its default."""

    period_days: int = 30
    district: str | None = None
    housing_class: str | None = None
    rooms: int | None = None
    status: str = "active"


def normalize_filters(raw: dict) -> Filters:
    period = raw.get("period")
    rooms = raw.get("rooms")
    return Filters(
        period_days=int(period) if str(period) in {"7", "14", "30", "60", "90", "180", "365"} else 30,
        district=str(raw["district"]).strip() or None if raw.get("district") else None,
        housing_class=str(raw["class"]).strip() or None if raw.get("class") else None,
        rooms=int(rooms) if str(rooms) in {"1", "2", "3", "4"} else None,
        status=raw["status"] if raw.get("status") in {"active", "archived", "all"} else "active",
    )


def short_lived() -> Column:
    """Left within two days of being seen first: kept out of every metric but its own."""
    end = F.least("last_seen", "archived_at")
    return F.coalesce(F.col("archived_at").isNotNull() & (days(end, F.col("first_seen")) < SHORT_LIVED_DAYS), F.lit(False))


def base(listings: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Listings that metrics count: no duplicates, none short-lived, in the filters' segment."""
    f = filters or Filters()
    keep = [~F.coalesce("is_duplicate", F.lit(False)), ~short_lived()]
    if f.district:
        keep.append(F.col("district") == f.district)
    if f.housing_class:
        keep.append(F.col("housing_class") == f.housing_class)
    if f.rooms:
        keep.append(F.col("rooms") >= ROOM_CAP if f.rooms == ROOM_CAP else F.col("rooms") == f.rooms)
    condition = keep[0]
    for k in keep[1:]:
        condition = condition & k
    return listings.filter(condition)


def status_condition(status: str) -> Column:
    """Active means not known to be inactive: an unknown state counts as active."""
    inactive = F.col("is_active").eqNullSafe(F.lit(False))
    return {"active": ~inactive, "archived": inactive}.get(status, F.lit(True))


def alive_at(moment: Column) -> Column:
    return (F.col("first_seen") <= moment) & (F.col("archived_at").isNull() | (F.col("archived_at") > moment))


def exited_in(start: Column, end: Column) -> Column:
    return F.col("archived_at").isNotNull() & (F.col("archived_at") > start) & (F.col("archived_at") <= end)


def ago(moment: Column, n: int) -> Column:
    return moment - F.expr(f"INTERVAL {n} DAYS")


def rooms_bucket() -> Column:
    return F.least("rooms", F.lit(ROOM_CAP))


def area_bucket(area: str = "area") -> Column:
    a = F.col(area)
    return F.when(a < 40, "<40").when(a < 60, "40-59").when(a < 80, "60-79").when(a < 120, "80-119").when(a >= 120, "120+").otherwise("unknown")


def ppm2() -> Column:
    return F.when((F.col("area") > 0) & (F.col("price") > 0), F.col("price") / F.col("area"))


# ---- price levels


def price_corridors(listings: DataFrame, by: str, filters: Filters | None = None, minimum: int = MIN_SEGMENT) -> DataFrame:
    """Quartiles of the unit price by segment, after cutting each segment at its own 1st and 99th percentile."""
    rows = base(listings, filters).filter(status_condition("active")).withColumn("ppm2", ppm2()).filter("ppm2 is not null").select(F.col(by).alias("segment"), "ppm2")
    edges = rows.groupBy(F.col("segment").alias("e_segment")).agg(F.percentile("ppm2", F.array(F.lit(0.01), F.lit(0.99))).alias("e"))
    inside = rows.join(edges, F.col("segment").eqNullSafe(F.col("e_segment"))).filter((F.col("ppm2") >= F.col("e")[0]) & (F.col("ppm2") <= F.col("e")[1])).select("segment", "ppm2")
    quartiles = F.percentile("ppm2", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        inside.groupBy("segment")
        .agg(F.count(F.lit(1)).alias("n"), quartiles.alias("q"))
        .filter(F.col("n") >= minimum)
        .select("segment", "n", F.round(F.col("q")[0], 4).alias("p25"), F.round(F.col("q")[1], 4).alias("p50"), F.round(F.col("q")[2], 4).alias("p75"))
    )


def price_as_of(listings: DataFrame, changes: DataFrame, moment: Column, current: str = "price") -> DataFrame:
    """Each listing's price at a moment: the latest change up to it, else the first old price, else the current one."""
    upto = changes.filter(F.col("changed_at") <= moment).groupBy("listing_id").agg(F.max_by("new_price", F.struct("changed_at", "seq")).alias("at"))
    first = changes.groupBy("listing_id").agg(F.min_by("old_price", F.struct("changed_at", "seq")).alias("first_old"))
    return (
        listings.join(upto, F.col("id") == upto["listing_id"], "left")
        .drop("listing_id")
        .join(first, F.col("id") == first["listing_id"], "left")
        .drop("listing_id")
        .withColumn("price_at", F.coalesce("at", "first_old", current))
        .drop("at", "first_old")
    )


# ---- supply and exits


def overview(listings: DataFrame, as_of: Column, period_days: int = 30, filters: Filters | None = None) -> DataFrame:
    rows = base(listings, filters)
    start = ago(as_of, period_days)
    active = status_condition("active")
    return rows.agg(
        F.count_if(active).alias("active"),
        F.count_if((F.col("first_seen") > start) & (F.col("first_seen") <= as_of)).alias("new_supply"),
        F.count_if(exited_in(start, as_of)).alias("exits"),
        F.round(F.percentile(F.when(active, F.col("price")), F.lit(0.5)), 4).alias("median_price"),
        F.round(F.percentile(F.when(active, ppm2()), F.lit(0.5)), 4).alias("median_ppm2"),
        F.count_distinct(F.when(active, F.col("complex_id"))).alias("complexes"),
        F.count_distinct(F.when(active, F.col("district"))).alias("districts"),
        F.round(F.percentile(F.when(exited_in(start, as_of), days(F.col("archived_at"), F.col("first_seen"))), F.lit(0.5)), 4).alias("median_exit_days"),
    )


def supply_structure(listings: DataFrame, by: Column, filters: Filters | None = None) -> DataFrame:
    counted = base(listings, filters).filter(status_condition("active")).groupBy(by.alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share_pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def new_against_exits(listings: DataFrame, unit: str = "week") -> DataFrame:
    """New listings and exits by bucket, and their difference; buckets that only one side has are kept."""
    rows = base(listings)
    new = rows.groupBy(F.date_trunc(unit, "first_seen").cast("date").alias("bucket")).agg(F.count(F.lit(1)).alias("new_count"))
    out = rows.filter("archived_at is not null").groupBy(F.date_trunc(unit, "archived_at").cast("date").alias("bucket")).agg(F.count(F.lit(1)).alias("exit_count"))
    return new.join(out, "bucket", "full_outer").select(
        "bucket", F.coalesce("new_count", F.lit(0)).alias("new_count"), F.coalesce("exit_count", F.lit(0)).alias("exit_count"), (F.coalesce("new_count", F.lit(0)) - F.coalesce("exit_count", F.lit(0))).alias("net")
    )


def active_by_day(listings: DataFrame, first: str, last: str) -> DataFrame:
    """Listings alive at each day's start. Arrivals and exits become +1 and -1 and are summed up to each day, so no listing
    meets every day of its life."""
    rows = base(listings)
    day = lambda c: F.when(F.col(c) == F.date_trunc("day", c), F.to_date(c)).otherwise(F.date_add(F.to_date(c), 1))
    steps = rows.select(day("first_seen").alias("d"), F.lit(1).alias("step")).union(rows.filter("archived_at is not null and archived_at > first_seen").select(day("archived_at"), F.lit(-1)))
    steps = steps.union(rows.filter("archived_at is not null and archived_at <= first_seen").select(day("first_seen"), F.lit(-1)))
    start, end = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    by_day = steps.groupBy(F.greatest("d", start).alias("d")).agg(F.sum("step").alias("step")).filter(F.col("d") <= end)
    calendar = rows.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("d"))
    running = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return calendar.join(by_day, "d", "left").select("d", F.sum(F.coalesce("step", F.lit(0))).over(running).alias("active"))


def absorption(listings: DataFrame, as_of: Column, period_days: int = 30, by: str | None = None) -> DataFrame:
    """Exits against the stock at the start, and the months that the stock would last; insufficient for periods under two
    weeks and without exits."""
    rows = base(listings)
    start = ago(as_of, period_days)
    grouped = rows.groupBy(*([F.col(by).alias("segment")] if by else []))
    counted = grouped.agg(
        F.count_if(alive_at(start)).alias("n_start"),
        F.count_if(alive_at(as_of)).alias("n_now"),
        F.count_if(exited_in(start, as_of)).alias("exits"),
    )
    fine = (F.lit(period_days) >= 14) & (F.col("exits") > 0)
    return counted.withColumns(
        {
            "exit_rate_pct": F.round(F.col("exits") * 100.0 / F.nullif("n_start", F.lit(0)), 4),
            "months_of_stock": F.round(F.when(fine, F.col("n_now") / (F.col("exits") * 30.0 / period_days)), 4),
            "status": F.when(fine, "OK").otherwise("INSUFFICIENT"),
        }
    )


def supply_funnel(listings: DataFrame, as_of: Column, period_days: int = 30) -> DataFrame:
    """Stock at the start plus new less exits, against the stock that is counted; equal within max(5, 0.5 % of the start)."""
    rows = base(listings)
    start = ago(as_of, period_days)
    counted = rows.agg(
        F.count_if(alive_at(start)).alias("active_start"),
        F.count_if((F.col("first_seen") > start) & (F.col("first_seen") <= as_of)).alias("new_count"),
        F.count_if(exited_in(start, as_of) & (F.col("archived_at") >= F.col("first_seen"))).alias("exit_count"),
        F.count_if(alive_at(as_of)).alias("active_measured"),
    )
    derived = F.col("active_start") + F.col("new_count") - F.col("exit_count")
    tolerance = F.greatest(F.lit(5), F.bround(F.col("active_start") * 0.005, 0).cast("long"))
    return counted.withColumn("active_end", derived).withColumn("consistent", F.abs(F.col("active_end") - F.col("active_measured")) <= tolerance)


def segment_exit_speed(listings: DataFrame, by: str, as_of: Column, period_days: int = 90) -> DataFrame:
    start = ago(as_of, period_days)
    gone = exited_in(start, as_of)
    return (
        base(listings)
        .groupBy(F.col(by).alias("segment"))
        .agg(
            F.count_if(alive_at(start)).alias("n_start"),
            F.count_if(alive_at(as_of)).alias("n_now"),
            F.count_if(gone).alias("exits"),
            F.round(F.percentile(F.when(gone, days(F.col("archived_at"), F.col("first_seen"))), F.lit(0.5)), 4).alias("median_dom"),
        )
        .withColumn("insufficient", F.col("n_start") < MIN_SEGMENT)
    )


def price_vs_liquidity(listings: DataFrame, as_of: Column, period_days: int = 90) -> DataFrame:
    start = ago(as_of, period_days)
    return (
        base(listings)
        .groupBy("district", "housing_class")
        .agg(
            F.count_if(alive_at(start)).alias("n_start"),
            F.count_if(exited_in(start, as_of)).alias("exits"),
            F.round(F.percentile(F.when(alive_at(as_of), ppm2()), F.lit(0.5)), 4).alias("median_ppm2"),
        )
        .filter(F.col("n_start") >= MIN_SEGMENT)
        .withColumn("exit_rate_pct", F.round(F.col("exits") * 100.0 / F.col("n_start"), 4))
    )


def segment_table(listings: DataFrame, changes: DataFrame, as_of: Column, period_days: int = 90) -> DataFrame:
    """Per district: stock, unit price, share of listings whose price fell, and days to exit; drops join on the listing."""
    rows = base(listings)
    start = ago(as_of, period_days)
    fell = changes.filter((F.col("new_price") < F.col("old_price")) & (F.col("changed_at") > start) & (F.col("changed_at") <= as_of)).select("listing_id").distinct().withColumn("fell", F.lit(1))
    flagged = rows.join(fell, F.col("id") == F.col("listing_id"), "left")
    return flagged.groupBy("district").agg(
        F.count_if(alive_at(as_of)).alias("n_active"),
        F.round(F.percentile(F.when(alive_at(as_of), ppm2()), F.lit(0.5)), 4).alias("median_ppm2"),
        F.round(F.avg(F.when(alive_at(as_of), F.coalesce("fell", F.lit(0)))), 6).alias("drop_share"),
        F.round(F.percentile(F.when(exited_in(start, as_of), days(F.col("archived_at"), F.col("first_seen"))), F.lit(0.5)), 4).alias("median_dom"),
    )


def price_drop_buckets(listings: DataFrame, changes: DataFrame) -> DataFrame:
    """Exits by how far the last price lies under the first old price."""
    first = changes.filter("old_price is not null").groupBy("listing_id").agg(
        F.min_by("old_price", F.struct("changed_at", "seq")).alias("before"), F.max_by("new_price", F.struct("changed_at", "seq")).alias("after")
    )
    drop = (F.col("before") - F.col("after")) / F.col("before") * 100
    bucket = F.when(drop.isNull() | (drop <= 0), "none").when(drop < 5, "<5").when(drop <= 10, "5-10").otherwise(">10")
    gone = base(listings).filter("archived_at is not null")
    return gone.join(first, F.col("id") == F.col("listing_id"), "left").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def bargaining(listings: DataFrame, changes: DataFrame, by: str) -> DataFrame:
    """Share of listings with a cut, and the median and 90th percentile of their whole discount; listings that came back after
    leaving take no part (anti join)."""
    relisted = listings.filter("archived_at is not null and last_seen > archived_at").select(F.col("id").alias("r_id"))
    cuts = changes.filter("old_price is not null").groupBy("listing_id").agg(
        F.min_by("old_price", F.struct("changed_at", "seq")).alias("before"), F.min("new_price").alias("lowest")
    )
    rows = base(listings).join(relisted, F.col("id") == F.col("r_id"), "left_anti").join(cuts, F.col("id") == F.col("listing_id"), "left")
    discount = F.when(F.col("lowest") < F.col("before"), (F.col("before") - F.col("lowest")) / F.col("before") * 100)
    return rows.withColumn("discount", discount).groupBy(F.col(by).alias("segment")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("discount").isNotNull().cast("int")), 6).alias("cut_share"),
        F.round(exact_quantile(F.col("discount"), 0.5), 4).alias("median_discount"),
        F.round(exact_quantile(F.col("discount"), 0.9), 4).alias("p90_discount"),
    )


def demand_verdict(share_pct: Column, demand_index: Column, n_start: Column) -> Column:
    return (
        F.when(n_start < MIN_SEGMENT, "little data")
        .when(demand_index >= 1.15, F.when(share_pct < 10, "deficit").otherwise("sells fast"))
        .when(demand_index <= 0.85, F.when(share_pct >= 10, "surplus").otherwise("slow"))
        .otherwise("balanced")
    )


def layout_demand(listings: DataFrame, as_of: Column, period_days: int = 90) -> DataFrame:
    """Rooms by area: each cell's exit rate against the whole market's, and what that says."""
    start = ago(as_of, period_days)
    cells = (
        base(listings)
        .groupBy(rooms_bucket().alias("rooms"), area_bucket().alias("area_bucket"))
        .agg(F.count_if(alive_at(start)).alias("n_start"), F.count_if(alive_at(start) & exited_in(start, as_of)).alias("exits"))
    )
    whole = Window.partitionBy()
    share = F.col("n_start") * 100.0 / F.nullif(F.sum("n_start").over(whole), F.lit(0))
    market = F.sum("exits").over(whole) / F.nullif(F.sum("n_start").over(whole), F.lit(0))
    index = F.try_divide(F.col("exits") / F.nullif("n_start", F.lit(0)), market)
    return (
        cells.withColumn("share_pct", F.round(share, 4))
        .withColumn("demand_index", F.round(index, 4))
        .withColumn("verdict", demand_verdict(F.col("share_pct"), F.col("demand_index"), F.col("n_start")))
    )


def short_lived_stats(listings: DataFrame) -> DataFrame:
    rows = listings.filter(~F.coalesce("is_duplicate", F.lit(False)))
    return rows.groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.count_if(short_lived()).alias("n_short"), F.round(F.avg(short_lived().cast("int")), 6).alias("short_share"))


# ---- price index


def cells_by_week(listings: DataFrame, price: str = "price") -> DataFrame:
    """Medians of the unit price and counts by week and (district, rooms) cell, of listings by the week they appeared."""
    unit = F.when(F.col("area") > 0, F.col(price) / F.col("area"))
    return (
        base(listings)
        .groupBy(F.date_trunc("week", "first_seen").cast("date").alias("week"), "district", rooms_bucket().alias("rooms"))
        .agg(F.count(unit).alias("n"), F.percentile(unit, F.lit(0.5)).alias("median"))
        .filter("n > 0")
    )


def chain_index(cells: DataFrame, keys: list[str], minimum: int = 5, period: str = "week") -> DataFrame:
    """Matched-cell chain index, base 100: each period links to the one before it that has cells, over cells with enough rows
    in both, weighted by the earlier counts. Without a common cell the level is kept and `linked` is false."""
    periods = cells.select(period).distinct().withColumn("i", F.row_number().over(Window.orderBy(period)))
    numbered = cells.filter(F.col("n") >= minimum).join(periods, period)
    before = numbered.select(*[F.col(k).alias(f"p_{k}") for k in keys], (F.col("i") + 1).alias("p_i"), F.col("n").alias("p_n"), F.col("median").alias("p_median"))
    same = F.col("i") == F.col("p_i")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    links = numbered.join(before, same).groupBy("i").agg((F.sum(F.col("p_n") * F.col("median")) / F.sum(F.col("p_n") * F.col("p_median"))).alias("link"), F.count(F.lit(1)).alias("common"))
    running = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return (
        periods.join(links, "i", "left")
        .withColumn("value", F.round(100 * F.exp(F.sum(F.ln(F.coalesce("link", F.lit(1.0)))).over(running)), 4))
        .select(period, F.col("value").alias("index_value"), F.col("link").isNotNull().alias("linked"), F.coalesce("common", F.lit(0)).alias("common_cells"))
    )


# ---- trends


def price_trend(changes: DataFrame) -> DataFrame:
    """Changes by day: how many up and down, and the mean of each in percent."""
    pct = (F.col("new_price") - F.col("old_price")) / F.col("old_price") * 100
    return (
        changes.filter("old_price is not null and old_price > 0 and new_price != old_price")
        .groupBy(F.to_date("changed_at").alias("day"))
        .agg(
            F.count_if(pct > 0).alias("n_up"),
            F.count_if(pct < 0).alias("n_down"),
            F.round(F.avg(F.when(pct > 0, pct)), 4).alias("mean_up"),
            F.round(F.avg(F.when(pct < 0, pct)), 4).alias("mean_down"),
        )
    )


def floor_performance(listings: DataFrame, top_floor: int = 9) -> DataFrame:
    position = F.when(F.col("floor") == 1, "first").when(F.col("floor") == top_floor, "last").otherwise("middle")
    return (
        base(listings)
        .groupBy(position.alias("position"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(ppm2(), F.lit(0.5)), 4).alias("median_ppm2"), F.round(F.avg(whole_days(F.col("archived_at"), F.col("first_seen"))), 4).alias("mean_dom"))
    )


def district_rooms_prices(listings: DataFrame) -> DataFrame:
    return base(listings).filter(status_condition("active")).groupBy("district", rooms_bucket().alias("rooms")).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(ppm2(), F.lit(0.5)), 4).alias("median_ppm2"))


def complex_stats(listings: DataFrame, changes: DataFrame, as_of: Column, window_days: int = 30) -> DataFrame:
    """Per building: active stock, mean unit price, days on the market of what is active, share with a price drop; buildings
    without active listings are left out."""
    fell = changes.filter((F.col("new_price") < F.col("old_price")) & (F.col("changed_at") > ago(as_of, window_days)) & (F.col("changed_at") <= as_of)).groupBy("listing_id").agg(F.lit(True).alias("dropped"))
    active = status_condition("active")
    rows = base(listings).join(fell, F.col("id") == F.col("listing_id"), "left")
    return (
        rows.groupBy("complex_id")
        .agg(
            F.count_if(active).alias("n_active"),
            F.round(F.avg(F.when(active, ppm2())), 4).alias("avg_ppm2"),
            F.round(F.avg(F.when(active, days(as_of, F.col("first_seen")))), 4).alias("avg_dom_days"),
            F.round(F.avg(F.when(active, F.coalesce("dropped", F.lit(False)).cast("int"))), 6).alias("price_drop_share"),
        )
        .filter("n_active > 0")
    )
