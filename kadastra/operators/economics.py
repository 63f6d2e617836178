"""Bargaining, sublease economics, deposits, reputation, transport hexagons and housing class in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra.functions.stats import clamp
from kadastra.operators import relational
from kadastra.operators.deal import weighted_share

# Fixed values of the bargain ladder and of the scores.
URGENT_BONUS = 300_000
TRANSPORT = {"rail": (1000.0, 0.75), "bus": (500.0, 0.4), "road": (600.0, 0.3), "junction": (800.0, 0.2)}
ROUTES = (500.0, 6, 0.5)
DAYS_A_MONTH = 30.4


def bargain(offers: DataFrame, comparables: DataFrame, urgent_bonus: int = URGENT_BONUS) -> DataFrame:
    """id, n, median, least, market (hot, normal, cold), discount (percent), target price; offers without comparables have market unknown.

    offers: id, price, is_owner, is_urgent; comparables: id (of the offer), price, days_seen. The share of comparables that were seen for 30 days tells the
    market; the offer's price against the median (a whole number) picks the rung of the ladder.
    """
    peers = comparables.filter("price > 0").groupBy(F.col("id").alias("p_id")).agg(
        F.count(F.lit(1)).alias("n"), F.floor(F.percentile("price", F.lit(0.5))).cast("long").alias("median"), F.min("price").alias("least"), F.avg((F.coalesce("days_seen", F.lit(0)) >= 30).cast("double")).alias("old")
    )
    rows = offers.join(peers, F.col("id") == F.col("p_id"), "left")
    market = F.when(F.col("n").isNull(), "unknown").when(F.col("old") > 0.5, "cold").when(F.col("old") > 0.25, "normal").otherwise("hot")
    base = F.when(F.col("old") > 0.5, 0.08).when(F.col("old") > 0.25, 0.05).otherwise(0.02)
    ratio = F.col("price") / F.nullif(F.col("median"), F.lit(0))
    rung = F.when(ratio < 0.93, 1.0).when(ratio < 1.10, base * 100).otherwise(F.least((ratio - 1) * 100 + base * 100, F.lit(20.0)))
    whole = lambda c: F.floor(c).cast("long")
    target = F.when(ratio < 0.93, whole(F.col("price") * 0.99)).when(ratio < 1.10, whole(F.col("price") * (1 - base))).otherwise(whole(F.col("median") * 0.97))
    middleman = F.when(~F.coalesce("is_owner", F.lit(True)), F.least(rung + 1, F.lit(20.0))).otherwise(rung)
    pressed = F.greatest(target - urgent_bonus, whole(F.col("price") * 0.5))
    urgent = F.coalesce("is_urgent", F.lit(False)) & (F.col("price") > 0)
    final = F.when(urgent, pressed).otherwise(target)
    discount = F.when(urgent, (1 - pressed / F.col("price")) * 100).otherwise(middleman)
    return rows.select("id", F.coalesce("n", F.lit(0)).alias("n"), "median", "least", market.alias("market"), F.when(ratio.isNotNull(), F.round(discount, 1)).otherwise(0.0).alias("discount"), F.when(ratio.isNotNull(), final).alias("target"))


def sublease(rows: DataFrame, occupancies: tuple[float, ...] = (0.45, 0.60, 0.75)) -> DataFrame:
    """Per row and occupancy: id, occupancy, revenue, costs, margin, breakeven (occupancy; null if no night pays), startup, payback (months).

    rows: id, rent, nightly, cleaning, stay (nights of one), consumables (a night), fee and tax (shares), utilities, capex, capex_months, deposit_months.
    """
    each = rows.withColumn("occupancy", F.explode(F.array(*[F.lit(o) for o in occupancies])))
    nights = F.col("occupancy") * DAYS_A_MONTH
    revenue = F.col("nightly") * nights
    variable = nights / F.col("stay") * F.col("cleaning") + nights * F.col("consumables") + revenue * (F.col("fee") + F.col("tax"))
    fixed = F.col("rent") + F.col("utilities") + F.col("capex") / F.col("capex_months")
    night = F.col("nightly") * (1 - F.col("fee") - F.col("tax")) - F.col("consumables") - F.col("cleaning") / F.col("stay")
    startup = F.col("rent") * (1 + F.col("deposit_months")) + F.col("capex")
    margin = revenue - variable - fixed
    return each.select(
        "id", "occupancy", F.round(revenue, 2).alias("revenue"), F.round(variable + fixed, 2).alias("costs"), F.round(margin, 2).alias("margin"), F.when(night > 0, F.round(fixed / (night * DAYS_A_MONTH), 6)).alias("breakeven"), F.round(startup, 2).alias("startup"), F.when(margin > 0, F.round(startup / margin, 1)).alias("payback")
    )


def deposit_against(rows: DataFrame) -> DataFrame:
    """id, wealth of 12 months in a deposit and in the flat, their difference, and the yearly growth of the flat's price at which both are
    equal, in percent. rows: id, price, rent (net, a month), rate (percent a year, paid monthly), growth (percent a year)."""
    deposit = F.col("price") * F.pow(1 + F.col("rate") / 1200, 12)
    flat = F.col("price") * (1 + F.col("growth") / 100) + F.col("rent") * 12
    even = (deposit - F.col("rent") * 12) / F.nullif(F.col("price"), F.lit(0.0)) - 1
    return rows.select("id", F.round(deposit, 2).alias("deposit"), F.round(flat, 2).alias("flat"), F.round(flat - deposit, 2).alias("difference"), F.round(even * 100, 4).alias("breakeven_growth"))


def reputation(reviews: DataFrame, key: str, trust: dict[str, float], as_of: Column, otherwise: float = 0.7, least: int = 3) -> DataFrame:
    """key, n, score (50 + 50 times the weighted mean of sentiment), rankable (at least 3 reviews). reviews: key, sentiment (-1, 0, 1, null is left
    out), day, source, is_spam. A review weighs 1 up to 90 days, .6 up to a year, .3 later, .7 without a day, times its source's trust."""
    from kadastra.operators.deal import lookup

    age = F.datediff(as_of.cast("date"), F.col("day"))
    fresh = F.when(F.col("day").isNull(), 0.7).when(age <= 90, 1.0).when(age <= 365, 0.6).otherwise(0.3)
    rows = reviews.filter(~F.coalesce("is_spam", F.lit(False)) & F.col("sentiment").isNotNull()).withColumn("w", fresh * F.coalesce(lookup(trust, F.col("source")), F.lit(otherwise)))
    mean = F.sum(F.col("w") * F.col("sentiment")) / F.nullif(F.sum("w"), F.lit(0.0))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(clamp(50 + 50 * F.coalesce(mean, F.lit(0.0)), 0.0, 100.0), 1).alias("score")).withColumn("rankable", F.col("n") >= least)


def transport_score(cells: DataFrame, points: DataFrame, degrees: float) -> DataFrame:
    """l_id, score: nearness of rail, bus, road and junction, and the number of routes with a stop near, as a share of six.

    cells: l_id, l_lat, l_lon; points: r_id, kind, route, r_lat, r_lon. Only cells of over .05 stay. Points of a kind and route at one place
    say the same, and each place is told once.
    """
    stops, longest = points.select("kind", "route", "r_lat", "r_lon").distinct(), max(r for r, _ in TRANSPORT.values())
    near = lambda own: relational.radius_pairs(own, stops, longest, degrees).groupBy("l_id").agg(*[F.min(F.when(F.col("kind") == k, F.col("dist_m"))).alias(k) for k in TRANSPORT], F.count_distinct(F.when(F.col("dist_m") <= ROUTES[0], F.col("route"))).alias("routes"))
    share = lambda c, r: F.when(F.col(c).isNotNull(), clamp(1 - F.col(c) / r, 0.0, 1.0)).otherwise(0.0)
    score = sum((share(k, r) * w for k, (r, w) in TRANSPORT.items()), clamp(F.col("routes") / ROUTES[1], 0.0, 1.0) * ROUTES[2])
    return relational.for_places(cells, near).select("l_id", F.round(clamp(score, 0.0, 1.0), 6).alias("score"), "routes").filter("score > 0.05")


def class_scores(rows: DataFrame, terms: list[tuple[str, float, bool]], key: str) -> DataFrame:
    """key, score: weighted mean of the terms (column, weight, whether less is better) on their own scale from least to greatest, over what is known."""
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c, _, _ in terms for n, f in (("low", F.min), ("high", F.max))])  # one row
    place = lambda c: (F.col(c) - F.col(f"low_{c}")) / F.nullif((F.col(f"high_{c}") - F.col(f"low_{c}")).cast("double"), F.lit(0.0))
    parts = [(w, (1 - place(c)) if less else place(c)) for c, w, less in terms]
    return rows.crossJoin(F.broadcast(ends)).select(key, F.round(weighted_share(parts), 6).alias("score"))


def rental_clean() -> Column:
    """Offers by the month without a conflict of period, not a duplicate, and not held for review."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return F.coalesce(F.col("rent_period") == "monthly", F.lit(False)) & no("period_conflict") & no("is_duplicate") & no("needs_review") & (F.coalesce(F.trim("duplicate_of"), F.lit("")) == "")


def rental_live(as_of: Column, hours: int = 72) -> Column:
    """Clean offers that are active and were seen in the last hours."""
    seen = F.col("last_seen").between(as_of - F.expr(f"INTERVAL {hours} HOURS"), as_of)
    return rental_clean() & F.coalesce(F.col("is_active"), F.lit(False)) & F.col("archived_at").isNull() & F.coalesce(seen, F.lit(False))


def active_spans(spans: DataFrame, breaks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end) of spans without the breaks (keys, start, end) in them: what lies between one break's end and the next one's start.
    Breaks are merged first; those that touch no span change nothing."""
    merged = relational.merged_spans(breaks, keys, "start", "end").select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"b_{k}"))
    met = spans.join(merged, same & (F.col("b_start") < F.col("end")) & (F.col("b_end") > F.col("start")), "left")
    cut = met.groupBy(*keys, "start", "end").agg(F.sort_array(F.collect_list(F.when(F.col("b_start").isNotNull(), F.struct(F.col("b_start").alias("s"), F.col("b_end").alias("e"))))).alias("b"))  # episodes of one listing
    starts, ends = F.concat(F.array("start"), F.col("b.e")), F.concat(F.col("b.s"), F.array("end"))
    pieces = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    return cut.select(*keys, F.explode(F.filter(pieces, lambda p: p["s"] < p["e"])).alias("p")).select(*keys, F.col("p.s").alias("start"), F.col("p.e").alias("end"))


def json_patch(document: Column, changes: dict[str, Column]) -> Column:
    """A flat JSON object with some members set; a null value takes a member away."""
    old = F.coalesce(F.from_json(document, "map<string,string>"), F.expr("map()").cast("map<string,string>"))
    new = F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), v.cast("string"))])
    kept = F.map_filter(old, lambda k, _: ~k.isin(*changes))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(F.map_concat(kept, new), lambda _, v: v.isNotNull())))))


def write_day(rows: DataFrame, path: str, day: str) -> None:
    """Write a snapshot by days: a day that is there is replaced, other days stay, so that a rerun changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


