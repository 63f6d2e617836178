"""How long a listing may take to go at several discounts: survival of its segment, and an isotonic price curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.functions.stats import clamp, days
from kadastra.operators import ranking, scoring
from kadastra.shared import cut

# Discounts in percent, bounds of a forecast in days, least numbers of exits.
DISCOUNTS = (0, 3, 5, 7, 10)
DAYS = (3, 180)
LEAST_EVENTS, LEAST_FOR_CURVE, LEAST_FOR_SURVIVAL, SUFFICIENT, LEAST_SAMPLE = 5, 6, 8, 15, 3
LEVELS = ("district_rooms", "district_rooms_bucket", "city_rooms_bucket", "city")


def isotonic(values: Column, weights: Column) -> Column:
    """The non-decreasing array nearest to a short array in weighted squares: at each place the greatest, over starts up to it, of the
    least, over ends from it on, of the weighted means between; what pooling adjacent violators gives."""
    at = F.sequence(F.lit(1), F.size(values))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    part = lambda arr, a, b: F.slice(arr, a, b - a + 1)
    weighted = F.zip_with(values, weights, lambda v, w: v * w)
    mean = lambda a, b: total(part(weighted, a, b)) / total(part(weights, a, b))
    least = lambda a, i: F.array_min(F.transform(F.sequence(i, F.size(values)), lambda b: mean(a, b)))
    fitted = F.transform(at, lambda i: F.array_max(F.transform(F.sequence(F.lit(1), i), lambda a: least(a, i))))
    return F.when(F.size(values) == 0, values).otherwise(fitted)


def interpolate(xs: Column, ys: Column, x: Column) -> Column:
    """The value at x of the line through points in order of xs; constant beyond its ends."""
    k = F.size(F.filter(xs, lambda v: v <= x))
    y = lambda i: F.element_at(ys, i)
    left, right = F.element_at(xs, F.greatest(k, F.lit(1))), F.element_at(xs, F.least(k + 1, F.size(xs)))
    between = y(F.greatest(k, F.lit(1))) + (y(F.least(k + 1, F.size(xs))) - y(F.greatest(k, F.lit(1)))) * (x - left) / F.nullif(right - left, F.lit(0.0))
    return F.when(k == 0, y(F.lit(1))).when(k == F.size(xs), y(F.size(xs))).otherwise(between)


def segments(rows: DataFrame) -> DataFrame:
    """rows with (level, seg) of each of the four segments that it is in, the narrowest first."""
    bucket = F.least("rooms", F.lit(4))
    keys = [F.concat_ws("|", F.lit("1"), "district", "rooms"), F.concat_ws("|", F.lit("2"), "district", bucket), F.concat_ws("|", F.lit("3"), bucket), F.lit("4")]
    return rows.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("level"), k.cast("string").alias("seg")) for i, k in enumerate(keys)]))).select("*", "s.level", "s.seg").drop("s")


def segment_curves(levels: DataFrame) -> DataFrame:
    """Per segment of (seg, id, ppm2, t, event), t being whole days: n, events, median_ppm2, mid (upper median of exits), q75 and q25 of
    survival, and the price curve xs, ys (null where exits are too few)."""
    by_t = levels.groupBy("seg", "t").agg(F.sum(F.col("event").cast("long")).alias("d"))
    steps = scoring.kaplan_meier(levels, ["seg"], "t", "event")
    quantile = lambda q, name: scoring.km_quantile(steps, ["seg"], "t", q).withColumnRenamed("t", name)
    sums = levels.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("long")).alias("events"))
    upto = Window.partitionBy("seg").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    mid = by_t.withColumn("run", F.sum("d").over(upto)).join(sums, "seg").filter(F.col("run") >= F.floor(F.col("events") / 2) + 1).groupBy("seg").agg(F.min("t").alias("mid"))

    one = levels.select("seg", "id", "ppm2", "t", F.col("event").cast("long").alias("e"), F.lit(1).cast("long").alias("one"))
    placed = ranking.running(one, ["seg", "ppm2", "id"], ["one", "e"])
    begin = placed.groupBy("seg").agg(F.min("one_before").alias("one_from"), F.min("e_before").alias("e_from"))
    placed = cut(placed.join(begin, "seg").join(sums, "seg").withColumn("pos", F.col("one_before") - F.col("one_from")).withColumn("at", F.col("e_before") - F.col("e_from")))
    median = placed.filter(F.col("pos") == F.floor(F.col("n") / 2)).select("seg", F.col("ppm2").alias("median_ppm2"))

    size = F.greatest(F.lit(1), F.floor(F.col("events") / F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.col("events") / 5)))))
    exits = placed.filter((F.col("e") == 1) & (F.col("events") >= LEAST_FOR_CURVE)).withColumn("size", size).withColumn("chunks", F.ceil(F.col("events") / F.col("size")))
    short = (F.col("events") - (F.col("chunks") - 1) * F.col("size") < F.col("size") / 2) & (F.col("chunks") > 1)
    exits = exits.withColumn("bucket", F.least(F.floor(F.col("at") / F.col("size")), F.col("chunks") - 1 - short.cast("long")))
    lengths = exits.groupBy("seg", "bucket").agg(F.count(F.lit(1)).alias("len"))
    exits = exits.join(lengths, ["seg", "bucket"])
    x = exits.filter(F.col("at") - F.col("bucket") * F.col("size") == F.floor(F.col("len") / 2)).select("seg", "bucket", F.col("ppm2").alias("x_ppm2"), "len")
    inside = Window.partitionBy("seg", "bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    y = exits.groupBy("seg", "bucket", "t", "len").agg(F.count(F.lit(1)).alias("c")).withColumn("run", F.sum("c").over(inside))
    y = y.filter(F.col("run") >= F.floor(F.col("len") / 2) + 1).groupBy("seg", "bucket").agg(F.min("t").alias("y"))
    points = x.join(y, ["seg", "bucket"]).join(median, "seg").select("seg", F.struct("bucket", (F.ln("x_ppm2") - F.ln("median_ppm2")).alias("x"), "y", F.col("len").cast("double").alias("w")).alias("p"))
    curve = points.groupBy("seg").agg(F.sort_array(F.collect_list("p")).alias("p")).filter(F.size("p") >= 2)  # at most six
    curve = curve.select("seg", F.col("p.x").alias("xs"), isotonic(F.col("p.y"), F.col("p.w")).alias("ys"))
    out = sums.join(median, "seg")
    for more in (mid, quantile(0.75, "q75"), quantile(0.25, "q25"), curve):
        out = out.join(more, "seg", "left")
    return out


def dom_scenarios(listings: DataFrame, as_of: Column) -> DataFrame:
    """One row per active listing and discount: id, discount, price, days_low, days_high, level, method, mode, confidence.

    listings: id, price, area, rooms, district, first_seen, archived_at. The narrowest segment with 5 exits counts, else the city. Its range are the
    quartiles of survival, or the upper median of exits times .75 and 1.35 where these are missing or exits are under 8; a
    discount moves it along the price curve. Days never rise with the discount. Where all discounts give the same, a straight line of 3 % a
    point is shown instead. Listings of segments of under 3 rows or without exits are left out. A listing's own row stays in its segment.
    """
    known = listings.filter("price > 0 and area > 0 and rooms is not null and district is not null and first_seen is not null")
    life = F.floor(days(F.coalesce("archived_at", as_of), F.col("first_seen"))).cast("double")
    known = known.select("id", "price", "area", "rooms", "district", (F.col("price") / F.col("area")).alias("ppm2"), F.greatest(F.lit(0.5), life).alias("t"), F.col("archived_at").isNotNull().alias("event"))
    levels = cut(segments(known))
    stats = cut(segment_curves(levels))
    asked = levels.filter("not event").select("id", "price", "area", "ppm2", "level", "seg").join(stats, "seg")
    fits = F.when(F.col("events") >= LEAST_EVENTS, F.col("level")).otherwise(F.lit(len(LEVELS)))
    best = asked.withColumn("fit", fits).filter((F.col("fit") == F.col("level"))).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("level"))).filter("r = 1")
    best = best.filter((F.col("n") >= LEAST_SAMPLE) & (F.col("events") > 0))
    survival = (F.col("events") >= LEAST_FOR_SURVIVAL) & F.col("q75").isNotNull() & F.col("q25").isNotNull()
    bound = lambda c: clamp(c, *map(float, DAYS))
    best = best.withColumn("km", survival).withColumn("low0", bound(F.when(survival, F.col("q75")).otherwise(F.col("mid") * 0.75))).withColumn("high0", bound(F.when(survival, F.greatest("q25", "q75")).otherwise(F.col("mid") * 1.35)))
    dev = lambda ppm2: F.ln(ppm2) - F.ln("median_ppm2")
    now = interpolate(F.col("xs"), F.col("ys"), dev(F.col("ppm2")))
    low, high = [], []
    for pct in DISCOUNTS:
        price = F.bround(F.col("price") * (1 - pct / 100))
        times = F.coalesce(F.when(now > 0, interpolate(F.col("xs"), F.col("ys"), dev(price / F.col("area"))) / now), F.lit(1.0))
        low.append(bound(F.col("low0") * times))
        high.append(bound(F.col("high0") * times))
    best = best.withColumns({f"l{i}": c for i, c in enumerate(low)} | {f"h{i}": c for i, c in enumerate(high)})
    upto = lambda side, i: F.least(*[F.col(f"{side}{j}") for j in range(i + 1)]) if i else F.col(f"{side}0")
    rounded = {}
    for i in range(len(DISCOUNTS)):
        rounded[f"H{i}"] = F.bround(upto("h", i)).cast("int")
        rounded[f"L{i}"] = F.bround(F.least(upto("l", i), upto("h", i))).cast("int")
    best = best.withColumns(rounded)
    flat = F.lit(True)
    for i in range(1, len(DISCOUNTS)):
        flat = flat & (F.col(f"L{i}") == F.col("L0")) & (F.col(f"H{i}") == F.col("H0"))
    best = best.withColumn("flat", flat)
    shown = []
    for i, pct in enumerate(DISCOUNTS):
        slope = max(0.70, 1 - 0.03 * pct)
        line_low = F.greatest(F.lit(DAYS[0]), F.floor(F.col("L0") * slope + 0.5)).cast("int")
        line_high = F.floor(F.col("H0") * slope + 0.5).cast("int")
        line_high = F.when(line_high <= line_low, line_low + 1).otherwise(line_high)
        own = F.struct(
            F.lit(pct).alias("discount"),
            F.bround(F.col("price") * (1 - pct / 100)).alias("price"),
            F.when(F.col("flat"), line_low).otherwise(F.col(f"L{i}")).alias("days_low"),
            F.when(F.col("flat"), line_high).otherwise(F.col(f"H{i}")).alias("days_high"),
        )
        shown.append(own)
    confidence = F.when(~F.col("km"), "low").when((F.col("level") == 1) & (F.col("events") >= SUFFICIENT), "sufficient").when((F.col("level") <= 2) & (F.col("events") >= LEAST_EVENTS), "medium").otherwise("low")
    name = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    facts = [name.alias("level"), F.when(F.col("km"), "survival").otherwise("median").alias("method"), F.when(F.col("flat"), "line").otherwise("curve").alias("mode"), confidence.alias("confidence")]
    return best.select("id", F.explode(F.array(*shown)).alias("s"), *facts).select("id", "s.*", "level", "method", "mode", "confidence")
