"""Scores and forecasts: hexagon statistics, deal score, outcome labels, survival, class models, yields, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.functions import geo
from kadastra.functions.stats import clamp
from kadastra.operators import market, ranking, relational
from kadastra.shared import cut

# ---- hexagons


def hex_stats(listings: DataFrame, edge_m: float = geo.EDGE_M) -> DataFrame:
    """Count and mean unit price per hexagon; listings without area are counted but not averaged."""
    q, r = geo.hex_axial(F.col("lat"), F.col("lon"), edge_m)
    return market.base(listings).filter(market.status_condition("active")).groupBy(q.alias("q"), r.alias("r")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(market.ppm2()), 4).alias("avg_ppm2"))


def hex_with_ring(cells: DataFrame) -> DataFrame:
    """Each cell with the counts and weighted mean of its six neighbours."""
    around = cells.select("q", "r", F.explode(geo.ring(F.col("q"), F.col("r"))).alias("o"))
    other = cells.select(F.col("q").alias("oq"), F.col("r").alias("orr"), F.col("n").alias("on"), F.col("avg_ppm2").alias("op"))
    ring = around.join(other, (F.col("o.q") == F.col("oq")) & (F.col("o.r") == F.col("orr"))).groupBy("q", "r").agg(F.sum("on").alias("ring_n"), F.round(F.sum(F.col("on") * F.col("op")) / F.sum("on"), 9).alias("ring_ppm2"))
    return cells.join(ring, ["q", "r"], "left").withColumn("ring_n", F.coalesce("ring_n", F.lit(0)))


def hex_score(rows: DataFrame, severity: str, edge_m: float = 150.0) -> DataFrame:
    """Events per hexagon against the 90th percentile of counts (floor index), raised by their mean severity."""
    q, r = geo.hex_axial(F.col("lat"), F.col("lon"), edge_m)
    cells = rows.groupBy(q.alias("q"), r.alias("r")).agg(F.count(F.lit(1)).alias("n"), F.avg(severity).alias("sev"))
    placed = ranking.ranked(cells, ["n", "q", "r"], "i")
    p90 = placed.filter(F.col("i") == F.least(F.floor(F.col("i_all") * 0.9), F.col("i_all") - 1) + 1).select(F.col("n").alias("p90"))
    return placed.crossJoin(F.broadcast(p90)).select("q", "r", "n", F.round(F.least(F.col("n") / F.col("p90"), F.lit(1.0)), 6).alias("count_norm"), F.round((F.col("n") / F.col("p90")) * (1 + 0.5 * F.col("sev")) / 3, 6).alias("score"))


def rank_composite(rows: DataFrame, key: str, volume: str, price: str) -> DataFrame:
    """.65 of the volume's and .35 of the price's place in its order, from 0 to 1; ties by key."""
    placed = ranking.ranked(ranking.ranked(rows, [volume, key], "_v"), [price, key], "_p")
    place = lambda c: (F.col(c) - 1) / F.greatest(F.col(f"{c}_all") - 1, F.lit(1))
    return placed.withColumn("hype", F.round(0.65 * place("_v") + 0.35 * place("_p"), 9)).drop("_v", "_v_all", "_p", "_p_all")


def kernel_density(points: DataFrame, weight: str, bandwidth_m: float = 700.0, edge_m: float = 350.0) -> DataFrame:
    """Gaussian density on hexagon centres: each point reaches only the cells within three bandwidths, by explosion."""
    steps = int(3 * bandwidth_m / (1.5 * edge_m)) + 2
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-steps, steps + 1) for b in range(-steps, steps + 1) if max(abs(a), abs(b), abs(a + b)) <= steps])
    q, r = geo.hex_axial(F.col("lat"), F.col("lon"), edge_m)
    x, y = geo.to_xy(F.col("lat"), F.col("lon"))
    near = points.select(x.alias("x"), y.alias("y"), F.col(weight).alias("w"), q.alias("q0"), r.alias("r0")).groupBy("x", "y", "q0", "r0").agg(F.sum("w").alias("w"))
    cells = near.select("x", "y", "w", "q0", "r0", F.explode(offsets).alias("o")).select("x", "y", "w", (F.col("q0") + F.col("o.a")).alias("q"), (F.col("r0") + F.col("o.b")).alias("r"))
    cx = (F.col("q") * (3**0.5) + F.col("r") * (3**0.5 / 2)) * edge_m
    cy = F.col("r") * 1.5 * edge_m
    d2 = F.pow(cx - F.col("x"), 2) + F.pow(cy - F.col("y"), 2)
    area = 1.5 * (3**0.5) * edge_m * edge_m
    mass = F.when(d2 <= (3 * bandwidth_m) ** 2, F.col("w") * F.exp(-d2 / (2 * bandwidth_m**2)) / (2 * 3.141592653589793 * bandwidth_m**2) * area)
    return cells.groupBy("q", "r").agg(F.sum(mass).alias("people")).filter("people >= 3").withColumn("people", F.round("people", 4))


# ---- labels, survival, evaluation


def kaplan_meier(rows: DataFrame, keys: list[str], time: str, event: str) -> DataFrame:
    """S(t) at each time with an event: the product of 1 - d / n over event times, n at risk being those that last to t."""
    by_time = rows.groupBy(*keys, time).agg(F.sum(F.col(event).cast("int")).alias("d"), F.count(F.lit(1)).alias("m"))
    later = Window.partitionBy(*keys).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    at_risk = by_time.withColumn("n", F.sum("m").over(later)).filter("d > 0")
    ended = F.max((F.col("d") == F.col("n")).cast("int")).over(upto)
    log_s = F.sum(F.when(F.col("d") < F.col("n"), F.ln(1 - F.col("d") / F.col("n"))).otherwise(0.0)).over(upto)
    return at_risk.withColumn("survival", F.when(ended == 1, 0.0).otherwise(F.exp(log_s))).select(*keys, time, "n", "d", "survival")


def km_quantile(steps: DataFrame, keys: list[str], time: str, q: float) -> DataFrame:
    """First time at which survival is q or less; keys that never get there are left out."""
    return steps.filter(F.col("survival") <= q).groupBy(*keys).agg(F.min(time).alias(time))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from average ranks, by counts of each score."""
    y = F.col(label).cast("int")
    counts = rows.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))
    r = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranking.running(counts, ["s"], ["n"]).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.round((F.sum(F.col("pos") * r) - pos * (pos + 1) / 2) / (pos * neg), 6).alias("auc"))


def average_precision(rows: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """Area under the precision-recall curve: the mean of precision at each positive, best scores first, ties by key."""
    placed = ranking.running(rows.select((-F.col(score)).alias("s"), key, F.col(label).cast("long").alias("y"), F.lit(1).cast("long").alias("one")), ["s", key], ["y", "one"])
    precision = (F.col("y_before") + F.col("y")) / (F.col("one_before") + 1)
    return placed.agg(F.round(F.avg(F.when(F.col("y") == 1, precision)), 6).alias("average_precision"))


def lift_at(rows: DataFrame, score: str, label: str, key: str, shares: tuple[float, ...] = (0.05, 0.1, 0.2)) -> DataFrame:
    """Rate among the best share of the scores over the rate among all, for each share; at least one row is taken."""
    placed = ranking.ranked(rows.select((-F.col(score)).alias("s"), key, F.col(label).cast("int").alias("y")), ["s", key])
    base = F.avg("y")
    top = lambda share: F.avg(F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("rank_all") * share)), F.col("y")))
    return placed.agg(*[F.round(top(x) / F.nullif(base, F.lit(0.0)), 6).alias(f"lift_{round(100 * x)}") for x in shares])


def calibration(rows: DataFrame, score: str, label: str, key: str, bins: int = 10) -> DataFrame:
    """Mean score and rate of each of `bins` equal parts of the order by score and key; the first parts take what is over."""
    placed = ranking.ranked(rows, [score, key])
    i, size, over = F.col("rank") - 1, F.floor(F.col("rank_all") / bins), F.col("rank_all") % bins
    tile = F.when(i < over * (size + 1), F.floor(i / (size + 1))).otherwise(over + F.floor((i - over * (size + 1)) / F.nullif(size, F.lit(0)))) + 1
    return placed.withColumn("bin", tile.cast("int")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(F.col(label).cast("int")), 6).alias("rate"))


def gaussian_bayes(rows: DataFrame, label: str, features: list[str], key: str) -> DataFrame:
    """Class of greatest posterior under per-class normal features; deviations have a floor of 1e-6. Classes are few."""
    stats = rows.groupBy(F.col(label).alias("c")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.greatest(F.stddev_pop(f), F.lit(1e-6)).alias(f"s_{f}") for f in features])
    # a row meets all classes where it stands, as one array of them, the last being the least, and keeps one
    classes = stats.agg(F.sort_array(F.collect_list(F.struct("c", *[x for x in stats.columns if x != "c"])), asc=False).alias("_classes"))

    def log_p(k: Column) -> Column:
        told = F.ln(k["n"])
        for f in features:
            told = told - F.ln(k[f"s_{f}"]) - F.pow((F.col(f) - k[f"m_{f}"]) / k[f"s_{f}"], 2) / 2
        return F.round(told, 9)

    best = F.array_max(F.transform("_classes", lambda k, i: F.struct(log_p(k).alias("lp"), i.alias("i"))))
    scored = rows.select(key, *features).join(F.broadcast(classes)).select(key, "_classes", best.alias("_best"))
    told = scored.select(key, F.col("_best.lp").alias("lp"), F.get("_classes", F.col("_best.i"))["c"].alias("c"))
    return relational.latest_per_key(told, [key], [F.desc("lp"), F.col("c")]).select(key, F.col("c").alias("predicted"))


def class_share(rows: DataFrame, key: str, price: str) -> DataFrame:
    """Share of all that are strictly cheaper, in percent, and the label that stands for. rows are held: a mean computed twice may differ in its
    last bits, and would then miss its own count."""
    rows = cut(rows.select(key, price))
    by_price = ranking.running(rows.groupBy(F.col(price).alias("_p")).agg(F.count(F.lit(1)).alias("n")), ["_p"], ["n"])
    cheaper = F.col("n_before") * 100.0 / F.col("n_all")
    label = F.when(F.col("share") >= 90, "elite").when(F.col("share") >= 65, "business").when(F.col("share") >= 30, "comfort").otherwise("economy")
    return rows.join(by_price, F.col(price).eqNullSafe(F.col("_p"))).select(key, F.round(cheaper, 6).alias("share")).withColumn("label", label)


# ---- money


def net_yield(price: Column, rent: Column, occupancy: float = 0.95, opex: float = 0.10, multiplier: float = 1.02) -> tuple[Column, Column]:
    gross = F.bround(rent * 12 * 100 / price, 1)
    net = F.bround(rent * 12 * (occupancy - opex) * 100 / (price * multiplier), 1)
    return gross, net


def annuity(principal: Column, yearly_pct: float, months: int) -> Column:
    r = yearly_pct / 1200
    return principal * (r * (1 + r) ** months / ((1 + r) ** months - 1))


def cash_flow(rows: DataFrame, key: str, income: Column, cost: Column, start: Column, months: int = 12) -> DataFrame:
    """Month by month balance, and the deepest gap."""
    monthly = rows.select(key, income.alias("i"), cost.alias("c"), start.alias("s"), F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month"))
    running = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.withColumn("balance", F.round(F.sum(F.col("i") - F.col("c")).over(running) - F.col("s"), 4)).groupBy(key).agg(F.max_by("balance", "month").alias("final"), F.min("balance").alias("gap"))
