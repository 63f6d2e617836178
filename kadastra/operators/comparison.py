"""New against resale offers around a hexagon, in circles that widen to the city."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadastra.functions import geo
from kadastra.operators import quantiles
from kadastra.shared import cut

# Radii of the scopes in hexagons (none: the whole city), the least offers of each market, the bound of spread, the band of area.
RADII = {"hex": 0, "ring1": 1, "ring2": 2, "ring4": 4, "ring8": 8, "city": None}
LEAST, MOST_SPREAD, AREA_BAND = 5, 0.50, 0.15
#: Up to this radius new offers' places, which are those of projects, say nothing.
UNSURE_RADIUS = 2


def matching(offers: DataFrame, queries: DataFrame) -> DataFrame:
    """offers once for each query with as many rooms whose area is at most 15 % from theirs. Queries are a few questions, not a table."""
    own = F.broadcast(queries.select("query", F.col("rooms").alias("_rooms"), F.col("area").alias("_area")))
    near = F.col("area").between(F.col("_area") * (1 - AREA_BAND), F.col("_area") * (1 + AREA_BAND))
    return offers.join(own, (F.col("rooms") == F.col("_rooms")) & near).drop("_rooms", "_area")


def centres(rows: DataFrame) -> DataFrame:
    """(query, q, r): for each query the hexagon of matching offers that has most pairs: the lesser count of both markets in it, then in it and
    its ring, then the counts of both up to 100, then the greatest id. Hexagons without new offers only if no other is there."""
    cells = rows.groupBy("query", "q", "r").agg(F.count_if(F.col("market") == "primary").alias("p"), F.count_if(F.col("market") == "secondary").alias("s"))
    around = F.array_append(geo.ring(F.col("q"), F.col("r")), F.struct("q", "r"))
    wide = cells.select("query", F.explode(around).alias("c"), "p", "s").groupBy("query", F.col("c.q").alias("q"), F.col("c.r").alias("r")).agg(F.sum("p").alias("p1"), F.sum("s").alias("s1"))
    name = F.concat_ws(":", F.col("q").cast("string"), F.col("r").cast("string"))
    score = F.struct((F.col("p") > 0).alias("has"), F.least("p", "s").alias("own"), F.least("p1", "s1").alias("near"), (F.least("p1", F.lit(100)) + F.least("s1", F.lit(100))).alias("many"), name.alias("id"))
    best = cells.join(wide, ["query", "q", "r"]).groupBy("query").agg(F.max_by(F.struct("q", "r"), score).alias("c"))
    return best.select("query", "c.q", "c.r")


def compare(offers: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, scope, q, r, both markets' n, median, spread, complexes, status, delta_pct) for each query (query, rooms, area, q, r) and each scope.

    offers: market (primary or secondary), rooms, area, price, complex_id, q, r. A query without a hexagon takes its centre. status: comparable,
    unsure_places, too_few or too_scattered; delta_pct, by how much new offers are cheaper for a square metre, is told of the first alone.
    Medians and quartiles are exact, also of the city.
    """
    rows = cut(matching(offers, queries).withColumn("ppm2", F.col("price") / F.col("area")))
    chosen = queries.select("query", F.col("q").alias("_q"), F.col("r").alias("_r")).join(centres(rows), "query", "left").select("query", F.coalesce("_q", "q", F.lit(0)).alias("c_q"), F.coalesce("_r", "r", F.lit(0)).alias("c_r"))
    chosen = F.broadcast(cut(chosen))
    placed = rows.join(chosen, "query").withColumn("d", geo.hex_distance(F.col("q"), F.col("r"), F.col("c_q"), F.col("c_r")))
    scopes = F.array(*[F.struct(F.lit(k).alias("scope"), (F.lit(True) if v is None else F.col("d") <= v).alias("inside")) for k, v in RADII.items()])
    tiers = cut(placed.withColumn("t", F.explode(F.filter(scopes, lambda s: s["inside"]))).select("query", "t.scope", "market", "ppm2", "complex_id"))
    by = ["query", "scope", "market"]
    q = quantiles.quantiles(tiers, by, "ppm2", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    stats = tiers.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("complex_id").alias("complexes")).join(q, by)  # a few rows for each query
    side = lambda m: stats.filter(F.col("market") == m).select("query", "scope", F.struct("n", "p50", ((F.col("p75") - F.col("p25")) / F.col("p50")).alias("spread"), "complexes").alias(m))
    every = chosen.withColumn("scope", F.explode(F.array(*[F.lit(k) for k in RADII])))
    both = every.join(side("primary"), ["query", "scope"], "left").join(side("secondary"), ["query", "scope"], "left")
    n = lambda m: F.coalesce(F.col(f"{m}.n"), F.lit(0))
    small = F.col("scope").isin(*[k for k, v in RADII.items() if v is not None and v <= UNSURE_RADIUS]) & (n("primary") > 0)
    few = (n("primary") < LEAST) | (n("secondary") < LEAST)
    wild = (F.col("primary.spread") > MOST_SPREAD) | (F.col("secondary.spread") > MOST_SPREAD)
    status = F.when(small, "unsure_places").when(few, "too_few").when(wild, "too_scattered").otherwise("comparable")
    delta = F.when(status == "comparable", F.round((F.col("secondary.p50") - F.col("primary.p50")) / F.col("secondary.p50") * 100, 1))
    facts = [c for m in ("primary", "secondary") for c in (n(m).alias(f"{m}_n"), F.round(f"{m}.p50", 4).alias(f"{m}_median"), F.round(f"{m}.spread", 6).alias(f"{m}_spread"), F.coalesce(f"{m}.complexes", F.lit(0)).alias(f"{m}_complexes"))]
    return both.select("query", "scope", F.col("c_q").alias("q"), F.col("c_r").alias("r"), *facts, status.alias("status"), delta.alias("delta_pct"))
