"""Comparable offers with four levels: the same building, hexagon and ring of the same class, hexagon and ring, the city's segment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.functions import geo
from kadastra.operators import ranking
from kadastra.shared import cut

# Least offers of a level, the most that are taken, the band of area, the bound of sane prices.
SAME_COMPLEX, LEAST, MOST, AREA_BAND, MOST_PRICE = 3, 5, 30, 0.15, 200_000_000
METHODS = ("same_complex", "hex+ring+class", "hex+ring", "city_segment")


def _newest(*partition: str) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc_nulls_last("last_seen"), "c_id"))


def _lists(asked: DataFrame, known: DataFrame, keys: list[str], ringed: bool = False) -> DataFrame:
    """(keys..., rooms, area, _found): for each question (keys..., rooms, area) the newest MOST + 1 offers of these keys, or of the hexagon's ring too.

    Of the offers of one area the newest MOST + 1 are enough, and so they are of one bucket of areas: what a question meets is bounded."""
    own = [*keys, "rooms", "area"]
    there = known.withColumnRenamed("id", "c_id").withColumn("_p", _newest(*own)).filter(F.col("_p") <= MOST + 1).withColumn("_b", ranking.log_bucket(F.col("area"), AREA_BAND))
    there = there.select(*[F.col(c).alias(f"c_{c}") for c in own], "c_id", "last_seen", "value", "_b")
    questions = asked.select(*own).distinct().withColumn("_a", F.explode(ranking.log_buckets(F.col("area"), 1 - AREA_BAND, 1 + AREA_BAND, AREA_BAND)))
    at = {k: F.col(k) for k in keys}
    if ringed:
        questions = questions.withColumn("_h", F.explode(F.array_append(geo.ring(F.col("q"), F.col("r")), F.struct("q", "r")))).withColumns({"_q": F.col("_h.q"), "_r": F.col("_h.r")}).drop("_h")
        at |= {"q": F.col("_q"), "r": F.col("_r")}
    fits = (F.col("rooms") == F.col("c_rooms")) & (F.col("_a") == F.col("_b")) & F.col("c_area").between(F.col("area") * (1 - AREA_BAND), F.col("area") * (1 + AREA_BAND))
    for k, column in at.items():
        fits &= column == F.col(f"c_{k}")
    met = questions.join(there, fits)
    # first where they met, so that what is sent on is bounded too
    met = met.withColumn("_p", _newest(*own, "_a", *(["_q", "_r"] if ringed else []))).filter(F.col("_p") <= MOST + 1)
    met = met.withColumn("_p", _newest(*own)).filter(F.col("_p") <= MOST + 1)
    return met.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("_p", "c_id", "value"))).alias("_found"))


def answered(offers: DataFrame, edge_m: float, value: Column) -> DataFrame:
    """(id, method, found): what comparables() tells in rows, as an array (c_id, value) for each offer that has any, newest first; value is
    told of the comparable."""
    known = offers.filter((F.col("price") > 0) & (F.col("price") < MOST_PRICE) & (F.col("area") > 0) & F.col("rooms").isNotNull())
    q, r = geo.hex_axial(F.col("lat"), F.col("lon"), edge_m)
    known = cut(known.select("id", "complex_id", "housing_class", "rooms", "area", "last_seen", q.alias("q"), r.alias("r"), value.alias("value")))
    levels = ((["complex_id"], False, SAME_COMPLEX), (["q", "r", "housing_class"], True, LEAST), (["q", "r"], True, LEAST), ([], False, 1))
    open_, done = known, []
    for number, (keys, ringed, least) in enumerate(levels):
        asked = open_.dropna(subset=keys) if keys else open_
        found = F.filter(F.col("_found"), lambda f: f["c_id"] != F.col("id"))
        found = F.when(F.size(found) >= least, F.transform(F.slice(found, 1, MOST), lambda f: F.struct(f["c_id"].alias("c_id"), f["value"].alias("value"))))
        told = cut(open_.join(_lists(asked, known.dropna(subset=keys) if keys else known, keys, ringed), [*keys, "rooms", "area"], "left").select(*known.columns, found.alias("found")))
        done.append(told.filter("found is not null").select("id", F.lit(METHODS[number]).alias("method"), "found"))
        open_ = told.filter("found is null").drop("found")
    return reduce(DataFrame.unionByName, done)


def comparables(offers: DataFrame, edge_m: float = 50.0) -> DataFrame:
    """(id, method, c_id, place): for every offer its comparables, the newest MOST of the first level that has enough.

    offers: id, complex_id, housing_class, rooms, area, price, lat, lon, last_seen. Comparables have as many rooms and an area at most 15 % from
    the offer's; the offer is not among its own. Each level answers a question once, building or hexagon, rooms and area, for all
    offers that ask it, and offers are never paired. An offer whose class isn't known skips the second level.
    """
    found = answered(offers, edge_m, F.lit(None).cast("double"))
    return found.select("id", "method", F.posexplode("found").alias("place", "f")).select("id", "method", F.col("f.c_id").alias("c_id"), (F.col("place") + 1).alias("place"))
