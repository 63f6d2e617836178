"""Whether two records are one building: fuzzy names block and score, place, developer and address add, phases and product lines cap."""

from __future__ import annotations

from itertools import product as product_of

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kadastra.functions import geo, text
from kadastra.operators import name_tiles, relational
from kadastra.shared import cut
from kadastra.shipping import ship

# Weights, thresholds, and the words that name product lines.
LEAST_NAME, NAME_EXACT, NAME_FUZZY = 0.55, 0.60, 0.35
GEO, GEO_M, DEVELOPER, ADDRESS = 0.25, 150.0, 0.15, 0.15
BONUS, CAP, SAME_BASE = 0.10, 0.79, 0.8
#: Names of either side that one part of a tile holds.
TILE = 2048
PRODUCTS = ("gold", "premium", "comfort", "lux", "luxe", "deluxe", "business", "smart", "standard", "plus", "elite", "vip", "prime", "grand")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_id, r_id, similarity, translit, phase, line) of names (id, name) at least LEAST_NAME alike as they are, or else in Latin letters; phase and line
    are 1 where phases or product lines fit, 2 where they clash, 0 where nothing is known. Names meet by their rarest trigrams, never all of a brand or city.

    Of n trigrams at least ceil(LEAST_NAME * n) are shared, so that one of the first n - ceil(LEAST_NAME * n) + 1 is, in any one order of all.
    """
    ship(left.sparkSession)

    def facts(rows: DataFrame) -> DataFrame:
        known = rows.withColumns({"_plain": relational.trigrams(F.col("name")), "_latin": relational.trigrams(text.transliterate(F.col("name"))), "_p": text.phase_and_base(F.col("name"))})
        return cut(known.select("id", "_plain", "_latin", relational.trigrams(F.col("_p.base")).alias("base"), F.col("_p.phase").alias("phase"), product(F.col("name")).alias("product"), (F.col("_plain") != F.col("_latin")).alias("changed")))

    sides = [facts(left), facts(right)]
    kinds = F.array(F.struct(F.lit(False).alias("latin"), F.col("_plain").alias("grams")), F.struct(F.lit(True).alias("latin"), F.col("_latin").alias("grams")))
    each = [s.withColumn("_k", F.explode(kinds)).select("id", "_k.latin", F.explode("_k.grams").alias("_t")) for s in sides]
    times = each[1].groupBy("latin", "_t").agg(F.count(F.lit(1)).alias("_n"))
    # trigrams in one order of all, the rarest first: their number of times stands before them
    ordered = F.concat(F.lpad(F.coalesce("_n", F.lit(0)).cast("string"), 12, "0"), F.col("_t"))
    size = F.size("grams")
    tiles = []
    for side, rows in zip(sides, each, strict=True):
        named = rows.join(times, ["latin", "_t"], "left").groupBy("id", "latin").agg(F.sort_array(F.collect_list(ordered)).alias("grams"))
        met = named.join(side, "id").withColumn("first", F.explode(F.slice("grams", F.lit(1), (size - F.ceil(size * LEAST_NAME - 1e-9) + 1).cast("int"))))
        tiles.append(met.select("latin", "first", "id", "grams", F.when(F.col("latin"), F.col("_plain")).alias("plain"), "base", "phase", "product", "changed"))
    # what tiles can't hold falls into parts of both sides; without a name that Latin letters change, nothing is left to compare by them
    tally = lambda rows, name: rows.groupBy("latin", "first").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(name), F.bool_or("changed").alias(f"{name}_changed"))
    many = tally(tiles[0], "ls").join(tally(tiles[1], "rs"), ["latin", "first"]).filter("not latin or ls_changed or rs_changed").select("latin", "first", "ls", "rs")
    many = cut(many)
    part = lambda n: F.pmod(F.xxhash64("id", "first"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tile = ["latin", "first", "_i", "_j"]
    one = tiles[0].join(many, ["latin", "first"]).withColumn("_i", part("ls")).withColumn("_j", every("rs")).drop("ls", "rs")
    two = tiles[1].join(many, ["latin", "first"]).withColumn("_j", part("rs")).withColumn("_i", every("ls")).drop("ls", "rs")
    answer = T.StructType().add("l_id", left.schema["id"].dataType).add("r_id", right.schema["id"].dataType).add("similarity", "double").add("translit", "boolean").add("phase", "integer").add("line", "integer")
    schema = to_arrow_schema(answer)
    judge = lambda one, two: name_tiles.told(one, two, LEAST_NAME, SAME_BASE, schema)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of partitions that is given is left alone by Spark, which would join them by their bytes, where pairs are what costs
    return one.repartition(tasks, *tile).groupBy(*tile).cogroup(two.repartition(tasks, *tile).groupBy(*tile)).applyInArrow(judge, answer)


def product(name: Column) -> Column:
    """The first word of the name that is a product line; null without one."""
    return F.nullif(F.regexp_extract(F.lower(name), rf"\b({'|'.join(PRODUCTS)})\b", 1), F.lit(""))


def _rounded(value: Column) -> Column:
    """value, from 0 to 1, as F.round gives it with four digits; only what is about to be a tie is rounded by decimals, which cost more than all else."""
    scaled = value * 10_000
    whole = F.floor(scaled + 0.5)
    return F.when(F.abs(scaled + 0.5 - F.rint(scaled + 0.5)) > 1e-6, whole / F.lit(10_000.0)).otherwise(F.round(value, 4))


def resolve(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, confidence, method) of records (id, name, lat, lon, developer, address) that may be one; what isn't known adds nothing.

    Equal phases or product lines add; unequal ones cap the score below what is merged unseen. A name without a phase is the first one, if
    the rest of both names is alike. method names what spoke, joined by +. Names are compared once, however many records bear them.
    """
    names = lambda rows: cut(rows.select("name").filter("name is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    named = {"l": names(left), "r": names(right)}
    sim = F.col("similarity")
    exact = sim >= 1
    name = F.when(exact, NAME_EXACT).otherwise(NAME_FUZZY + (sim - LEAST_NAME) / (1 - LEAST_NAME) * (NAME_EXACT - NAME_FUZZY))
    told = candidates(named["l"], named["r"]).select("l_id", "r_id", name.alias("name"), (exact.cast("int") * 2 + F.col("translit").cast("int")).alias("kind"), "phase", "line")

    def facts(rows: DataFrame, s: str) -> DataFrame:
        own = rows.join(named[s].withColumnRenamed("id", f"{s}_id"), "name")
        return own.select(f"{s}_id", F.col("id").alias(f"{s}_key"), F.struct("lat", "lon", "developer", "address", text.tokens(F.col("address")).alias("words")).alias(s))

    rows = told.join(facts(left, "l"), "l_id").join(facts(right, "r"), "r_id")
    # a degree of latitude is over 111 km
    apart = F.abs(F.col("l.lat") - F.col("r.lat")) > GEO_M / 111_000
    near = ~F.coalesce(apart, F.lit(True)) & F.coalesce(geo.haversine_km(F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon")) * 1000 <= GEO_M, F.lit(False))
    maker = F.coalesce(F.col("l.developer") == F.col("r.developer"), F.lit(False))
    shorter = F.least(F.size("l.words"), F.size("r.words"))
    street = F.coalesce(F.when(shorter > 0, F.size(F.array_intersect("l.words", "r.words")) / shorter >= 0.8), F.lit(False))
    rows = rows.withColumns({"near": near, "maker": maker, "street": street})
    near, maker, street = F.col("near"), F.col("maker"), F.col("street")
    add = lambda to, when, weight: F.least(to + F.when(when, weight).otherwise(0.0), F.lit(1.0))
    score = F.least(F.col("name") + F.when(near, GEO).otherwise(0.0) + F.when(maker, DEVELOPER).otherwise(0.0) + F.when(street, ADDRESS).otherwise(0.0), F.lit(1.0))
    score = add(add(score, F.col("phase") == 1, BONUS), F.col("line") == 1, BONUS)
    capped = F.when((F.col("phase") == 2) | (F.col("line") == 2), F.least(score, F.lit(CAP))).otherwise(score)
    said = [("name_fuzzy", "name_fuzzy_translit", "name_exact", "name_exact_translit"), ("", "geo"), ("", "developer"), ("", "address"), ("", "phase", "phase_mismatch"), ("", "product", "product_mismatch")]
    code = F.lit(0)
    for number, words in zip((F.col("kind"), near.cast("int"), maker.cast("int"), street.cast("int"), F.col("phase"), F.col("line")), said, strict=True):
        code = code * len(words) + number
    method = F.array(*[F.lit("+".join(filter(None, words))) for words in product_of(*said)])[code]
    return rows.select(F.col("l_key").alias("a"), F.col("r_key").alias("b"), _rounded(capped).alias("confidence"), method.alias("method"))
