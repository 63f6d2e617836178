"""Which record is which: merging of sources, binding of listings to buildings and houses, photos of pairs."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.functions import geo
from kadastra.operators import identity
from kadastra.shared import cut


def merge_sources(rows: DataFrame, key: str, fields: list[str], least: int = 3) -> DataFrame:
    """(key, kept): rows that agree in at least `least` known fields are one, along chains; the one with the most known fields
    stays, then the least key.

    Equal combinations of fields make a group, and each member is linked to the group's first, so a group costs a row
    for each member and never its pairs.
    """
    combos = F.array(*[F.when(F.expr(" and ".join(f"{c} is not null" for c in own)), F.xxhash64(F.lit(i), *own)) for i, own in enumerate(combinations(fields, least))])
    keyed = rows.select(F.col(key).alias("a"), F.explode(F.array_compact(combos)).alias("_k"))
    first = keyed.groupBy("_k").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    links = keyed.join(first, "_k").filter("a <> b").select("a", "b").distinct()
    groups = identity.min_label_groups(links)
    known = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    placed = rows.select(F.col(key).alias("_id"), known.alias("_n")).join(groups, F.col("_id") == F.col("node"), "left").select("_id", "_n", F.coalesce("root", "_id").alias("_g"))
    best = placed.groupBy("_g").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").alias("id"))).alias("best"))
    return placed.join(best, "_g").select(F.col("_id").alias(key), F.col("best.id").alias("kept"))


def unique_keys(dims: DataFrame, key: Column, dim_id: str) -> DataFrame:
    """(_key, _id) of keys that exactly one dimension row has."""
    return dims.select(key.alias("_key"), F.col(dim_id).alias("_id")).filter("_key is not null and _key <> ''").groupBy("_key").agg(F.min("_id").alias("_id"), F.count_distinct("_id").alias("_n")).filter("_n = 1").drop("_n")


def propose_bindings(listings: DataFrame, complexes: DataFrame, degrees: float = 0.002, most_m: float = 150.0) -> DataFrame:
    """(id, bound, proposed, method, transition) for listings (id, bound, house, url_key, name_key, lat, lon) and complexes
    (complex_id, house, url_key, name_key, lat, lon): by house, else URL, else a name that only one has, else the nearest within 150 m.

    transition: bind (nothing was bound), keep, change, or none (nothing is proposed).
    """
    one = lambda c: unique_keys(complexes, F.col(c).cast("string"), "complex_id").withColumnRenamed("_key", f"_{c}").withColumnRenamed("_id", f"by_{c}")
    rows = listings
    for c in ("house", "url_key", "name_key"):
        rows = rows.join(one(c), F.col(c).cast("string") == F.col(f"_{c}"), "left").drop(f"_{c}")
    # each place of listings meets each place of complexes once, with its least id
    spots = listings.filter("lat is not null and lon is not null").select("lat", "lon").distinct().withColumn("c", F.explode(geo.around(F.col("lat"), F.col("lon"), degrees)))
    places = complexes.filter("lat is not null and lon is not null").groupBy(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).agg(F.min("complex_id").alias("complex_id")).withColumn("c", geo.cell(F.col("p_lat"), F.col("p_lon"), degrees))
    near = spots.join(places, "c").withColumn("d", geo.planar_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))).filter(F.col("d") <= most_m)
    near = near.groupBy("lat", "lon").agg(F.min(F.struct(F.round("d", 3).alias("d"), "complex_id")).alias("n")).select(F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"), F.col("n.complex_id").alias("by_geo"))
    rows = rows.join(near, (F.col("lat") == F.col("n_lat")) & (F.col("lon") == F.col("n_lon")), "left")
    ways = ["house", "url_key", "name_key", "geo"]
    proposed = F.coalesce(*[F.col(f"by_{w}") for w in ways])
    method = F.coalesce(*[F.when(F.col(f"by_{w}").isNotNull(), F.lit(w)) for w in ways])
    transition = F.when(proposed.isNull(), "none").when(F.col("bound").isNull(), "bind").when(F.col("bound") == proposed, "keep").otherwise("change")
    return rows.select("id", "bound", proposed.alias("proposed"), method.alias("method"), transition.alias("transition"))


def rebind(listings: DataFrame, complexes: DataFrame) -> DataFrame:
    """(id, complex_id, method): listings (id, address_key, title) by an address that one complex alone has, else by the longest
    complex name (name_key, of whole words) that the title holds; equal lengths go to the least id.

    Titles and names meet by runs of as many words as names have, so a title is never compared with every name.
    """
    by_address = unique_keys(complexes, F.col("address_key"), "complex_id")
    names = complexes.filter("name_key is not null and name_key <> ''").groupBy("name_key").agg(F.min("complex_id").alias("n_id"))
    lengths = [r[0] for r in names.select(F.size(F.split("name_key", " ")).alias("n")).distinct().orderBy("n").collect()]  # a few word counts
    words = F.split(F.lower(F.trim("title")), r"\s+")
    run_of = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.expr("array('')"))
    runs = F.flatten(F.array(*[run_of(n) for n in lengths])) if lengths else F.expr("array('')")
    grams = listings.withColumn("w", words).select("id", F.explode(F.array_distinct(runs)).alias("run"))
    titled = grams.join(names, F.col("run") == F.col("name_key")).groupBy("id").agg(F.min(F.struct((-F.length("run")).alias("l"), "n_id")).alias("t")).select(F.col("id").alias("t_id"), F.col("t.n_id").alias("by_title"))
    rows = listings.join(by_address, F.col("address_key") == F.col("_key"), "left").join(titled, F.col("id") == F.col("t_id"), "left")
    method = F.when(F.col("_id").isNotNull(), "address").when(F.col("by_title").isNotNull(), "title")
    return rows.select("id", F.coalesce("_id", "by_title").alias("complex_id"), method.alias("method"))


def nearest_house(wanted: DataFrame, houses: DataFrame, degrees: float = 0.001) -> DataFrame:
    """(umbrella, number, lat, lon, house_id): the house nearest to each place of `wanted` (umbrella, number, lat, lon, all distinct) among the houses
    (umbrella, number, house_id, lat, lon) of its umbrella and number, nulls being equal; by metres to three places, then least id.

    Places look into the nine cells around them. What may be nearer outside stays open for cells four times as wide, until they hold the world.
    """
    key = ["umbrella", "number", "lat", "lon"]
    named = lambda rows, p, *more: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in [*key, *more]])
    meet = lambda p, q, cols: reduce(lambda x, y: x & y, [F.col(f"{p}_{c}").eqNullSafe(F.col(f"{q}_{c}")) for c in cols])
    known = lambda rows: rows.filter("lat is not null and lon is not null")
    places = cut(named(known(houses).groupBy(*key).agg(F.min("house_id").alias("house_id")), "h", "house_id"))
    open_ = cut(named(known(wanted), "w").join(places.select("h_umbrella", "h_number").distinct(), meet("w", "h", key[:2]), "left_semi"))
    told, d = None, F.round(geo.planar_m(F.col("w_lat"), F.col("w_lon"), F.col("h_lat"), F.col("h_lon")), 3)
    while True:
        everything = degrees >= 360
        sought = open_.withColumn("c", F.explode(geo.around(F.col("w_lat"), F.col("w_lon"), degrees)))
        met = sought.join(places.withColumn("h_c", geo.cell(F.col("h_lat"), F.col("h_lon"), degrees)), meet("w", "h", key[:2]) & (F.col("c.i") == F.col("h_c.i")) & (F.col("c.j") == F.col("h_c.j")))
        best = met.groupBy(*[f"w_{c}" for c in key]).agg(F.min(F.struct(d.alias("d"), F.col("h_house_id").alias("house_id"))).alias("n"))
        safe = F.lit(True) if everything else F.col("n.d") < F.cos(F.radians("w_lat")) * (degrees * 111_000.0) - 0.001
        sure = cut(best.filter(safe).select(*[F.col(f"w_{c}").alias(c) for c in key], F.col("n.house_id").alias("house_id")))
        told = sure if told is None else told.unionByName(sure)
        open_ = cut(open_.join(named(sure, "s"), meet("w", "s", key), "left_anti"))
        if everything or open_.isEmpty():
            return told
        degrees *= 4


def resolve_houses(listings: DataFrame, houses: DataFrame) -> DataFrame:
    """(id, house_id, method): listings (id, umbrella, number, text, lat, lon) to the houses (house_id, umbrella, number, token, lat, lon) of
    their umbrella: a number that one house has; else the nearest of those with the number; else a token of the text that one
    house has; else the nearest. Numbers and words meet counts of their houses, and each place looks for its nearest once, so that
    an umbrella's listings are never paired with its houses."""
    numbered = houses.filter("number is not null").groupBy("umbrella", "number").agg(F.count(F.lit(1)).alias("n_same"), F.min("house_id").alias("low"))
    tokens = houses.filter("token is not null").groupBy("umbrella", F.lower("token").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.min("house_id").alias("low"))
    words = listings.select("id", "umbrella", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word"))
    named = words.join(tokens, ["umbrella", "word"]).groupBy("id").agg(F.sum("n").alias("n_named"), F.min("low").alias("named"))
    known = listings.select("id", "umbrella", "number", "lat", "lon").join(numbered, ["umbrella", "number"], "left").join(named, "id", "left")
    # the number that the nearest house must have; none if any will do
    asks = F.col("n_same").isNotNull()
    known = cut(known.withColumn("asked", F.when(asks, F.col("number"))))
    wanted = known.filter(F.when(asks, F.col("n_same") > 1).otherwise(F.coalesce(F.col("n_named") != 1, F.lit(True)))).select("umbrella", F.col("asked").alias("number"), "lat", "lon").distinct()
    own = houses.select("umbrella", "number", "house_id", "lat", "lon")
    near = nearest_house(wanted, own.filter("number is not null").unionByName(own.withColumn("number", F.lit(None).cast(own.schema["number"].dataType))))
    near = near.select(F.col("umbrella").alias("n_umbrella"), F.col("number").alias("n_number"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"), F.col("house_id").alias("near"))
    met = (F.col("umbrella") == F.col("n_umbrella")) & F.col("asked").eqNullSafe(F.col("n_number")) & (F.col("lat") == F.col("n_lat")) & (F.col("lon") == F.col("n_lon"))
    rows = known.join(near, met, "left")
    house = F.when(asks, F.coalesce("near", "low")).when(F.col("n_named") == 1, F.col("named")).otherwise(F.col("near"))
    method = F.when(F.col("n_same") == 1, "number").when(F.col("n_same") > 1, "number+nearest").when(F.col("n_named") == 1, "token").when(F.col("near").isNotNull(), "nearest")
    return rows.select("id", house.alias("house_id"), method.alias("method"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def match_photos(left: DataFrame, right: DataFrame, most_bits: int = 10, least_cosine: float = 0.9) -> DataFrame:
    """(pair, a, b, tier, score): photos of the two sides of each pair of listings, matched greedily: equal digests first, then
    fingerprints by least distance, then vectors by greatest cosine; each photo once. Photos (pair, photo, sha, phash, v).

    Candidates of a pair are walked from the best on, and one is taken if neither of its photos is.
    """
    a = left.select("pair", F.col("photo").alias("a"), F.col("sha").alias("a_sha"), F.col("phash").alias("a_ph"), F.col("v").alias("a_v"))
    b = right.select("pair", F.col("photo").alias("b"), F.col("sha").alias("b_sha"), F.col("phash").alias("b_ph"), F.col("v").alias("b_v"))
    bits, cos = hamming(F.col("a_ph"), F.col("b_ph")), cosine("a_v", "b_v")
    tier = F.when(F.col("a_sha") == F.col("b_sha"), 0).when(bits < most_bits, 1).when(cos >= least_cosine, 2)
    score = F.when(tier == 0, 0.0).when(tier == 1, bits.cast("double")).otherwise(-F.round(cos, 9))
    every = a.join(b, "pair").select("pair", "a", "b", tier.alias("tier"), score.alias("score")).filter("tier is not null")  # photos of a listing are few
    open_ = F.sort_array(F.collect_list(F.struct("tier", "score", "a", "b")))
    taken = F.aggregate(
        "all",
        F.slice("all", 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda t: (t["a"] == x["a"]) | (t["b"] == x["b"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return every.groupBy("pair").agg(open_.alias("all")).select("pair", F.explode(taken).alias("m")).select("pair", "m.a", "m.b", "m.tier", "m.score")

