"""Deal score of listings against their local market, and the scores of investors and of primary offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.functions import geo
from kadastra.functions.stats import clamp
from kadastra.operators import market
from kadastra.shared import cut

# Fixed values of the score: weights, bonuses by class, ordinals of class and finish, least pool sizes.
FACTOR_WEIGHTS = {"building": 0.30, "complex": 0.15, "area": 0.20, "floor": 0.05, "year": 0.10, "class": 0.10, "finish": 0.05, "distance": 0.05}
PART_WEIGHTS = {"price": 0.40, "quality": 0.20, "market": 0.15}
CLASS_FACTOR = {"elite": 1.25, "business": 1.12, "comfort": 1.0, "economy": 0.85}
CLASS_ORDINAL = {"elite": 100, "business": 80, "comfort": 60, "economy": 35}
FINISH_ORDINAL = {"rough": 20, "prefinish": 35, "needs_repair": 25, "finished": 60, "renovated": 75, "furnished": 80, "designer": 95}
LEAST_BUILDING, LEAST_HEX, LEAST_RING = 3, 3, 5
HEX_SHARE, RING_SHARE, CITY_SHARE = 1.0, 0.7, 0.35
AREA_BAND, POOL, TOP = 0.15, 60, 20


def lookup(values: dict[str, float], key: Column) -> Column:
    """The value of a key of a small fixed table; null for others."""
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def weighted_share(pairs: list[tuple[float, Column]]) -> Column:
    """Weighted mean of the parts that are known; null if none is."""
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, c in pairs), F.lit(0.0))
    value = sum((F.coalesce(F.lit(w) * c, F.lit(0.0)) for w, c in pairs), F.lit(0.0))
    return value / F.nullif(total, F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Likeness of two listings from 0 to 1 over the factors that both know; a and b are structs with house_id, complex_id, area,
    floor, year, class_ord, finish_ord, lat and lon."""
    both = lambda c: a[c].isNotNull() & b[c].isNotNull()
    equal = lambda c: F.when(both(c), (a[c] == b[c]).cast("double"))
    fade = lambda c, span: F.when(both(c), F.greatest(F.lit(0.0), 1 - F.abs(a[c] - b[c]) / F.lit(span)))
    factors = {
        "building": equal("house_id"),
        "complex": equal("complex_id"),
        "area": F.when(both("area"), F.greatest(F.lit(0.0), 1 - F.abs(a["area"] - b["area"]) / a["area"] / F.lit(0.15))),
        "floor": F.when(both("floor"), 1.0 / (1 + F.abs(a["floor"] - b["floor"]))),
        "year": fade("year", 10.0),
        "class": fade("class_ord", 65.0),
        "finish": fade("finish_ord", 75.0),
        "distance": F.when(both("lat") & both("lon"), F.exp(-geo.haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]) * 1000 / 500.0)),
    }
    return F.coalesce(weighted_share([(FACTOR_WEIGHTS[k], v) for k, v in factors.items()]), F.lit(0.0))


def weighted_median_of_top(pairs: DataFrame, keys: list[str], value: str, weight: str, tie: str, top: int = TOP, least: int = 1) -> DataFrame:
    """(keys, median): the weighted median of the `top` rows of the greatest positive weight of each key, ties by `tie`: the first value,
    in order, at which half of the weight is reached. Keys of under `least` rows have none."""
    own = Window.partitionBy(*keys)
    best, upto = own.orderBy(F.desc(weight), tie), own.orderBy(value, weight).rowsBetween(Window.unboundedPreceding, 0)
    enough = pairs.withColumn("_n", F.count(F.lit(1)).over(own)).filter((F.col("_n") >= least) & (F.col(weight) > 0))
    few = enough.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top)
    summed = few.withColumn("_run", F.sum(weight).over(upto)).withColumn("_all", F.sum(weight).over(own))
    return summed.filter(F.col("_run") >= F.col("_all") / 2).groupBy(*keys).agg(F.min(value).alias("median"))


def deal_scores(listings: DataFrame, edge_m: float = 400.0) -> DataFrame:
    """id, expected unit price, deal index, the parts price, quality, market and risk, the deal score, confidence, pool sizes, source.

    listings: id, lat, lon, price, area, rooms, floor, floors_total, complex_id, house_id, year, class, finish, ceiling, rating,
    yield_pct, n_in_complex, age_days, is_owner. Rows without place, price or area take no part. A listing is never in its own pool.
    A building's pool are the 30 next smaller and larger in area with as many rooms, within 15 % of the area; a hexagon's the
    first 60 ids, and that of its ring likewise, so that pools are short however dense a place is.
    """
    q, r = geo.hex_axial(F.col("lat"), F.col("lon"), edge_m)
    rows = listings.filter("lat is not null and lon is not null and price > 0 and area > 0").withColumn("ppm2", F.col("price") / F.col("area"))
    rows = rows.withColumn("rooms4", market.rooms_bucket()).withColumn("q", q).withColumn("r", r)
    ordinals = (lookup(CLASS_ORDINAL, F.col("class")).alias("class_ord"), lookup(FINISH_ORDINAL, F.col("finish")).alias("finish_ord"))
    rows = rows.withColumn("own", F.struct("id", "ppm2", "house_id", "complex_id", F.col("area").cast("double").alias("area"), "floor", "year", *ordinals, "lat", "lon"))
    cell = ["rooms4", "q", "r"]
    rows = cut(rows.withColumn("at", F.row_number().over(Window.partitionBy(*cell).orderBy("id"))))  # read by every pool

    def medians(pairs: DataFrame, least: int, name: str) -> DataFrame:
        alike = pairs.select("id", F.col("x.ppm2").alias("v"), F.col("x.id").alias("tie"), similarity(F.col("own"), F.col("x")).alias("s"))
        return weighted_median_of_top(alike, ["id"], "v", "s", "tie", least=least).withColumnRenamed("median", name)

    by_area = Window.partitionBy("complex_id", "rooms4").orderBy("area", "id").rowsBetween(-(POOL // 2), POOL // 2)
    near_area = rows.filter("complex_id is not null").select("id", "own", "area", F.collect_list("own").over(by_area).alias("pool"))
    in_band = F.col("x.area").between(F.col("area") * (1 - AREA_BAND), F.col("area") * (1 + AREA_BAND))
    building = near_area.select("id", "own", "area", F.explode("pool").alias("x")).filter((F.col("x.id") != F.col("id")) & in_band)
    m0 = cut(medians(building, LEAST_BUILDING, "m0"))

    rest = rows.join(m0, "id", "left_anti").select("id", "own", "at", *cell)
    few = rows.filter(F.col("at") <= POOL + 1).select(*cell, F.col("own").alias("x"), F.col("at").alias("x_at"))
    hexagon = rest.join(few, cell).filter((F.col("x.id") != F.col("id")) & ((F.col("x_at") <= POOL) | (F.col("at") <= POOL)))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in geo.SIX])
    spread = lambda df: df.withColumn("o", F.explode(steps)).withColumn("q", F.col("q") + F.col("o.a")).withColumn("r", F.col("r") + F.col("o.b")).drop("o")
    first = F.row_number().over(Window.partitionBy(*cell).orderBy("x.id")) <= POOL
    ring = rest.join(spread(few.filter(F.col("x_at") <= POOL)).withColumn("first", first).filter("first"), cell)
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    city = rows.groupBy("rooms4").agg(F.percentile("ppm2", F.lit(0.5)).alias("city"))
    rows = rows.join(sizes, cell).join(spread(sizes).groupBy(*cell).agg(F.sum("n").alias("ring_n")), cell, "left").join(F.broadcast(city), "rooms4")  # at most four rows
    for more in (m0, medians(hexagon, LEAST_HEX, "m1"), medians(ring, LEAST_RING, "m2")):
        rows = rows.join(more, "id", "left")

    n_hex, n_ring = F.col("n") - 1, F.coalesce("ring_n", F.lit(0))
    has_building, has_hex, has_ring = F.col("m0").isNotNull(), n_hex >= LEAST_HEX, n_ring >= LEAST_RING
    raw = F.coalesce("m0", weighted_share([(CITY_SHARE, F.col("city")), (HEX_SHARE, F.col("m1")), (RING_SHARE, F.col("m2"))]))
    ceiling = F.when(F.col("ceiling").isNull(), 1.0).otherwise(1 + clamp((F.col("ceiling") - 2.7) / 0.10 * 0.06, -0.12, 0.18))
    scored = rows.select("*", raw.alias("raw"), n_hex.alias("hex_n"), n_ring.alias("around_n"), has_building.alias("b"), has_hex.alias("d0"), has_ring.alias("d1"))
    scored = scored.withColumn("expected", F.col("raw") * F.coalesce(lookup(CLASS_FACTOR, F.col("class")), F.lit(1.0)) * ceiling).withColumn("di", F.col("expected") / F.col("ppm2"))

    whole = lambda c: clamp(F.bround(c), 0, 100)
    price = whole(50 + (F.col("di") - 1) * 200)
    age_of_house = F.when(F.col("year") >= 2022, 100.0).when(F.col("year") >= 2018, 80.0).when(F.col("year") >= 2012, 60.0).when(F.col("year") >= 2000, 40.0).when(F.col("year").isNotNull(), 20.0)
    rating = F.when(F.col("rating") > 0, F.col("rating") / 5.0 * 100)
    quality = F.coalesce(F.bround(weighted_share([(0.45, F.col("own.class_ord")), (0.35, age_of_house), (0.20, rating), (0.12, F.col("own.finish_ord"))])), F.lit(50.0))
    rent = F.coalesce(F.col("yield_pct").cast("double"), F.lit(0.0))
    supply = F.when(F.coalesce("n_in_complex", F.lit(1)) <= 3, 90).when(F.col("n_in_complex") <= 8, 60).otherwise(30)
    age = F.when(F.col("age_days").isNull(), 50).when(F.col("age_days") <= 7, 90).when(F.col("age_days") <= 30, 60).otherwise(35)
    demand = F.bround(whole(rent / 15 * 100) * 0.6 + (supply * 0.5 + age * 0.5) * 0.4)
    top = F.col("floor") == F.col("floors_total")
    risk = clamp(F.lit(100) - F.when(F.col("floor") == 1, 40).when(F.coalesce(top, F.lit(False)), 25).otherwise(0) - F.when(~F.coalesce("is_owner", F.lit(True)), 30).otherwise(0), 0, 100)
    total = sum(PART_WEIGHTS.values())
    deal = F.bround(price * (PART_WEIGHTS["price"] / total) + quality * (PART_WEIGHTS["quality"] / total) + demand * (PART_WEIGHTS["market"] / total))
    points = [(30, F.col("d0") | F.col("d1")), (10, F.col("d0")), (20, F.col("own.class_ord").isNotNull()), (15, F.col("year").isNotNull()), (15, rent > 0), (10, F.coalesce(F.col("rating") > 0, F.lit(False)))]
    confidence = sum((F.when(c, n).otherwise(0) for n, c in points), F.lit(0))
    source = F.when(F.col("b"), "building").when(F.col("d0") & F.col("d1"), "hex+ring+city").when(F.col("d1"), "ring+city").when(F.col("d0"), "hex+city").otherwise("city")
    scores = {"price_score": price, "quality_score": quality, "market_score": demand, "risk_score": risk, "deal": deal, "confidence": confidence}
    return scored.select("id", F.round("expected", 4).alias("expected"), F.round("di", 6).alias("deal_index"), *[c.cast("int").alias(k) for k, c in scores.items()], F.col("hex_n").cast("long").alias("n_hex"), F.col("around_n").cast("long").alias("n_ring"), source.alias("source"))


def investment_score(yield_pct: Column, text: Column, n_in_complex: Column, area: Column, price: Column, kind: Column, places: dict[str, int], landmarks: list[str]) -> Column:
    """Struct of yield, location, supply, liquidity, quality and total. `places` scores names found in the text, the first found counts."""
    low = F.lower(text)
    has = lambda words: F.lit(False) if not words else low.rlike("|".join(words))
    gains = F.when(yield_pct >= 20, 25).when(yield_pct >= 15, 20).when(yield_pct >= 12, 15).otherwise(5)
    location = F.lit(0)
    for name, points in reversed(places.items()):
        location = F.when(F.contains(low, F.lit(name)), points).otherwise(location)
    location = F.when(has(landmarks) & (location < 25), location + F.least(F.lit(5), 25 - location)).otherwise(location)
    supply = F.when(n_in_complex <= 2, 20).when(n_in_complex <= 5, 12).otherwise(5)
    garage = F.when(area.between(13, 20), 8).when(area < 10, 3).otherwise(5)
    other = F.when(area.between(6, 15), 8).when(area < 4, 2).when(area > 25, 4).otherwise(6)
    size = F.when(area.isNull() | (area == 0), 4).when(kind == "garage", garage).otherwise(other)
    liquidity = F.least(F.lit(15), size + F.when(price <= 4_000_000, 7).when(price <= 7_000_000, 4).otherwise(1))
    quality = F.least(F.lit(15), F.when(has(["heated", "warm", "climate"]), 6).otherwise(0) + F.when(has(["security", "24/7", "camera"]), 4).otherwise(0) + F.when(low.rlike("20(2[0-9]|3[0-9])"), 5).otherwise(0))
    parts = {"yield": gains, "location": location, "supply": supply, "liquidity": liquidity, "quality": quality}
    return F.struct(*[c.cast("int").alias(k) for k, c in parts.items()], sum(parts.values(), F.lit(0)).cast("int").alias("total"))


def primary_score(developer: Column, is_major: Column, year: Column, this_year: int, text: Column, ppm2: Column, secondary_ppm2: Column) -> Column:
    """Struct of developer, stage, discount and total (of 80, as a share of 100): an offer of a house that is being built."""
    low = F.lower(F.coalesce(text, F.lit("")))
    maker = F.when(developer.isNull() | (F.trim(developer) == ""), 10).when(is_major, 30).otherwise(18)
    left = year - this_year
    by_year = F.when(year.isNull(), 10).when(left <= 0, 18).when(left == 1, 14).otherwise(8)
    stage = F.when(low.rlike("handed over|completed|ready"), 20).when(low.rlike("foundation pit|start of sales|preliminary"), 5).otherwise(by_year)
    cheaper = (secondary_ppm2 - ppm2) / secondary_ppm2 * 100
    unknown = ppm2.isNull() | secondary_ppm2.isNull() | (secondary_ppm2 <= 0)
    discount = F.when(unknown, 12).when(cheaper > 40, 15).when(cheaper >= 15, 30).when(cheaper >= 5, 20).when(cheaper >= -5, 10).otherwise(5)
    total = F.least(F.lit(100.0), F.bround((maker + stage + discount) * 100 / F.lit(80.0)))
    return F.struct(maker.cast("int").alias("developer"), stage.cast("int").alias("stage"), discount.cast("int").alias("discount"), total.cast("int").alias("total"))
