"""Reads the star-schema tables, and shows them as the market's own: listings, price changes, exits, views.

Nothing is inferred: timestamps without zone become UTC timestamps once, here; all times are then compared with an explicit
`as_of`, never with the clock.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.functions import geo

#: The moment that all registered queries take as now.
AS_OF = "2000-01-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


class Market:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read(self.spark, self.sf_dir, name)

    @cached_property
    def listings(self) -> DataFrame:
        """One row per order: a listing with price, area, rooms, floor, district, class, building, place and life span."""
        lines = self.lineitem.groupBy("l_orderkey").agg(
            F.sum("l_quantity").alias("area"), F.count(F.lit(1)).cast("int").alias("rooms"), F.max("l_shipdate").alias("last_ship")
        )
        people = self.customer.join(F.broadcast(self.nation), F.col("c_nationkey") == F.col("n_nationkey"))
        people = people.select("c_custkey", F.col("n_name").alias("district"), F.col("c_mktsegment").alias("housing_class"))
        key = F.col("o_orderkey")
        seen = F.greatest(F.coalesce("last_ship", "o_orderdate"), "o_orderdate")
        lat, lon = geo.pseudo_place(key)
        return (
            self.orders.join(lines, key == F.col("l_orderkey"), "left")
            .join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select(
                key.alias("id"),
                F.col("o_totalprice").alias("price"),
                "area",
                F.coalesce("rooms", F.lit(1)).alias("rooms"),
                (key % 9 + 1).cast("int").alias("floor"),
                "district",
                "housing_class",
                (F.col("o_custkey") % 97).alias("complex_id"),
                F.col("o_custkey").alias("seller_id"),
                lat.alias("lat"),
                lon.alias("lon"),
                F.col("o_orderdate").alias("first_seen"),
                seen.alias("last_seen"),
                F.when(F.col("o_orderstatus") == "F", seen).alias("archived_at"),
                F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False).alias("is_active"),
                (key % 11 == 0).alias("is_duplicate"),
            )
        )

    @cached_property
    def changes(self) -> DataFrame:
        """Price changes: a part's unit price from one sale to the next, in order of time and line."""
        from pyspark.sql.window import Window

        unit = F.col("l_extendedprice") / F.col("l_quantity")
        order = Window.partitionBy("listing_id").orderBy("changed_at", "l_orderkey", "l_linenumber")
        sold = self.lineitem.select(F.col("l_partkey").alias("listing_id"), F.col("l_shipdate").alias("changed_at"), "l_orderkey", "l_linenumber", unit.alias("new_price"))
        return sold.withColumn("old_price", F.lag("new_price").over(order)).withColumn("seq", F.row_number().over(order).cast("long")).select("listing_id", "old_price", "new_price", "changed_at", "seq")


#: The same views in SQL, for the oracle.
LISTINGS_SQL = """listings AS (
  SELECT o_orderkey AS id, o_totalprice AS price, area, coalesce(rooms, 1) AS rooms, CAST(o_orderkey % 9 + 1 AS INTEGER) AS floor,
         n_name AS district, c_mktsegment AS housing_class, o_custkey % 97 AS complex_id, o_custkey AS seller_id,
         51.128 + ((o_orderkey * 37) % 1000 - 500) / 10000.0::DOUBLE AS lat, 71.43 + ((o_orderkey * 91) % 1000 - 500) / 10000.0::DOUBLE AS lon,
         o_orderdate AS first_seen, greatest(coalesce(last_ship, o_orderdate), o_orderdate) AS last_seen,
         CASE WHEN o_orderstatus = 'F' THEN greatest(coalesce(last_ship, o_orderdate), o_orderdate) END AS archived_at,
         CASE o_orderstatus WHEN 'O' THEN TRUE WHEN 'F' THEN FALSE END AS is_active, o_orderkey % 11 = 0 AS is_duplicate
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS area, CAST(count(*) AS INTEGER) AS rooms, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  LEFT JOIN (SELECT c_custkey, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey) ON c_custkey = o_custkey)"""

CHANGES_SQL = """changes AS (
  SELECT listing_id, lag(new_price) OVER w AS old_price, new_price, changed_at, row_number() OVER w AS seq
  FROM (SELECT l_partkey AS listing_id, l_shipdate AS changed_at, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS new_price FROM lineitem)
  WINDOW w AS (PARTITION BY listing_id ORDER BY changed_at, l_orderkey, l_linenumber))"""
