"""Ranks over whole tables without bringing a table together, and joins on ranges by buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.shared import cut


def running(rows: DataFrame, order: list[str], amounts: list[str]) -> DataFrame:
    """Adds for each amount `<amount>_before`, the sum of all rows that come earlier in the order, and `<amount>_all`.

    Rows are range-partitioned and summed inside their partition, shifted by the sums of earlier partitions, of which there
    is one row per partition. The order must leave no ties open; null amounts count as 0.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # held, as sampled range bounds may differ between two runs
    sums = dealt.groupBy("_part").agg(*[F.coalesce(F.sum(a), F.lit(0)).alias(f"_sum_{a}") for a in amounts])
    earlier, whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    starts = sums.select("_part", *[F.coalesce(F.sum(f"_sum_{a}").over(earlier), F.lit(0)).alias(f"_from_{a}") for a in amounts], *[F.sum(f"_sum_{a}").over(whole).alias(f"{a}_all") for a in amounts])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(starts), "_part")
    before = [(F.col(f"_from_{a}") + F.coalesce(F.sum(a).over(inside), F.lit(0))).alias(f"{a}_before") for a in amounts]
    return joined.select(*rows.columns, *before, *[f"{a}_all" for a in amounts])


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Adds the row number over the whole table, from 1, and `<name>_all`, the number of rows."""
    out = running(rows.withColumn("_one", F.lit(1).cast("long")), order, ["_one"])
    return out.withColumn(name, F.col("_one_before") + 1).withColumnRenamed("_one_all", f"{name}_all").drop("_one", "_one_before")


def log_bucket(value: Column, width: float) -> Column:
    return F.floor(F.ln(F.greatest(value, F.lit(1e-9))) / F.lit(width))


def log_buckets(value: Column, low: float, high: float, width: float) -> Column:
    """The buckets of everything from low to high times the value: explode one side, and join it to log_bucket of the other."""
    return F.sequence(log_bucket(value * low * (1 - 1e-9), width), log_bucket(value * high * (1 + 1e-9), width))
