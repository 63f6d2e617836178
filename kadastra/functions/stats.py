"""The market's several quantiles, kept apart, and other statistics as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_quantile(value: Column, q: float) -> Column:
    """Continuous percentile, interpolated between neighbours."""
    return F.percentile(value, F.lit(q))


def truncated_quantile(value: Column, q: float) -> Column:
    """Inclusive quantile cut to a whole number, as reports print it."""
    return F.percentile(value, F.lit(q)).cast("long")


def floor_index_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """The element at floor(n * q), at most the last: not interpolated. A rank window, so no group is collected."""
    order = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    ranked = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.row_number().over(order).alias("_r"), F.count(F.lit(1)).over(whole).alias("_n")) if value not in keys else df
    return ranked.filter(F.col("_r") == F.least(F.floor(F.col("_n") * q), F.col("_n") - 1) + 1).select(*keys, F.col("_v").alias(name))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """The least value at which half of the weight is reached; ties by value, then weight."""
    order = Window.partitionBy(*keys).orderBy(value, weight).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_run", F.sum(weight).over(order)).withColumn("_all", F.sum(weight).over(Window.partitionBy(*keys)))
    return summed.filter(F.col("_run") >= F.col("_all") / 2).groupBy(*keys).agg(F.min(value).alias(name))


def average_rank_share(value: Column, *partition: str) -> Column:
    """rank / n with ties at their average rank."""
    whole = Window.partitionBy(*partition)
    ties = Window.partitionBy(*partition, value)
    return (F.rank().over(whole.orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)) / F.count(F.lit(1)).over(whole)


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two moments, cut towards zero."""
    return ((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)).cast("int")


def days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
