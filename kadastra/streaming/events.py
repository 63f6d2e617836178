"""Change streams: windows with late data, alerts without repeats, price drops with state, expiry and reopening.

Every function takes a streaming (or static) DataFrame and returns one; `drain` runs what is available into Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kadastra.shipping import ship


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process all that is available now, once, and read back what was written; offsets are kept beside it, so a second run
    goes on where the first ended."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data").option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def source(spark: SparkSession, path: str, ts_col: str = "ts", per_batch: int | None = None) -> DataFrame:
    """A stream over a folder of Parquet files, or over one file, with UTC timestamps."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        reader, path = reader.option("pathGlobFilter", hadoop.getName()), hadoop.getParent().toString()
    return reader.parquet(path).withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def windowed_counts(events: DataFrame, keys: list[str], ts: str, size: str, late: str, start: str | None = None) -> DataFrame:
    """Counts and sums by tumbling window; windows close when the watermark passes them, later rows are left out."""
    window = F.window(ts, size, startTime=start) if start else F.window(ts, size)
    grouped = events.withWatermark(ts, late).groupBy(*keys, window.alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("started"), "n", "total")


def unique_alerts(alerts: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """Alerts without repeats of the same keys while the watermark lasts."""
    return alerts.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def price_drops(prices: DataFrame, key: str, price: str, ts: str, share: float = 0.95) -> DataFrame:
    """An alert for each price under `share` of the last one seen for its key; the last price is then replaced either way."""
    ship(prices.sparkSession)

    def follow(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values([ts, price])
        out = []
        for moment, new in zip(rows[ts], rows[price], strict=True):
            if last is not None and new < share * last:
                out.append((group[0], last, new, moment))
            last = float(new)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "before", "after", ts])

    kind = prices.schema[key].dataType.simpleString()
    return prices.groupBy(key).applyInPandasWithState(follow, f"{key} {kind}, before double, after double, {ts} timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def stale(listings: DataFrame, as_of, days: int, coverage_pct: float, least_coverage: float = 95.0) -> DataFrame:
    """Listings to be archived as unseen for so many days; none while the last sweep was not whole enough to tell."""
    healthy = F.lit(coverage_pct >= least_coverage)
    return listings.filter(healthy & F.col("archived_at").isNull() & (F.col("last_seen") < as_of - F.expr(f"INTERVAL {days} DAYS")))


def reopened(listings: DataFrame, sightings: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(reopened, episodes). A listing seen after it was archived is a candidate; a later sighting that confirms it (id, seen_at,
    price, confirmed) reopens it, and its time away becomes an episode (id, archived_at, reactivated_at, days_away). Sightings
    that came after as_of are not known yet; of several confirmed ones the first counts."""
    waiting = listings.filter("archived_at is not null and last_seen > archived_at").select("id", "archived_at")
    known = sightings.filter(F.col("confirmed") & (F.col("seen_at") <= as_of)).select(F.col("id").alias("s_id"), "seen_at", "price")
    first = waiting.join(known, (F.col("id") == F.col("s_id")) & (F.col("seen_at") > F.col("archived_at"))).groupBy("id", "archived_at").agg(F.min(F.struct("seen_at", "price")).alias("s"))
    away = (F.unix_micros("s.seen_at") - F.unix_micros("archived_at")) / F.lit(86_400_000_000.0)
    episodes = first.select("id", "archived_at", F.col("s.seen_at").alias("reactivated_at"), F.round(away, 4).alias("days_away"))
    back = first.select(F.col("id").alias("b_id"), F.col("s.seen_at").alias("b_seen"), F.col("s.price").alias("b_price"))
    opened = listings.join(back, F.col("id") == F.col("b_id")).select("id", F.col("b_price").alias("price"), F.lit(True).alias("is_active"), F.col("b_seen").alias("last_seen"))
    return opened, episodes
