"""Structured Streaming queries: each drains the events that are there into the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from kadastra.plans.book import Book
from kadastra.plans.dashboards import NOW
from kadastra.shared import new_path
from kadastra.sources.market import LISTINGS_SQL, as_of
from kadastra.streaming import events as ev

book = Book()
QUERIES, ORACLE = book.queries, book.oracle


def scratch(spark, name: str) -> str:
    return new_path(spark, name)


@book.query(
    "sm_stream_windows",
    "WITH w AS (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2) SELECT event_type, CAST(d AS DATE) AS day, n, total FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
)
def sm_stream_windows(m):
    stream = ev.source(m.spark, f"{m.sf_dir}/events.parquet")
    counts = ev.drain(ev.windowed_counts(stream, ["event_type"], "ts", "1 day", "2 hours"), scratch(m.spark, "stream-windows"))
    return counts.select("event_type", F.col("started").cast("date").alias("day"), "n", F.round("total", 2).alias("total"))


@book.query(
    "sm_stream_price_drops",
    "WITH e AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, value) AS b FROM events) SELECT user_id, count(*) AS alerts, round(sum(b - value), 2) AS dropped FROM e WHERE value < 0.95::DOUBLE * b GROUP BY 1",
)
def sm_stream_price_drops(m):
    stream = ev.source(m.spark, f"{m.sf_dir}/events.parquet").select("user_id", "ts", "value")
    alerts = ev.drain(ev.price_drops(stream, "user_id", "value", "ts"), scratch(m.spark, "stream-drops"))
    return alerts.groupBy("user_id").agg(F.count(F.lit(1)).alias("alerts"), F.round(F.sum(F.col("before") - F.col("after")), 2).alias("dropped"))


@book.query("sm_stream_unique_alerts", "SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY 1, 2")
def sm_stream_unique_alerts(m):
    stream = ev.source(m.spark, f"{m.sf_dir}/events.parquet").select("user_id", "event_type", "ts")
    once = ev.drain(ev.unique_alerts(stream, ["user_id", "event_type"], "ts", "60 days"), scratch(m.spark, "stream-alerts"))
    return once.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@book.query("sm_stale", f"WITH {LISTINGS_SQL} SELECT id FROM listings WHERE archived_at IS NULL AND last_seen < {NOW} - INTERVAL 365 DAY")
def sm_stale(m):
    return ev.stale(m.listings, as_of(), 365, 99.0).select("id")
