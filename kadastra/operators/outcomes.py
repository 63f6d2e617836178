"""Outcomes of listings: labels with three values (null: not known yet, never false) and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra.functions.stats import days, whole_days
from kadastra.operators import relational

LABELS = (
    "disappeared_within_30d",
    "price_reduction_within_30d",
    "survives_90d",
    "clean_disappearance_within_30d",
    "relisted_within_60d",
    "possibly_relisted",
    "possibly_moderation_removed",
)


def _after(moment: Column, n: int) -> Column:
    return moment + F.expr(f"INTERVAL {n} DAYS")


def outcome_labels(listings: DataFrame, changes: DataFrame, views: DataFrame, as_of: Column) -> DataFrame:
    """One row per listing: id, the LABELS, time_on_market, views_velocity, observation_days, censored, outcome_notes.

    changes: (listing_id, old_price, new_price, changed_at); views: (listing_id, observed_at, views_count), one for each moment;
    listings need details_fetched. A window of 30 days that begins before the first known price change is not covered.
    """
    began = changes.agg(F.min("changed_at").alias("history_start"))  # one row
    cuts = changes.filter("new_price < old_price").select("listing_id", "changed_at")
    end = F.coalesce("archived_at", as_of)
    reduced = (
        listings.select("id", "first_seen", "archived_at")
        .join(cuts, F.col("id") == F.col("listing_id"))
        .filter((F.col("changed_at") <= _after(F.col("first_seen"), 30)) & (F.col("changed_at") <= end))
        .select(F.col("id").alias("cut_id"))
        .distinct()
    )
    seen = views.groupBy(F.col("listing_id").alias("view_id")).agg(
        F.min("observed_at").alias("v0"), F.max("observed_at").alias("v1"), F.min_by("views_count", "observed_at").alias("n0"), F.max_by("views_count", "observed_at").alias("n1")
    )
    again = relational.relists(listings).select(F.col("id").alias("again_id"), F.col("relisted").alias("strict"), F.col("possibly_relisted").alias("loose"))
    rows = listings.join(reduced, F.col("id") == F.col("cut_id"), "left").join(again, F.col("id") == F.col("again_id"), "left").join(seen, F.col("id") == F.col("view_id"), "left").crossJoin(F.broadcast(began))

    gone, first = F.col("archived_at"), F.col("first_seen")
    life, age = days(gone, first), days(as_of, first)
    early = gone.isNotNull() & (life <= 30)
    cut, uncovered = F.col("cut_id").isNotNull(), F.coalesce(first < F.col("history_start"), F.lit(False))
    strict, loose = F.coalesce("strict", F.lit(False)), F.coalesce("loose", F.lit(False))
    open_ = as_of < _after(gone, 60)
    removed = F.coalesce(gone.isNotNull() & (life <= 2) & ~F.coalesce("details_fetched", F.lit(False)), F.lit(False))
    disappeared = F.when(early, F.when(cut, False).when(uncovered, None).otherwise(True)).when(gone.isNotNull() | (age > 30), False)
    reduction = F.when(cut, True).when(uncovered, None).when(early | (age >= 30), False)
    clean = F.when(disappeared.isNull(), None).when(~disappeared, False).when(removed | strict, False).when(open_, None).otherwise(True)
    known = lambda found: F.when(gone.isNull(), None).when(found, True).when(open_, None).otherwise(False)
    spread = days(F.col("v1"), F.col("v0"))
    notes = F.concat_ws(
        "; ",
        F.when(first < F.col("history_start"), "price history begins later"),
        F.when(removed, "gone within two days, details unconfirmed"),
        F.when(strict, "looks relisted"),
        F.when(loose, "possibly relisted"),
        F.when(gone.isNotNull() & open_, "window of 60 days still open"),
        F.when(gone.isNull(), "censored"),
    )
    return rows.select(
        "id",
        disappeared.alias("disappeared_within_30d"),
        reduction.alias("price_reduction_within_30d"),
        F.when(gone.isNotNull(), life >= 90).when(age >= 90, True).alias("survives_90d"),
        whole_days(gone, first).alias("time_on_market"),
        F.when(spread >= 1, F.round((F.col("n1") - F.col("n0")) / spread, 2)).alias("views_velocity"),
        clean.alias("clean_disappearance_within_30d"),
        known(strict).alias("relisted_within_60d"),
        F.when(strict, False).otherwise(known(loose)).alias("possibly_relisted"),
        removed.alias("possibly_moderation_removed"),
        whole_days(end, first).alias("observation_days"),
        gone.isNull().alias("censored"),
        F.nullif(notes, F.lit("")).alias("outcome_notes"),
    )


def outcome_report(labels: DataFrame) -> DataFrame:
    """For each of the LABELS: how many listings have it resolved, and how many of these are true."""
    counts = labels.agg(*[f for c in LABELS for f in (F.count(c).alias(f"{c}_n"), F.count_if(F.col(c)).alias(f"{c}_t"))])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"{c}_n").alias("resolved"), F.col(f"{c}_t").alias("n_true")) for c in LABELS])).alias("r")).select("r.*")
