"""Models that are trained on the market's own rows: grouped cross-validation of a classifier, with the weight of each feature."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra.shared import cut


def exit_label(listings: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(id, label): whether a listing that was there at a moment was archived within so many days after it."""
    gone = F.col("archived_at").isNotNull() & (F.col("archived_at") <= as_of + F.expr(f"INTERVAL {days} DAYS"))
    alive = (F.col("first_seen") <= as_of) & (F.col("archived_at").isNull() | (F.col("archived_at") > as_of))
    return listings.filter(alive).select("id", gone.cast("double").alias("label"))


def grouped_scores(rows: DataFrame, features: list[str], group: str, folds: int = 5) -> DataFrame:
    """(id, fold, label, score): each row scored by a ridge logistic regression that never saw its group; groups go to folds by hash.

    Unknown features count as their mean over all rows. Folds without both labels in their training rows score the share of label 1.
    """
    means = rows.agg(*[F.avg(c).alias(c) for c in features]).collect()[0]  # one row
    known = rows.select("id", "label", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int").alias("fold"), *[F.coalesce(F.col(c).cast("double"), F.lit(float(means[c] or 0.0))).alias(c) for c in features])
    vectors = cut(VectorAssembler(inputCols=features, outputCol="raw").transform(known).select("id", "label", "fold", "raw"))
    scored = []
    for fold in range(folds):
        train, test = vectors.filter(F.col("fold") != fold), vectors.filter(F.col("fold") == fold)
        share = train.agg(F.avg("label").alias("p"), F.count_distinct("label").alias("n")).collect()[0]
        if share["n"] < 2:
            scored.append(test.select("id", "fold", "label", F.lit(float(share["p"] or 0.0)).alias("score")))
            continue
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
        model = LogisticRegression(regParam=0.01, maxIter=50).fit(scaler.transform(train))
        scored.append(model.transform(scaler.transform(test)).select("id", "fold", "label", vector_to_array("probability")[1].alias("score")))
    return reduce(DataFrame.unionByName, scored)
