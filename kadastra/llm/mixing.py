"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / source_size times. With the source's documents in order of size, the
prefix sum of expected copies is rank * rate; one offset per source is added, and a document is emitted once for each
integer boundary that its stretch crosses. As neighbours in that order have like sizes, the words taken stay within
about the size of the largest document of the target.

Ranks are found without bringing a source together: rows are range-partitioned by (source, size, id), ranked inside
their partition, and shifted by the counts of earlier partitions, of which there is one row per partition and source.

Defined results: null text has size 0; a null source is a source of its own, after all others; equal rows are all
counted and share copies as neighbours. A source of size 0 takes nothing. An empty table gives an empty result. Other
columns pass through `emit` unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.llm.common import cut, word_count

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_REPEAT = 2.0
SEED = "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> with target: shares by weight, none above max_repeat times its source, the excess reshared.

    One row per source; sources fill up in order of size / weight, so a running sum finds the level in one pass.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("i", F.row_number().over(by_name) - 1).select(
        "source",
        F.col("source_size"),
        "i",
        F.element_at(cycle, (F.col("i") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(max_repeat)).alias("cap"),
    )
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "i")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        weighed.withColumn("budget", F.sum("source_size").over(everything) * F.lit(budget_share))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open_weight"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    first = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "i", "level"))).over(everything)
    return level.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("first.level").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("first.level") * F.col("weight")))
        .alias("target"),
    )


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **shares) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    aimed = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **shares)
    dealt = cut(
        sized.repartitionByRange("source", "size", "doc_id").withColumn("part", F.spark_partition_id())
    )  # held, as sampled range bounds may differ between two runs
    counts = dealt.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(
        F.col("part").alias("s_part"), F.col("source").alias("s_source"), "start"
    )
    aimed = aimed.select(F.col("source").alias("t_source"), "source_size", "target")
    starts = starts.join(aimed, F.col("s_source").eqNullSafe(F.col("t_source")))
    inside = Window.partitionBy("part", "source").orderBy("size", "doc_id")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        dealt.withColumn("rn", F.row_number().over(inside))
        .join(starts, (F.col("part") == F.col("s_part")) & F.col("source").eqNullSafe(F.col("s_source")))
        .withColumn("rank", (F.col("start") + F.col("rn") - 1).cast("double"))
        .withColumn("rate", rate)
        .withColumn("offset", offset)
        .withColumn("copies", F.floor(F.col("offset") + F.col("rate") * (F.col("rank") + 1)) - F.floor(F.col("offset") + F.col("rate") * F.col("rank")))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def emit(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: every row of docs as often as the plan says, with its own columns.

    Rows with the same id, source and size are matched one by one in any order; they are alike to the plan.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    keyed = packed.select(
        "_row",
        F.col(f"_row.{id_col}").alias("_id"),
        F.col(f"_row.{source_col}").alias("_source"),
        word_count(F.col(f"_row.{text_col}")).alias("_size"),
    )
    keyed = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.col(f"_row.{text_col}"))))
    ways = plan.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("copies").alias("p_copies"))
    ways = ways.withColumn("p_n", F.row_number().over(Window.partitionBy("p_id", "p_source", "p_size").orderBy("p_copies")))
    same = F.col("_id").eqNullSafe(F.col("p_id")) & F.col("_source").eqNullSafe(F.col("p_source")) & (F.col("_size") == F.col("p_size")) & (F.col("_n") == F.col("p_n"))
    return (
        keyed.join(ways.filter("p_copies > 0"), same)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("p_copies").cast("int"))))
        .select("_row.*")
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, ((SELECT CAST(sum(source_size) AS BIGINT) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0))
            / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, i LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM f) IS NULL THEN cap ELSE least(cap, (SELECT level FROM f) * weight) END AS target FROM w),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS DOUBLE) AS rnk,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(('0x' || substr(md5('mix-1|' || coalesce(d.source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(u + rate * (rnk + 1)) - floor(u + rate * rnk)) * size AS BIGINT) AS taken FROM r
"""
