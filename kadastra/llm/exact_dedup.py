"""Exact duplicates with a heavy-hitter split.

A frequent-items sketch (a Misra-Gries summary) names the digests that may be frequent. The exact counts and winners of the
HOT_DIGESTS most frequent come from a map-side aggregate, are broadcast, and settle their rows without a shuffle. All other
digests are aggregated before their shuffle, and the winners joined to their rows, which Spark can split by skew: no task
needs the rows of one digest together, however many they are.

Only DataFrame operations are used.

Defined results: null text counts as empty, and so equals every text of white space alone. A null id ranks after every
other id of the same length. Of rows that agree in text, length and id exactly one is kept. An empty table gives an
empty result. Columns other than the id and the text are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra.llm.common import SPACES, cut

#: Most digests that are settled by broadcast: the bound of the broadcast side.
HOT_DIGESTS = 1024
#: Counters of the sketch; a digest with over rows * 4 / 3 / SKETCH_ITEMS rows can't be missed.
SKETCH_ITEMS = 4096


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without white space."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES, "").cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the most code points stays, then the smallest id.
    """
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
            digest(F.col(text_col)).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row_id"),
        )
    )
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("best")
    likely = rows.agg(F.expr(f"approx_top_k(text_sha256, {HOT_DIGESTS}, {SKETCH_ITEMS})").alias("top")).select(
        F.explode("top.item").alias("text_sha256")
    )
    winners = (
        rows.join(F.broadcast(likely), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(best, F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    winners = cut(winners)  # at most HOT_DIGESTS rows
    hot = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    others = rest.groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("group_size"))
    return hot.unionByName(rest.join(others, "text_sha256")).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.row_id") == F.col("row_id")).alias("kept"),
        "text_sha256",
    )


ORACLE_SQL = r"""
WITH b AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM b WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
