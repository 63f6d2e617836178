"""What the corpus operators share: the shared folder, checkpoints and word rules."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.shared import cut, held, new_path, shared_dir

#: The white space that separates words: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Java and RE2 pattern of one word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the bitmaps that keep rows without a partner out of a shuffle of texts: what is broadcast is BITS / 8 bytes at
#: most. A corpus that outgrows them is pruned less, and never wrongly.
BITS = 1 << 27


__all__ = ["BITS", "SPACES", "WORD", "bitmap", "cut", "freed", "give_back", "held", "in_bitmap", "new_path", "shared_dir", "table", "word_count"]


def word_count(text: Column) -> Column:
    """Number of words as long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return memory that nothing uses to the system: Python workers outlive their tasks, and would keep it beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow, which gives its memory back when a task ends."""

    @wraps(run)
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return told


def bitmap(hashes: DataFrame) -> DataFrame:
    """A bitmap over the first column's hashes: (bucket, bits), at most BITS bits whatever the number of rows."""
    at = F.pmod(F.col(hashes.columns[0]), F.lit(BITS))
    return hashes.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))


def in_bitmap(rows: DataFrame, column: str, bitmap: DataFrame) -> DataFrame:
    """Adds `maybe`: false only where the hash is in no row of the bitmap."""
    rows = rows.withColumn("bucket", F.expr(f"bitmap_bucket_number(pmod({column}, {BITS}L))")).withColumn("bit", F.expr(f"bitmap_bit_position(pmod({column}, {BITS}L))"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    maybe = F.coalesce(F.expr("0") != byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")), F.lit(False))
    return rows.join(F.broadcast(bitmap), "bucket", "left").withColumn("maybe", maybe).drop("bucket", "bit", "bits")
