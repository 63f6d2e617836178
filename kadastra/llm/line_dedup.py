"""Line dedup with a deletion-neighbourhood join.

A line is what stands between line feeds. Lines are compared as words ([\x20\x09-\x0D]+ apart, in lower case). A line is
dropped if an earlier one, in order of (doc_id, line number), is equal, or is within the edit bound: one word inserted,
deleted or replaced, both lines having at least MIN_WORDS words, so that at least four fifths agree. The earliest stays.

1. Two lines within the bound agree in their first or their last half. Lines that share such a half with another line go on; no others
   can have a partner, nor a difference inside a half that they share.
2. Each of those emits its deletion neighbourhood: a hashed key for the line without each of its words, and one for the
   line itself. The key is the xor of word-and-place hashes, so that all keys of a line come from running sums.
3. Equal keys meet. Lines with the same length, gap and key differ in one word at most; a line that is another's variant
   differs by one more word. Only the earliest of each such group is compared with the others, so the work is linear in
   the group; the pair's words are then compared, so that no hash decides.

Only DataFrame operations are used; every grouping is pre-aggregated or a join that Spark can split by skew.

Defined results: null text counts as empty, and is returned as an empty text. Lines without words are never dropped.
Rows that share an id but not a text are ordered by a hash of the text; rows that agree in both drop no line of one
another at the same place. A null id ranks last. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.llm.common import SPACES, bitmap, in_bitmap, new_path

MIN_WORDS = 5
#: A line's place: what orders lines, and names their row.
_PLACE = ["no_id", "id", "text_id", "line"]


def _held(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("text_id"), text.alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    """One row per line with words: place, words joined by one space, and two independent hashes that name the line.

    Case and spaces are evened out on whole texts, before these are split, so that it happens once.
    """
    text = F.lower("text")
    uneven = F.col("text").contains("  ")
    for mark in SPACES.replace("\n", "").replace(" ", ""):
        uneven = uneven | F.col("text").contains(mark)
    even = F.when(uneven, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)
    lines = rows.select("no_id", "id", "text_id", F.posexplode(F.split(even, "\n")).alias("line", "raw"))
    lines = lines.select("no_id", "id", "text_id", "line", F.trim("raw").alias("norm")).filter("norm != ''")
    n = (F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("int")
    return lines.select("*", n.alias("n"), F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit("second"), "norm").alias("h2"))


def _half_keys() -> Column:
    """Keys of the halves of a line of n words, as itself and as the longer of two, with the gaps that each leaves open."""
    n = F.col("n")
    def own(side: str, words: str) -> Column:
        part = F.expr(f"substring_index(norm, ' ', {'-' if side == 's' else ''}({words}))")
        opens = F.expr(words) if side == "p" else n - F.expr(words)
        return F.struct(F.xxhash64(F.lit(side), part).alias("half"), F.lit(side == "p").alias("front"), opens.cast("int").alias("open"))

    return F.array(own("p", "(n div 2)"), own("p", "((n - 1) div 2)"), own("s", "n - (n div 2)"), own("s", "n - 1 - ((n - 1) div 2)"))


def _earliest(*others: str) -> Column:
    return F.min(F.struct(*_PLACE, *others))


def _active(distinct: DataFrame) -> DataFrame:
    """(h1, front, back) of lines that share a half with another line: gaps from `front` on or below `back` may differ."""
    halves = distinct.filter(F.col("n") >= MIN_WORDS).select("h1", F.explode(F.array_distinct("halves")).alias("k")).select("h1", "k.*")
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("half")
    met = halves.join(shared, "half", "left_semi")
    return met.groupBy("h1").agg(F.min(F.when(F.col("front"), F.col("open"))).alias("front"), F.max(F.when(~F.col("front"), F.col("open"))).alias("back"))


def _neighbourhood(active: DataFrame) -> DataFrame:
    """(key, gap, h1): the line without its word number `gap` (0-based; -1: whole line) has this key."""
    lines = active.select("h1", "n", "front", "back", "norm").repartition("h1")
    word = lines.select("h1", "n", "front", "back", F.posexplode(F.split("norm", " ")).alias("at", "word"))
    word = word.select("h1", "n", "front", "back", "at", F.xxhash64("word", "at").alias("here"), F.xxhash64("word", F.col("at") - 1).alias("moved"))
    order = Window.partitionBy("h1").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = word.select(
        "h1", "n", "front", "back", "at", "here", F.expr("bit_xor(here)").over(upto).alias("head"), F.expr("bit_xor(moved)").over(upto).alias("skipped"), F.expr("bit_xor(moved)").over(everything).alias("all_moved")
    )
    without = F.col("head").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("all_moved")).bitwiseXOR(F.col("skipped"))
    gap = F.when((F.col("at") >= F.col("front")) | (F.col("at") < F.col("back")), F.struct(F.xxhash64(without, F.col("n") - 1).alias("key"), F.col("at").alias("gap")))
    whole = F.when(F.col("at") == F.col("n") - 1, F.struct(F.xxhash64("head", "n").alias("key"), F.lit(-1).alias("gap")))
    return sums.select("h1", F.explode(F.array_compact(F.array(gap, whole))).alias("v")).select("v.key", "v.gap", "h1")


def _near(active: DataFrame) -> DataFrame:
    """(h1) of lines that have an earlier line within the edit bound."""
    variants = _neighbourhood(active)
    met = variants.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key")
    shared = variants.join(met, "key", "left_semi")
    placed = _held(shared.join(active.select("h1", *_PLACE), "h1"), "line-variants")
    # the earliest of: lines with the same gap; the whole line; all lines that have it as a variant
    groups = placed.groupBy("key", "gap").agg(_earliest("h1", "gap").alias("low"))
    by_key = groups.groupBy("key").agg(F.min(F.when(F.col("gap") == -1, F.col("low"))).alias("whole"), F.min(F.when(F.col("gap") >= 0, F.col("low"))).alias("longer"))
    lows = groups.join(by_key, "key").select(
        "key", "gap", F.explode(F.array(F.when(F.col("gap") == -1, F.col("longer")).otherwise(F.col("low")), F.when(F.col("gap") >= 0, F.col("whole")))).alias("low")
    )
    pairs = (
        placed.join(lows.filter("low is not null"), ["key", "gap"])
        .filter(F.struct(*[F.col(f"low.{c}") for c in _PLACE]) < F.struct(*_PLACE))
        .select("h1", "gap", F.col("low.h1").alias("other"), F.col("low.gap").alias("other_gap"))
        .distinct()
    )
    text = active.select("h1", F.split("norm", " ").alias("words"))
    others = active.select(F.col("h1").alias("other"), F.split("norm", " ").alias("other_words"))
    without = lambda words, gap: F.when(gap < 0, words).otherwise(F.concat(F.slice(words, F.lit(1), gap), F.slice(words, gap + 2, F.size(words))))
    proven = pairs.join(text, "h1").join(others, "other").filter(without(F.col("words"), F.col("gap")) == without(F.col("other_words"), F.col("other_gap")))
    return proven.select("h1").distinct()


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with all its columns, its texts without the dropped lines; length_col gets their new length."""
    done = dedup_lines(docs, id_col, text_col, carry=True)
    new = {text_col: F.col("text")} | ({length_col: F.char_length("text").cast(docs.schema[length_col].dataType)} if length_col else {})
    return done.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, text (without the dropped lines), n_lines, n_dropped; `_row`, the other columns, on request."""
    rows = _rows(docs, id_col, text_col)
    others = [c for c in docs.columns if c != text_col]
    lines = _lines(rows)
    distinct = _held(
        lines.withColumn("halves", F.when(F.col("n") >= MIN_WORDS, _half_keys())).groupBy("h1", "h2").agg(_earliest("n", "halves").alias("low"), F.count(F.lit(1)).alias("times")).select("h1", "h2", "times", "low.*"),
        "lines-distinct",
    )
    active = _held(_active(distinct), "lines-active")
    texts = in_bitmap(lines.filter(F.col("n") >= MIN_WORDS), "h1", bitmap(active.select("h1"))).filter("maybe")
    active = texts.join(active, "h1").groupBy("h1").agg(_earliest("norm", "n", "front", "back").alias("low")).select("h1", "low.*")
    near = _near(_held(active, "line-texts")).withColumn("near", F.lit(True))
    first = distinct.join(near, "h1", "left").filter("times > 1 or near").select("h1", "h2", F.struct(*_PLACE).alias("low"), F.coalesce("near", F.lit(False)).alias("near"))
    dropped = lines.select(*_PLACE, "h1", "h2").join(first, ["h1", "h2"]).filter((F.struct(*_PLACE) != F.col("low")) | F.col("near"))
    gone = _held(dropped.groupBy("no_id", "id", "text_id").agg(F.collect_set("line").alias("gone")), "lines-dropped")
    if carry:
        text = F.coalesce(F.col(f"_all.`{text_col}`"), F.lit(""))
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
        own = F.col(f"_all.`{id_col}`")
        rows = packed.select(own.isNull().alias("no_id"), F.coalesce(own.cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("text_id"), text.alias("text"), F.struct(*[F.col(f"_all.`{c}`") for c in others]).alias("_row"))
    rows = in_bitmap(rows, "text_id", bitmap(gone.select("text_id")))
    # texts that surely lose no line need no shuffle
    rows = rows.filter("maybe").join(gone, ["no_id", "id", "text_id"], "left").unionByName(rows.filter("not maybe").withColumn("gone", F.lit(None).cast("array<int>")))
    lines = F.split("text", "\n")
    # the outer lambda binds both lists, so that each is made once for a text; array_except is linear
    both = F.array(F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone").alias("stay")))
    stayed = F.transform(both, lambda b: F.array_join(F.transform(b["stay"], lambda i: F.get(b["lines"], i)), "\n"))[0]
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(stayed)
    more = ["_row"] if carry else []
    return rows.select(*more, F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), left.alias("text"), (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, line, raw, CAST(array_to_string(regexp_extract_all(lower(raw), '[^\x20\x09-\x0D]+'), ' ') AS VARCHAR) AS norm
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents)),
o AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, line) AS g FROM l),
f AS (
  SELECT norm, min(g) AS g, string_split(norm, ' ') AS ws FROM o WHERE norm <> '' GROUP BY norm),
v AS (
  SELECT norm, g, len(ws) AS n, i AS gap, array_to_string(list_concat(ws[1:i], ws[i + 2:len(ws)]), ' ') AS key
  FROM (SELECT *, unnest(range(0, len(ws))) AS i FROM f WHERE len(ws) >= 5)),
near AS (
  SELECT norm FROM (SELECT norm, g, min(g) OVER (PARTITION BY key, n, gap) AS low FROM v) WHERE low < g
  UNION SELECT v.norm FROM v JOIN f ON v.key = f.norm WHERE len(f.ws) >= 5 AND f.g < v.g
  UNION SELECT f.norm FROM v JOIN f ON v.key = f.norm WHERE len(f.ws) >= 5 AND v.g < f.g),
k AS (
  SELECT o.doc_id, o.line, o.raw, o.norm <> '' AND (o.g <> f.g OR near.norm IS NOT NULL) AS gone
  FROM o LEFT JOIN f ON o.norm = f.norm LEFT JOIN near ON o.norm = near.norm)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
