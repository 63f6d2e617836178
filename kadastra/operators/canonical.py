"""Which record stands for a building: merges in a given order that reviewed separations may forbid.

A walk over proposals takes each unless it would bring two separated records into one component, or take a pinned record's place. The
same comes out of rounds: a proposal is decided as soon as no open earlier one can change what it finds. None may be open at the component
that moves. At the component that stays only such may be open as bring others to it, themselves free to move, that no review separates from
this one: whether they are taken or not is then nothing to it. So all that come to one record are decided together, not one in a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kadastra.operators import ranking
from kadastra.shared import cut


def settle(labels: DataFrame, proposals: DataFrame, separate: DataFrame, reviewed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(labels, taken): labels (node, root, pinned) after the proposals (source, target, reason, ord), which are unique in ord; taken has
    those that joined two components. separate: pairs (a, b) that no component may hold. The target's root is the new root."""
    open_, taken = cut(proposals), None
    apart = cut(separate.select("a", "b").union(separate.select("b", "a")).distinct())
    while True:
        at = lambda side: labels.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        placed = cut(open_.join(at("source"), "source").join(at("target"), "target").filter("source_root <> target_root"))
        ends = placed.select("ord", F.explode(F.array("source_root", "target_root")).alias("root"))
        least = ends.groupBy("root").agg(F.min("ord").alias("least"))
        free = placed.join(least.withColumnRenamed("root", "source_root"), "source_root").withColumn("_free", F.col("ord") == F.col("least")).drop("least")
        # what else than a free source that comes to it is open at a component: later proposals wait for it
        holds = F.array(F.struct(F.col("source_root").alias("root"), F.lit(True).alias("held")), F.struct(F.col("target_root").alias("root"), (~F.col("_free")).alias("held")))
        limit = free.select("ord", F.explode(holds).alias("h")).filter("h.held").groupBy(F.col("h.root").alias("target_root")).agg(F.min("ord").alias("limit"))
        coming = cut(free.filter("_free").join(limit, "target_root", "left").filter(F.col("limit").isNull() | (F.col("ord") < F.col("limit"))).drop("limit", "_free"))
        roots = apart.join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("source_root"), F.col("b_root").alias("other")).filter("source_root <> other").distinct()
        rivals = coming.select(F.col("source_root").alias("other"), "target_root", F.col("ord").alias("before"))
        late = coming.select("ord", "source_root", "target_root").join(roots, "source_root").join(rivals, ["other", "target_root"]).filter("before < ord").select("ord").distinct()
        ready = cut(coming.join(late, "ord", "left_anti"))
        if ready.isEmpty():
            return labels, (taken if taken is not None else ready.limit(0))
        fine = ready.join(roots.withColumnRenamed("other", "target_root"), ["source_root", "target_root"], "left_anti")
        if not reviewed:
            fine = fine.join(labels.filter("pinned").select(F.col("node").alias("source_root")), "source_root", "left_anti")
        taken = fine if taken is None else taken.unionByName(fine)
        moved = fine.select(F.col("source_root").alias("root"), F.col("target_root").alias("to"))
        labels = cut(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"), "pinned"))
        open_ = cut(open_.join(ready.select("ord"), "ord", "left_anti"))


def _ordered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ord, their place in their phase; the order leaves no ties."""
    return ranking.ranked(rows, list(order), "ord").drop("ord_all")


def _prefix(complexes: DataFrame, names: DataFrame, service: str) -> DataFrame:
    """(id, target): junk names whose longest beginning is the name of one record alone, with nothing or service text behind it. names:
    (name, target). A junk name meets the names through its own beginnings that end before a mark."""
    junk = complexes.filter("junk and parent_id is null").select("id", F.col("name").alias("long"))
    cuts = F.filter(F.sequence(F.lit(4), F.greatest(F.length("long"), F.lit(4))), lambda n: (n == F.length("long")) | F.substring(F.col("long"), n + 1, F.lit(1)).isin(*" ,:;—–-"))
    heads = junk.withColumn("n", F.explode(cuts)).withColumn("head", F.expr("substring(long, 1, n)"))
    tail = F.ltrim(F.expr("substring(long, n + 1)"), F.lit(" ,:;—–-"))
    fits = heads.filter((F.col("n") == F.length("long")) | tail.rlike(f"^(?:{service})"))
    met = fits.join(names.filter(F.length("name") >= 4), F.col("head") == F.col("name")).groupBy("id", "n").agg(F.min("target").alias("target"), F.max("target").alias("high"))
    best = met.groupBy("id").agg(F.max_by(F.struct("target", "high"), "n").alias("b"))
    return best.filter("b.target = b.high and b.target <> id").select("id", F.col("b.target").alias("target"))


def assign(complexes: DataFrame, relations: DataFrame, manual: DataFrame, service: str) -> DataFrame:
    """(id, canonical_id, reason) of every record; records that stand for themselves have nulls, junk that fits nowhere junk_unmatched.

    complexes: id, parent_id, name (normalised), core (the name without brand, developer and city), junk, bare_junk (service text alone), slug,
    is_umbrella, housing_class, is_newbuild, listings. relations: pairs (a, b) that a review separates. manual: (id, target), a null target
    pins the record. service: pattern of what may follow a name.

    In order: manual decisions, whose targets are pinned, and which must all hold; junk names by their beginning; equal slugs, within a core's
    family to its best record (pinned, no junk, umbrella, class, new, listings, least id), and bare junk to the only family; junk
    names again, as more names are now one record's. Children of a parent are left to themselves.
    """
    complexes = cut(complexes)
    pins = manual.select(F.coalesce("target", "id").alias("node")).distinct().withColumn("p", F.lit(True))
    labels = cut(complexes.select(F.col("id").alias("node"), F.col("id").alias("root")).join(pins, "node", "left").select("node", "root", F.coalesce("p", F.lit(False)).alias("pinned")))
    decided = manual.filter("target is not null").select(F.col("id").alias("source"), "target", F.lit("manual_review").alias("reason"))
    # a target that is itself redirected is no root: it is pinned no longer
    labels = cut(labels.join(decided.select(F.col("source").alias("node")), "node", "left_anti").unionByName(labels.join(decided.select(F.col("source").alias("node")), "node", "left_semi").withColumn("pinned", F.lit(False))))
    labels, first = settle(labels, _ordered(decided, "source"), relations, reviewed=True)
    if decided.join(labels, F.col("source") == F.col("node")).join(labels.select(F.col("node").alias("target"), F.col("root").alias("t_root")), "target").filter("root <> t_root").limit(1).count():
        raise ValueError("a manual decision joins records that a review separates")

    real = complexes.filter("not junk and name <> ''")
    by_name = lambda: _prefix(complexes, real.join(labels, F.col("id") == F.col("node")).select("name", F.col("root").alias("target")).distinct(), service)
    start = _prefix(complexes, real.select("name", F.col("id").alias("target")), service)
    labels, by_start = settle(labels, _ordered(start.select(F.col("id").alias("source"), "target", F.lit("name_prefix").alias("reason")), "source"), relations)

    told = first.unionByName(by_start).select(F.col("source").alias("id")).distinct()
    heads = complexes.filter("slug is not null and parent_id is null").join(told, "id", "left_anti").join(labels.select(F.col("node").alias("id"), "root"), "id").join(labels.filter("pinned").select(F.col("node").alias("root"), F.lit(True).alias("kept")), "root", "left")
    heads = heads.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("slug"))).filter("_n > 1")
    worth = [F.col("kept").isNull(), F.col("junk"), ~F.coalesce("is_umbrella", F.lit(False)), F.col("housing_class").isNull(), ~F.coalesce("is_newbuild", F.lit(False)), -F.col("listings"), F.col("id")]
    rank = F.struct(*[w.alias(f"w{i}") for i, w in enumerate(worth)])
    ranked = heads.withColumn("_rank", rank).withColumn("_group", F.min("id").over(Window.partitionBy("slug")))
    families = cut(ranked.filter("not junk and length(core) >= 3"))
    family = Window.partitionBy("slug", "core")
    lead = families.withColumn("target", F.first("id").over(family.orderBy("_rank"))).withColumn("_family", F.min("id").over(family))
    inside = lead.filter("id <> target").select(F.col("id").alias("source"), "target", F.lit("krisha_slug").alias("reason"), "_group", "_family", "_rank")
    labels, by_slug = settle(labels, _ordered(inside, "_group", "_family", "_rank").select("source", "target", "reason", "ord"), relations)
    rooted = lead.join(labels.select(F.col("node").alias("id"), F.col("root").alias("now")), "id")
    single = rooted.groupBy("slug").agg(F.count_distinct("core").alias("cores"), F.count_distinct("now").alias("roots"), F.min("target").alias("target")).filter("cores = 1 and roots = 1").select("slug", "target")
    bare = ranked.filter("junk and bare_junk").join(single, "slug").filter("id <> target").select(F.col("id").alias("source"), "target", F.lit("krisha_slug").alias("reason"))
    labels, by_bare = settle(labels, _ordered(bare, "source"), relations)

    told = told.union(by_slug.unionByName(by_bare).select("source")).distinct()
    again = by_name().join(told, "id", "left_anti")
    labels, by_end = settle(labels, _ordered(again.select(F.col("id").alias("source"), "target", F.lit("name_prefix").alias("reason")), "source"), relations)
    reasons = first.unionByName(by_start).unionByName(by_slug).unionByName(by_bare).unionByName(by_end).select(F.col("source").alias("id"), "reason")
    out = complexes.select("id", "junk").join(reasons, "id", "left").join(labels.select(F.col("node").alias("id"), "root", "pinned"), "id")
    lost = F.col("junk") & F.col("reason").isNull() & ~F.col("pinned")
    return out.select("id", F.when(F.col("reason").isNotNull(), F.col("root")).alias("canonical_id"), F.coalesce("reason", F.when(lost, "junk_unmatched")).alias("reason"))
