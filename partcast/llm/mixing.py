"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Sources in code-point order (null last) weigh 3, 1, 2 and so on, and share a
budget of words; no source gets more than `cap` times its words, what is over
goes to the others by weight.  Within a source the rates r of its documents
maximise the entropy relative to one copy each, between 0 and `cap`, such that
the words taken meet the target.  The dual is convex with one multiplier a
source: r = cap / (1 + exp(-lambda * size / mean)), an exponential tilt by size.
Newton steps (kept inside a bracket) solve it for all sources at once, each a
distributed sum over the counts of (source, size).

Rates become whole copies by systematic rounding along the sizes, which leaves a
source at most about its largest document from its target; then copies of ever
smaller sizes close the gap.  Sums are exact decimals and rates are rounded to a
millionth, so reruns agree whatever the partitioning.

Scale: documents are counted by (source, size) before anything is solved; one
row per source goes through a single window.  Ranks within a cell are taken in
4,096 hash buckets, so no source or size meets in one task.

Defined results: null or blank texts have size 0 and are never taken; a null
source is a source of its own; repeated rows are separate documents; no rows
give no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partcast.llm.scratch import Scratch

WEIGHTS, BUDGET, CAP = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1_000_000


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) -> with i, weight, target; i numbers the sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("i", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") - 1) % len(weights) + 1))
    # sources fill up in the order of cap * size / weight; the first that doesn't fill fixes the level of the rest
    fill = F.col("source_size") * cap / F.col("weight")
    upto, below = Window.orderBy("fill").rangeBetween(Window.currentRow, Window.unboundedFollowing), Window.orderBy("fill")
    whole = Window.partitionBy(F.lit(0))
    levels = (ranked.withColumn("fill", fill)
              .withColumn("total", F.sum("source_size").over(whole) * budget)
              .withColumn("rest", F.sum("weight").over(upto))
              .withColumn("full", F.sum(F.col("source_size") * cap).over(
                  below.rangeBetween(Window.unboundedPreceding, Window.currentRow))
                  - F.sum(F.col("source_size") * cap).over(below.rangeBetween(Window.currentRow, Window.currentRow)))
              .withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
              .withColumn("settled", F.min(F.when(F.col("level") < F.col("fill"), F.col("fill"))).over(whole))
              .withColumn("level", F.max(F.when(F.col("fill") == F.col("settled"), F.col("level"))).over(whole)))
    filled = F.col("settled").isNull() | (F.col("fill") < F.col("settled"))
    return levels.select("source", "i", "source_size", "weight",
                         F.when(filled, F.col("source_size") * cap).otherwise(F.col("level") * F.col("weight"))
                         .cast("double").alias("target"))


def _exact(c) -> F.Column:
    return F.sum(c.cast("decimal(30,6)")).cast("double")


def multipliers(cells: DataFrame, sources: DataFrame, scratch: Scratch, cap: int = CAP, rounds: int = 60) -> DataFrame:
    """cells (i, size, count), sources (i, source_size, documents, target) -> (i, mean, lam) of sources between 0 and cap."""
    state = scratch.keep(
        sources.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap))
        .select("i", "target", (F.col("source_size") / F.col("documents")).alias("mean"))
        .selectExpr("i", "target", "mean", "0.0D as lam", "-64 * mean as lo", "64 * mean as hi", "1.0D as off"))
    for _ in range(rounds):
        z = F.col("size") / F.col("mean")
        rate = F.lit(float(cap)) / (1 + F.exp(-F.col("lam") * z))
        words = F.col("count") * F.col("size")
        sums = (cells.join(state.select("i", "mean", "lam"), "i").groupBy("i")
                .agg(_exact(words * rate).alias("taken"), _exact(words * z * rate * (1 - rate / cap)).alias("slope")))
        off = F.col("taken") - F.col("target")
        after = (state.drop("off").join(sums, "i")
                 .withColumn("lo", F.when(off < 0, F.col("lam")).otherwise(F.col("lo")))
                 .withColumn("hi", F.when(off > 0, F.col("lam")).otherwise(F.col("hi")))
                 .withColumn("newton", F.when(F.col("slope") > 0, F.col("lam") - off / F.col("slope")))
                 .withColumn("off", F.abs(off) / F.col("target"))
                 .withColumn("lam", F.when(F.col("off") <= 1e-12, F.col("lam"))
                             .when((F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")), F.col("newton"))
                             .otherwise((F.col("lo") + F.col("hi")) / 2))
                 .select("i", "target", "mean", "lam", "lo", "hi", "off"))
        after = scratch.keep(after)
        scratch.drop(state)
        state = after
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < 1e-10:
            break
    return state.select("i", "mean", "lam")


def settle(cells: DataFrame, scratch: Scratch, cap: int = CAP, rounds: int = 16) -> DataFrame:
    """cells (i, size, count, target, m copies): changes m until each source's words meet its target.

    Each round, a source that lacks (or has too many) words adds (or drops)
    copies of the largest size that still fits, as many as fit and exist.
    """
    cells = scratch.keep(cells)
    source = Window.partitionBy("i")
    for _ in range(rounds):
        lack = (F.round("target") - F.sum(F.col("m") * F.col("size")).over(source)).cast("long")
        free = F.when(F.col("lack") > 0, F.col("count") * cap - F.col("m")).otherwise(F.col("m"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("lack")) & (free > 0)
        after = (cells.withColumn("lack", lack)
                 .withColumn("chosen", F.max(F.when(fits, F.col("size"))).over(source))
                 .withColumn("change", F.when(F.col("size") == F.col("chosen"), F.least(free, F.expr("abs(lack) div size"))
                                              * F.signum("lack").cast("long")).otherwise(F.lit(0)))
                 .select("i", "size", "count", "target", (F.col("m") + F.col("change")).alias("m"), "change"))
        after = scratch.keep(after)
        scratch.drop(cells)
        cells = after
        if cells.where("change <> 0").isEmpty():
            break
    return cells


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken), a row per row of docs."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    counts = scratch.keep(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("count")))
    sources = counts.groupBy("source").agg(
        F.sum(F.col("size") * F.col("count")).alias("source_size"), F.sum("count").alias("documents"))
    known = scratch.keep(targets(sources.select("source", "source_size"), weights, budget, cap)
                         .join(sources.select(F.col("source").alias("s"), "documents"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    cells = scratch.keep(counts.withColumnRenamed("source", "s").join(
        known.select("source", "i"), F.col("s").eqNullSafe(F.col("source"))).select("i", "size", "count"))
    lam = multipliers(cells, known, scratch, cap)
    rate = (F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("target") >= F.col("source_size") * cap, F.lit(float(cap)))
            .otherwise(F.lit(float(cap)) / (1 + F.exp(-F.col("lam") * F.col("size") / F.col("mean")))))
    unit = F.round(rate * UNIT).cast("long")
    upto = F.sum(F.col("count") * F.col("unit")).over(Window.partitionBy("i").orderBy("size"))
    first = (cells.join(known.select("i", "source_size", "target"), "i").join(lam, "i", "left")
             .withColumn("unit", unit).withColumn("upto", upto)
             .selectExpr("i", "size", "count", "target",
                         f"(upto + {UNIT // 2}) div {UNIT} - (upto - count * unit + {UNIT // 2}) div {UNIT} as m"))
    plan = settle(first, scratch, cap).selectExpr("i", "size", "m div count as base", "m % count as more")
    # rank of each document in its cell, by a hash of its id, counted bucket by bucket
    keyed = (rows.withColumnRenamed("source", "s")
             .join(known.select("source", "i", "source_size", "target"), F.col("s").eqNullSafe(F.col("source")))
             .withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
             .withColumn("bucket", F.substring("key", 1, 3)).drop("s", "source"))
    ahead = Window.partitionBy("i", "size").orderBy("bucket")
    buckets = (keyed.groupBy("i", "size", "bucket").agg(F.count(F.lit(1)).alias("m"))
               .withColumn("ahead", F.sum("m").over(ahead) - F.col("m")).drop("m"))
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("i", "size", "bucket").orderBy("key", "doc_id"))
    return (keyed.join(buckets.join(plan, ["i", "size"]), ["i", "size", "bucket"])
            .withColumn("copies", F.col("base") + F.when(rank <= F.col("more"), 1).otherwise(0))
            .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))
