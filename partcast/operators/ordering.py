"""Order-dependent operators that never put one hot group into one task.

The idea is the same throughout: split an ordered group into buckets by a
deterministic, order-preserving key, take prefix sums over the small bucket
table, and order rows only inside a bucket.  Where rows tie, the tie order is
a hash of the key, so a tie group splits evenly however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def join_by(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Inner join on columns, null matching null.

    Besides keeping null groups, a null-safe condition lets the optimiser infer
    no IS NOT NULL filter, which it would push below the projections that
    compute the columns and so repeat them.
    """
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    on = [left[c].eqNullSafe(other[f"_r_{c}"]) for c in cols]
    return left.join(other, on).drop(*[f"_r_{c}" for c in cols])


def key_hash(*cols: str, seed: int | None = None) -> Column:
    """Hex digest used as a reproducible random order, independent of layout."""
    parts = [F.col(c).cast("string") for c in cols]
    if seed is not None:
        parts.insert(0, F.lit(str(seed)))
    return F.md5(F.concat_ws("|", *parts))


def with_buckets(rows: DataFrame, cell: list[str], h: str = "_h") -> DataFrame:
    """Add _b, an order-preserving bucket of the hex digest h: the square root of a cell's rows has it as many buckets.

    A cell of n rows so becomes about sqrt(n) buckets of sqrt(n) rows, and neither the ordering inside a bucket
    nor the prefix sums over the buckets meets more than that, whatever share of all rows the cell holds.
    """
    sizes = rows.groupBy(*cell).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_parts"))
    place = F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / float(16 ** 13)
    return join_by(rows, sizes, cell).withColumn("_b", F.floor(place * F.col("_parts"))).drop("_parts")


def running_share(df: DataFrame, group: str, count: str, key: str) -> DataFrame:
    """Add group_total, running and share, ordered by count descending.

    ``count`` is an integer activity count.  Cells are (group, count); a group
    with n movements has at most sqrt(2n) different counts.  Inside a cell rows
    are ordered by the hash of their key, bucket by bucket.
    """
    rows = with_buckets(df.withColumn("_h", key_hash(key)), [group, count])
    cells = rows.groupBy(group, count, "_b").agg(F.sum(count).alias("_cell"))
    ahead = W.partitionBy(group).orderBy(F.col(count).desc(), "_b").rowsBetween(
        W.unboundedPreceding, -1)
    cells = cells.select(
        group, count, "_b",
        F.coalesce(F.sum("_cell").over(ahead), F.lit(0)).alias("_before"),
        F.sum("_cell").over(W.partitionBy(group)).alias("group_total"),
    )
    inside = W.partitionBy(group, count, "_b").orderBy("_h", key)
    rows = rows.withColumn("_rn", F.row_number().over(inside))
    out = join_by(rows, cells, [group, count, "_b"])
    out = out.withColumn("running", F.col("_before") + F.col("_rn") * F.col(count))
    return out.withColumn("share", F.col("running") / F.col("group_total")).drop(
        "_h", "_b", "_rn", "_before")


def stratum_caps(df: DataFrame, strata: list[str], key: list[str], target: int, seed: int = 42) -> DataFrame:
    """(strata..., pop_n, sample_n, _last): rows of a stratum, how many of them are sampled, and the hash part the last one is in.

    df is read once, into counts per stratum and leading three hex digits of the key's hash.
    """
    parts = df.select(*strata, F.substring(key_hash(*key, seed=seed), 1, 3).alias("_b")).groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    sizes = parts.groupBy(*strata).agg(F.sum("_n").alias("pop_n"), F.array_sort(F.collect_list(F.struct("_b", "_n"))).alias("_l"))
    # a row per stratum from here on
    sizes = sizes.withColumn("_cells", F.count(F.lit(1)).over(W.partitionBy())).withColumn(
        "sample_n", F.expr(f"least(pop_n, greatest(1, ceil({float(target)}D / _cells)))"))
    last = "aggregate(_l, named_struct('n', 0L, 'b', ''), (a, x) -> if(a.n >= sample_n, a, named_struct('n', a.n + x._n, 'b', x._b)), a -> a.b)"
    return sizes.select(*strata, "pop_n", "sample_n", F.expr(last).alias("_last"))


def stratified_sample(df: DataFrame, strata: list[str], key: list[str], target: int, seed: int = 42, sizes: bool = False) -> DataFrame:
    """Equal allocation: max(1, ceil(target / strata)) rows per stratum; with ``sizes`` pop_n and sample_n of its stratum in each.

    Rows are taken in hash order.  Counts decide up to which hash part a stratum is needed; only those rows reach the
    per-stratum ordering, which therefore sees about cap + stratum / 4096 rows.  df is read twice.  ``strata`` must be
    bounded by configuration (segment, class ...): one row per stratum is broadcast on that ground.
    """
    near = join_by(df.withColumn("_h", key_hash(*key, seed=seed)), F.broadcast(stratum_caps(df, strata, key, target, seed)), strata).where(
        F.substring("_h", 1, 3) <= F.col("_last"))
    order = W.partitionBy(*strata).orderBy("_h", *key)
    taken = near.withColumn("_rn", F.row_number().over(order)).where("_rn <= sample_n").drop("_h", "_rn", "_last")
    return taken if sizes else taken.drop("pop_n", "sample_n")


def random_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows in hash order (each task keeps its own n, then one merge)."""
    return df.withColumn("_h", key_hash(*key, seed=seed)).orderBy("_h", *key).limit(n).drop("_h")


def with_prefix(values: DataFrame, rounds: int = 3, step: int = 2) -> DataFrame:
    """Add _p, a leading part of value: values with the same part follow each other, and few share one.

    Each round looks at the parts that more than the square root of all values
    share, and lengthens them past what their smallest and largest value have
    in common; so long common beginnings (paths, codes) cost no round.
    """
    total = values.agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("n")).scalar()
    now = values.withColumn("_p", F.lit(""))
    for _ in range(rounds):
        parts = now.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        common = "size(filter(sequence(1, greatest(least(length(_lo), length(_hi)), 1)), i -> left(_lo, i) = left(_hi, i)))"
        cut = parts.select("_p", F.when(F.col("_n") > total, F.expr(f"{common} + {step}")).otherwise(F.length("_p")).alias("_cut"))
        now = now.join(cut, "_p").withColumn("_p", F.expr("left(value, _cut)")).drop("_cut")
    return now


def label_codes(df: DataFrame, col: str, missing: str = "__NA__") -> DataFrame:
    """Distinct value -> 0..K-1 in sorted order, missing values included.

    Codes are local positions among the values that share a leading part (see
    `with_prefix`) plus the part's offset.
    """
    values = with_prefix(df.select(F.coalesce(F.col(col).cast("string"), F.lit(missing)).alias("value")).distinct())
    sizes = values.groupBy("_p").agg(F.count("*").alias("_n"))
    ahead = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_p").orderBy("value")
    return (
        values.withColumn("_rn", F.row_number().over(inside)).join(starts, "_p")
        .select("value", (F.col("_start") + F.col("_rn") - 1).alias("code"))
    )


def dedupe(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in a total order."""
    names = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min(F.struct(*order, *names)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in names])


def mode_of(df: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Most frequent non-null value per key and column, smallest on ties.

    Counts (key, column, value) first, so a hot key arrives as a handful of
    distinct values per task.
    """
    long = df.select(*key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v")) for c in cols
    ]))).where("_v IS NOT NULL")
    counted = long.groupBy(*key, "_c", "_v").agg(F.count("*").alias("_n"))
    best = counted.groupBy(*key, "_c").agg(
        F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_v").alias("v"))).alias("_m"))
    return best.groupBy(*key).agg(*[
        F.max(F.when(F.col("_c") == c, F.col("_m.v"))).alias(c) for c in cols])
