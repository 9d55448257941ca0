"""Exact quantiles of arbitrarily large groups, by selection in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from partcast.operators.ordering import join_by

#: Buckets of a round after the first.
PARTS = 1 << 20


def cells_of(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., _v, _c): how often each value occurs in each group; not-a-number counts as missing."""
    v = F.col(value).cast("double")
    return df.select(*by, F.when(~F.isnan(v), v).alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))


#: 32 buckets per power of two, in the order of the values.
_OCTAVES = ("CASE WHEN _v = 0 THEN 0 WHEN abs(_v) = double('infinity') THEN signum(_v) * 1e6D"
            " ELSE signum(_v) * (40000 + floor(log2(abs(_v)) * 32)) END")
_EVEN = f"if(_hi > _lo, least(floor((_v - _lo) / (_hi - _lo) * {PARTS}), {PARTS - 1}), 0)"


def _selected(cells: DataFrame, key: list[str], probs: list[float], only: str) -> DataFrame:
    """(key, _found): per wanted probability the values at the two ranks beside it (prob, low, high, part).

    Every round counts the cells of the bucket that
    still holds a rank by narrower buckets, and keeps the one whose cumulative
    counts enclose the rank: the first round in 32 buckets per power of two,
    the next two in a million even ones each.  What is left spans 2^-45 of its
    magnitude, 256 values at most, which are ordered in one row.  Nothing but
    the counts decides, so the rank is right whatever the distribution is.
    """
    def chosen(t: DataFrame, part: list[str]) -> DataFrame:
        """t (part..., _b, _n of the bucket, ...): running counts."""
        up_to = W.partitionBy(*part).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
        return t.withColumn("_end", F.sum("_k").over(up_to))

    bucket = [F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0)).alias("_k"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    first = chosen(cells.withColumn("_b", F.expr(_OCTAVES)).groupBy(*key, "_b").agg(*bucket), key)
    first = first.withColumn("_n", F.sum("_k").over(W.partitionBy(*key)))
    ranks = ", ".join(
        f"struct({p!r}D AS prob, {side} AS side, CAST({f}({p!r}D * greatest(_n - 1, 0)) AS BIGINT) AS rank, {p!r}D * greatest(_n - 1, 0) % 1 AS part)"
        for p in probs for side, f in enumerate(("floor", "ceil")))
    wanted = ["prob", "side", "rank", "part"]
    found = (first.selectExpr(*key, "_n", "_lo", "_hi", "_end - _k AS _before", "_end", f"inline(array({ranks}))")
             .where(only).where("_n = 0 OR (_before <= rank AND rank < _end)").drop("_end", "_n"))
    # a group without values goes on with its missing one; the condition has to keep the optimiser from pushing
    # "not null" below the counting, which would be done once per round then
    inside = F.expr("coalesce(_v >= _lo AND _v <= _hi, _v IS NULL AND _lo IS NULL)")
    for _ in range(2):
        now = join_by(cells, F.broadcast(found), key).where(inside).withColumn("_b", F.expr(_EVEN))
        counted = now.groupBy(*key, *wanted, "_before", "_b").agg(*bucket)
        found = (chosen(counted, [*key, "prob", "side"]).withColumn("_end", F.expr("_before + _end"))
                 .withColumn("_before", F.expr("_end - _k")).where("_lo IS NULL OR (_before <= rank AND rank < _end)").drop("_end", "_k", "_b"))
    left = join_by(cells, F.broadcast(found), key).where(inside)
    rows = left.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("prob", "side", "_v", "_c", "_before", "rank", "part"))).alias("_l"))

    def value(p: float, side: int) -> str:
        mine = f"filter(_l, x -> x.prob = {p!r}D AND x.side = {side})"
        return (f"aggregate({mine}, named_struct('k', 0L, 'v', CAST(NULL AS DOUBLE)), (a, x) -> named_struct("
                "'k', a.k + x._c, 'v', if(a.v IS NULL AND x._before + a.k + x._c > x.rank, x._v, a.v)), a -> a.v)")

    parts = ", ".join(f"struct({p!r}D AS prob, {value(p, 0)} AS low, {value(p, 1)} AS high,"
                      f" try_element_at(filter(_l, x -> x.prob = {p!r}D).part, 1) AS part)" for p in dict.fromkeys(probs))
    return rows.selectExpr(*key, f"filter(array({parts}), x -> x.part IS NOT NULL) AS _found")


_VALUE = "if(x.part = 0, x.low, x.low + (x.high - x.low) * x.part)"


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], only: str = "true") -> DataFrame:
    """Linear-interpolated quantiles: one row (by..., prob, value) per group and probability; null where a group has no value.

    df is read once, into counts per value; `_selected` works on those.  ``by``
    must be bounded by configuration (model, segment, band ...): one row per
    group and rank is broadcast on that ground.  ``only`` restricts the wanted
    probabilities per group, e.g. ``prob = level``.
    """
    key = list(by) or ["_all"]
    return quantiles_of(cells_of(df.withColumn("_all", F.lit(0)), key, value), by, probs, only)


def quantiles_of(cells: DataFrame, by: list[str], probs: list[float], only: str = "true") -> DataFrame:
    """:func:`exact_quantiles` from counts per value, in groups of ``by`` or finer ones."""
    key = list(by) or ["_all"]
    found = _selected(cells if by else cells.withColumn("_all", F.lit(0)), key, probs, only)
    return found.selectExpr(*by, f"inline(transform(_found, x -> struct(x.prob AS prob, {_VALUE} AS value)))")


def quantile_columns(df: DataFrame, by: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """:func:`exact_quantiles` with one named column per probability."""
    key = list(by) or ["_all"]
    return quantile_columns_of(cells_of(df.withColumn("_all", F.lit(0)), key, value), by, names)


def quantile_columns_of(cells: DataFrame, by: list[str], names: dict[str, float]) -> DataFrame:
    key = list(by) or ["_all"]
    found = _selected(cells if by else cells.withColumn("_all", F.lit(0)), key, list(names.values()), "true")
    pick = lambda p: f"try_element_at(transform(filter(_found, x -> x.prob = {p!r}D), x -> {_VALUE}), 1)"
    return found.selectExpr(*by, *[f"{pick(p)} AS {n}" for n, p in names.items()])
