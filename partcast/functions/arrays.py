"""Rank statistics across the models of one row.

A row carries one value per model, so these never grow with the data; they
are evaluated in place, without a shuffle.  Array forms serve small tables of
any width; the text forms below unroll a known list of value columns into
plain arithmetic for per-series use.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _size(a: Column) -> Column:
    return F.size(a).cast("double")


def mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), _size(a))


def average_ranks(a: Column) -> Column:
    """Fractional ranks, ties sharing the mean of their positions."""
    return F.transform(a, lambda x: (
        _size(F.filter(a, lambda z: z < x))
        + (_size(F.filter(a, lambda z: z == x)) + 1.0) / 2.0
    ))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two equally long arrays; null when a side is constant."""
    n = _size(x)
    sums = F.aggregate(
        F.arrays_zip(x.alias("x"), y.alias("y")),
        F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "xx", "yy", "xy")]),
        lambda s, e: F.struct(
            (s["x"] + e["x"]).alias("x"), (s["y"] + e["y"]).alias("y"),
            (s["xx"] + e["x"] * e["x"]).alias("xx"),
            (s["yy"] + e["y"] * e["y"]).alias("yy"),
            (s["xy"] + e["x"] * e["y"]).alias("xy"),
        ),
        lambda s: F.try_divide(
            n * s["xy"] - s["x"] * s["y"],
            F.sqrt((n * s["xx"] - s["x"] * s["x"]) * (n * s["yy"] - s["y"] * s["y"])),
        ),
    )
    return sums


def spearman(x: Column, y: Column) -> Column:
    """Rank correlation of two arrays; ranks are half-integers, so sums are exact."""
    return pearson(average_ranks(x), average_ranks(y))


def _pair_signs(a: Column) -> Column:
    """signum(a_i - a_j) for every i < j."""
    idx = F.sequence(F.lit(1), F.size(a) - 1)
    return F.flatten(F.transform(idx, lambda i: F.transform(
        F.slice(a, i + 1, F.size(a)),
        lambda v: F.signum(F.element_at(a, i) - v),
    )))


def kendall_tau_b(x: Column, y: Column) -> Column:
    """Tau-b; null below three values or when a side is constant."""
    signs = F.arrays_zip(_pair_signs(x).alias("x"), _pair_signs(y).alias("y"))
    tau = F.aggregate(
        signs,
        F.struct(*[F.lit(0.0).alias(c) for c in ("s", "nx", "ny")]),
        lambda acc, e: F.struct(
            (acc["s"] + e["x"] * e["y"]).alias("s"),
            (acc["nx"] + F.abs(e["x"])).alias("nx"),
            (acc["ny"] + F.abs(e["y"])).alias("ny"),
        ),
        lambda acc: F.try_divide(acc["s"], F.sqrt(acc["nx"] * acc["ny"])),
    )
    return F.when(F.size(x) >= 3, tau)


def argmin(values: Column, names: Column) -> Column:
    """Name of the smallest value, first on ties."""
    pos = F.array_position(values, F.array_min(values))
    return F.element_at(names, pos.cast("int"))


def median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(a)
    lo = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    hi = F.element_at(s, F.floor(n / 2).cast("int") + 1)
    return (lo + hi) / 2.0


def _plus(parts: list[str]) -> str:
    """Sum of many terms as an array fold: keeps the fused method of the stage
    before it small enough to be compiled."""
    return f"aggregate(array({', '.join(parts)}), 0.0D, (s, v) -> s + v)"


def rank_columns(prefix: str, values: list[str]) -> dict[str, str]:
    """Fractional ranks prefix0.. of the value columns that are not null, ties sharing positions."""
    return {
        f"{prefix}{i}": f"if({x} IS NULL, NULL, 0.5D + "
                        + " + ".join(f"if({z} < {x}, 1.0D, if({z} = {x}, 0.5D, 0.0D))" for z in values) + ")"
        for i, x in enumerate(values)
    }


LEAST_MODELS = 3


def present(values: list[str]) -> str:
    """How many of the columns are not null."""
    return "(" + " + ".join(f"int({v} IS NOT NULL)" for v in values) + ")"


def spearman_text(rx: list[str], ry: list[str]) -> str:
    """Rank correlation from rank columns, over the places where neither is null.

    Both sides have to be null in the same places.  Null when a side is
    constant or fewer than three places are left.
    """
    mean = f"(({present(rx)} + 1) / 2.0D)"
    dot = lambda a, b: _plus([f"coalesce(({u} - {mean}) * ({v} - {mean}), 0.0D)" for u, v in zip(a, b)])
    return f"if({present(rx)} < {LEAST_MODELS}, NULL, try_divide({dot(rx, ry)}, sqrt({dot(rx, rx)} * {dot(ry, ry)})))"


def tau_text(xs: list[str], ys: list[str]) -> str:
    """Tau-b from value columns, over the places where neither is null; null as in `spearman_text`."""
    pairs = [(i, j) for i in range(len(xs)) for j in range(i + 1, len(xs))]
    sx = [f"coalesce(signum({xs[i]} - {xs[j]}), 0.0D)" for i, j in pairs]
    sy = [f"coalesce(signum({ys[i]} - {ys[j]}), 0.0D)" for i, j in pairs]
    both = _plus([f"{a} * {b}" for a, b in zip(sx, sy)])
    return (f"if({present(xs)} < {LEAST_MODELS}, NULL, try_divide({both}, sqrt({_plus([f'abs({a})' for a in sx])} * "
            f"{_plus([f'abs({b})' for b in sy])})))")
