"""Null-safe numeric column helpers."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F


def dlit(x: float) -> Column:
    return F.lit(float(x))


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is zero."""
    return F.try_divide(num, den)


def snap(x: Column, digits: int) -> Column:
    """Round to ``digits`` with plain double arithmetic.

    Ranks compare metrics for equality, so both sides of a comparison are
    snapped to a grid first; the small bias sends exact decimal ties that
    carry floating-point noise the same way.
    """
    scale = float(10**digits)
    return F.floor(x * scale + 0.50001) / scale


def clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def guarded_corr(x: Column, y: Column, min_n: int = 2) -> Column:
    """Aggregate Pearson correlation; null when undefined or n < min_n.

    The built-in ``corr`` raises in ANSI mode when a side is constant.
    """
    ok = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(ok, x), F.when(ok, y)
    cov = F.covar_pop(xx, yy)
    den = F.sqrt(F.var_pop(xx) * F.var_pop(yy))
    return F.when(F.count(xx) >= min_n, F.try_divide(cov, den))


def normal_quantile(p: float) -> float:
    """Standard normal quantile of one configured level (driver scalar)."""
    return NormalDist().inv_cdf(min(max(p, 1e-3), 1 - 1e-3))


#: Degrees of freedom from which the tail is that of an equivalent normal deviate.
MANY = 200.0
_STEPS = 120


def _gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a): the asymptotic series at a + 16, brought back by the recurrence."""
    z = a + 16.0
    series, power = F.lit(1.0), z
    for c in (-1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304):
        series, power = series + c / power, power * z
    back = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(1.0), lambda acc, k: acc * (a + k) / (a + k + 0.5))
    return F.sqrt(z) * series * back


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method: two terms a step, three numbers of state."""
    safe = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def term(s: Column, f: Column) -> Column:
        # through an array of one, so that c and d are computed once
        cd = F.array(F.struct(safe(1.0 + f / s["c"]).alias("c"), (1.0 / safe(1.0 + f * s["d"])).alias("d")))
        return F.transform(cd, lambda u: F.struct(u["c"].alias("c"), u["d"].alias("d"), (s["h"] * u["c"] * u["d"]).alias("h")))[0]

    def step(s: Column, k: Column) -> Column:
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        return F.transform(F.array(term(s, even)), lambda u: term(u, odd))[0]

    d = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")),
                       step, lambda s: s["h"])


def normal_deviate(t: Column, df: Column) -> Column:
    """The |normal deviate| with the two-sided tail of |t| at df degrees of freedom (Hill 1970): six digits for ten of
    them, all for hundreds."""
    a = df - 0.5
    z = F.sqrt(a * F.log1p(t * t / df))
    b = 48.0 * a * a
    return (z + (F.pow(z, 3.0) + 3.0 * z) / b
            - (4.0 * F.pow(z, 7.0) + 33.0 * F.pow(z, 5.0) + 240.0 * F.pow(z, 3.0) + 855.0 * z)
            / (10.0 * b * (b + 0.8 * F.pow(z, 4.0) + 100.0)))


def normal_two_sided_p(z: Column) -> Column:
    """Tail beyond |z| on both sides: a power series to 2.5, beyond it the continued fraction from its far end."""
    density = F.exp(-0.5 * z * z) * 0.3989422804014327

    def step(s: Column, k: Column) -> Column:
        return F.transform(F.array(s["t"] * z * z / (2 * k + 1)), lambda v: F.struct(v.alias("t"), (s["s"] + v).alias("s")))[0]
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("t"), z.alias("s")), step, lambda s: s["s"])
    far = F.aggregate(F.sequence(F.lit(1), F.lit(90)), z, lambda s, k: z + (91 - k) / s)
    return F.when(z < 2.5, 1.0 - 2.0 * density * series).otherwise(2.0 * density / far)


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for any positive degrees of freedom, whole or not, in constant space and work.

    Few degrees of freedom: the incomplete beta function I_x(df / 2, 1 / 2) by its continued fraction, on the side where
    that converges fast.  Many: the tail of the equivalent normal deviate, which is as exact there.
    """
    def tail(s: Column) -> Column:
        t, df = s["t"], s["df"]
        a, half = df / 2.0, F.lit(0.5)
        x, y = df / (df + t * t), t * t / (df + t * t)
        front = _gamma_ratio(a) * 0.5641895835477563 * F.pow(x, a) * F.sqrt(y)
        few = F.when(x < (a + 1.0) / (a + 2.5), front * _beta_fraction(a, half, x) / a).otherwise(
            1.0 - front * _beta_fraction(half, a, y) / 0.5)
        many = F.transform(F.array(normal_deviate(t, df)), normal_two_sided_p)[0]
        return F.when(t.isNull() | df.isNull() | ~(df > 0), F.lit(None)).when(t == 0, 1.0).when(df > MANY, many).otherwise(few)

    # through an array of one, so that t and df are computed once
    one = F.array(F.struct(F.abs(t).cast("double").alias("t"), df.cast("double").alias("df")))
    return F.transform(one, tail)[0]
