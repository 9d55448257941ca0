"""Per-quarter forecast paths over windows of row-dependent length (array folds)."""

from __future__ import annotations


def sba_path(y: str, alpha: str) -> str:
    """SBA forecast of every quarter of ``y``; initial values from all of ``y``."""
    pos = f"filter({y}, x -> x > 0)"
    n = f"greatest(size({pos}), 1)"
    level0 = f"(aggregate({pos}, 0.0D, (a, x) -> a + x) / {n})"
    gap0 = f"(CAST(size({y}) AS DOUBLE) / {n})"
    prev, here = f"{y}[t - 2]", f"{y}[t - 1]"
    level = f"if({prev} > 0, {alpha} * {prev} + (1.0D - {alpha}) * s.l, s.l)"
    period = f"if({prev} > 0, {alpha} * s.g + (1.0D - {alpha}) * s.p, s.p)"
    out = lambda lv, pd: f"(1.0D - {alpha} / 2.0D) * {lv} / greatest({pd}, 1e-12D)"
    return (
        f"aggregate(sequence(2, size({y})), "
        f"named_struct('l', {level0}, 'p', {gap0}, 'g', {gap0}, 'f', array({out(level0, gap0)})), "
        f"(s, t) -> named_struct('l', {level}, 'p', {period}, 'g', if({here} > 0, 1.0D, s.g + 1.0D), "
        f"'f', concat(s.f, array({out(level, period)}))), s -> s.f)"
    )


def ses_path(y: str, alpha: str) -> str:
    return (f"aggregate(sequence(3, size({y})), slice({y}, 1, 2), "
            f"(s, t) -> concat(s, array({alpha} * {y}[t - 2] + (1.0D - {alpha}) * element_at(s, -1))))")


def ma2_path(y: str) -> str:
    return f"transform(sequence(1, size({y})), t -> if(t <= 2, {y}[t - 1], ({y}[t - 2] + {y}[t - 3]) / 2.0D))"
