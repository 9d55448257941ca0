"""Reproducible resampling weights.

A weight is a pure function of (unit key, replicate, seed): the bootstrap does
not depend on partitioning, on retries of lost tasks, or on how often a stage
is recomputed, and every model of a unit gets the same weight, which is what
makes comparisons paired.  Weights are Poisson(1), the large-sample limit of
drawing n units with replacement.

The mixing uses only 64-bit integer products below 2^62, so the JVM, NumPy and
any SQL engine produce the same integers.
"""

from __future__ import annotations

import math

import numpy as np

MODULUS = 2147483647


def _thresholds() -> list[int]:
    out, cum, term = [], 0.0, math.exp(-1.0)
    for k in range(13):  # what lies beyond is rarer than one in MODULUS
        cum += term
        out.append(int(cum * MODULUS))
        term /= k + 1
    return out


THRESHOLDS = _thresholds()


def mix_columns(key: str, b: str, seed: int) -> dict[str, str]:
    """Step-by-step columns; each refers to the one before.

    The key, not negative and below 2^62, enters as quotient and remainder, so
    different keys stay different.
    """
    add = seed % 100003 * 7 + 12345
    return {
        "_h0": f"({key}) % {MODULUS}",
        "_h1": f"(_h0 * 48271 + CAST(floor((({key}) - _h0) / {MODULUS} + 0.5) AS BIGINT) * 69621 + {b} * 40692 + {add}) % {MODULUS}",
        "_h2": f"(_h1 * _h1 % {MODULUS} + _h0 * 16807 + {b} * 39373) % {MODULUS}",
        "_h3": f"(_h2 * _h2 % {MODULUS} + _h1 * 48271 + 7) % {MODULUS}",
        "_h4": f"(_h3 * _h3 % {MODULUS} + _h2 * 16807 + 13) % {MODULUS}",
    }


def mix_numpy(keys: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """(units x replicates) mixed integers."""
    add = seed % 100003 * 7 + 12345
    h0 = (keys.astype(np.int64) % MODULUS)[:, None]
    b = b.astype(np.int64)[None, :]
    h1 = (h0 * 48271 + (keys.astype(np.int64) // MODULUS)[:, None] * 69621 + b * 40692 + add) % MODULUS
    h2 = (h1 * h1 % MODULUS + h0 * 16807 + b * 39373) % MODULUS
    h3 = (h2 * h2 % MODULUS + h1 * 48271 + 7) % MODULUS
    return (h3 * h3 % MODULUS + h2 * 16807 + 13) % MODULUS


def poisson_sql(h: str = "_h4", double: str = "DOUBLE") -> str:
    return "CAST(" + " + ".join(f"(CASE WHEN {h} >= {t} THEN 1 ELSE 0 END)" for t in THRESHOLDS) + f" AS {double})"


def poisson_numpy(h: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.asarray(THRESHOLDS, dtype=np.int64), h, side="right").astype(np.float64)


def uniform_sql(key: str, seed: int) -> dict[str, str]:
    """Columns ending in ``u`` in [0, 1): one draw per unit."""
    return mix_columns(key, "0", seed) | {"u": f"_h4 / {MODULUS}.0D"}
