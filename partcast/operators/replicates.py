"""Replicate matrices: bootstrap sums as arrays, for thousands of replicates and many arms in one pass.

A series has a row per arm, with the cell it falls into there and the metrics to
be summed.  A task draws the weights of a series for a block of
replicates once, uses them for all arms, and adds metric x replicate matrices
per arm and cell; it sends one row per arm, cell and block, whose value is the
matrix.  Rows are merged in two stages, first in `FAN` groups of tasks, then per
block with all cells of the block side by side, so that statistics of any union
of neighbouring cells (price above a threshold, one band, everything) come from
prefix and suffix sums of the same matrices.  Nothing grows with the series but
the number of tasks; a task holds arms x cells x metrics x replicates numbers.

Weights are Poisson(1) and a pure function of (unit, replicate, seed).
`quick_weights` reads four of them from each mixed 64-bit word through a table
of 65,536 entries, a few nanoseconds each; `portable_weights` draws those of
`functions.resampling`, which SQL can repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.functions.resampling import MODULUS, poisson_numpy

BLOCK, ROWS, FAN = 500, 512, 16
#: The plain estimate is replicate -1, in a block of its own.
POINT = -1

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


class Arm(NamedTuple):
    cell: str                   #: SQL, an integer >= 0; series where it is null are left out of the arm
    metrics: tuple[str, ...]    #: SQL; a series that lacks one is left out of the arm
    weight: str = "1.0D"        #: SQL, a design weight that multiplies the drawn one


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _poisson_table() -> pa.Array:
    """The Poisson(1) count of each 16-bit number."""
    terms = np.cumprod(np.concatenate([[np.exp(-1.0)], 1.0 / np.arange(1, 12)]))
    return pa.array(np.searchsorted(np.rint(np.cumsum(terms) * 65536), np.arange(65536), "right").astype(np.uint8))


_COUNTS = _poisson_table()
#: Words mixed at once: they stay in the processor's cache.
_WORDS = 1 << 16


def quick_weights(units: np.ndarray, lo: int, hi: int, seed: int) -> np.ndarray:
    """(units x replicates lo..hi) weights; units has two int64 columns."""
    a, b = units[:, 0].view(np.uint64), units[:, 1].view(np.uint64)
    unit = _mixed(_mixed(a + _U(seed * int(_GOLDEN) % (1 << 64))) + b * _U(0xD1342543DE82EF95) + _GOLDEN)
    word = (np.arange(lo // 4, (hi + 3) // 4, dtype=np.uint64) + _U(1)) * _GOLDEN
    out = np.empty((len(units), hi - lo))
    rows = max(1, _WORDS // max(len(word), 1))
    drawn, moved = (np.empty((min(rows, len(units)), len(word)), np.uint64) for _ in range(2))
    for i in range(0, len(units), rows):
        n = min(rows, len(units) - i)
        x, y = drawn[:n], moved[:n]
        np.add(unit[i: i + n, None], word, out=x)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):   # `_mixed` in place
            np.right_shift(x, _U(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, _U(factor), out=x)
        np.right_shift(x, _U(31), out=y)
        np.bitwise_xor(x, y, out=x)
        at = pa.Array.from_buffers(pa.uint16(), x.size * 4, [None, pa.py_buffer(x)])
        counts = pc.take(_COUNTS, at, boundscheck=False).to_numpy().reshape(n, -1)
        out[i: i + n] = counts[:, lo % 4: lo % 4 + hi - lo]
    return out


def portable_weights(units: np.ndarray, lo: int, hi: int, seed: int) -> np.ndarray:
    """The same as `functions.resampling` draws for the key first * (2^31 - 1) + second, without forming that product."""
    first, second = units[:, 0], units[:, 1]
    h0 = (second % MODULUS)[:, None]
    over = (first % MODULUS * 69621 + first // MODULUS % MODULUS * 279470273 % MODULUS + second // MODULUS % MODULUS * 69621)[:, None]
    b = np.arange(lo, hi, dtype=np.int64)[None, :]
    h1 = (h0 * 48271 + over + b * 40692 + seed % 100003 * 7 + 12345) % MODULUS
    h2 = (h1 * h1 % MODULUS + h0 * 16807 + b * 39373) % MODULUS
    h3 = (h2 * h2 % MODULUS + h1 * 48271 + 7) % MODULUS
    return poisson_numpy((h3 * h3 % MODULUS + h2 * 16807 + 13) % MODULUS)


Draw = Callable[[np.ndarray, int, int, int], np.ndarray]


def blocks_of(replicates: int, block: int) -> list[tuple[int, int]]:
    return [(lo, min(lo + block, replicates)) for lo in range(0, replicates, block)]


_SUMS = "arm int, cell int, block int, task int, sums array<double>"


def _batch(rows: list[tuple[int, int, int, int, np.ndarray]]) -> pa.RecordBatch:
    arm, cell, block, task, sums = zip(*rows)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sums])]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x, pa.int32()) for x in (arm, cell, block, task)), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sums)))],
        names=["arm", "cell", "block", "task", "sums"])


class Group(NamedTuple):
    """Series whose numbers are summed together."""
    own: slice | np.ndarray     #: their places among the units
    x: np.ndarray               #: numbers x series
    into: list[tuple[int, int, slice | np.ndarray]]     #: (arm, cell, which of the numbers) that the sums are added to


#: From a task's batches to (units, groups), again and again; units has two int64 columns.
Read = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, list[Group]]]]


def by_row(batches) -> Iterator[tuple[np.ndarray, list[Group]]]:
    """Rows (u0, u1, arm, cell, x); neighbouring rows of one series share its weights."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            units = np.ascontiguousarray(np.column_stack([part.column(0).to_numpy(), part.column(1).to_numpy()]), np.int64)
            new = np.append(True, (units[1:] != units[:-1]).any(axis=1))
            series, units = np.cumsum(new) - 1, units[new]
            arm, cell = part.column(2).to_numpy(), part.column(3).to_numpy()
            at, flat = part.column(4).offsets.to_numpy(), part.column(4).values.to_numpy()
            groups, single = [], new.all()
            for i, c in sorted(set(zip(arm.tolist(), cell.tolist()))):
                rows = np.flatnonzero((arm == i) & (cell == c))
                x = flat[at[rows][:, None] + np.arange(at[rows[0] + 1] - at[rows[0]])].T.copy()
                groups.append(Group(series[rows], x, [(i, c, slice(None))]))
            if single:    # each series is in one group: side by side, their weights need no copy
                units = units[np.concatenate([g.own for g in groups])]
                ends = np.cumsum([len(g.own) for g in groups]).tolist()
                groups = [g._replace(own=slice(b - len(g.own), b)) for g, b in zip(groups, ends)]
            yield units, groups


def _partial(batches, spans: list[tuple[int, int]], seed: int, draw: Draw, read: Read) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() % FAN if TaskContext.get() else 0
    sums: dict[tuple[int, int, int], np.ndarray] = {}

    def add(k: int, into: list[tuple[int, int, slice | np.ndarray]], x: np.ndarray) -> None:
        for i, c, which in into:
            if (i, c, k) in sums:
                sums[i, c, k] += x[which]
            else:
                sums[i, c, k] = x[which].copy()

    for units, groups in read(batches):
        for g in groups:
            add(POINT, g.into, g.x.sum(axis=1)[:, None])
        for k, (lo, hi) in enumerate(spans):
            w = draw(units, lo, hi, seed)
            for g in groups:
                add(k, g.into, g.x @ w[g.own])
    for (i, c, k), x in sums.items():
        yield _batch([(i, c, k, task, x.ravel())])


def _added(batches) -> Iterator[pa.RecordBatch]:
    """Rows in order of arm, cell, block and task: one row for all that agree in them."""
    now, total = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
        at, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
        for key, a, b in zip(keys, at[:-1], at[1:]):
            if key != now:
                if now is not None:
                    yield _batch([(*now, total)])
                now, total = key, flat[a:b].copy()
            else:
                total += flat[a:b]
    if now is not None:
        yield _batch([(*now, total)])


def arm_rows(df: DataFrame, units: list[str], arms: dict[str, Arm]) -> DataFrame:
    """One row per series -> one per series and arm (u0, u1, arm, cell, x), those of a series side by side."""
    structs = []
    for i, arm in enumerate(arms.values()):
        there = " AND ".join(f"({m}) IS NOT NULL" for m in (arm.cell, arm.weight, *arm.metrics))
        x = ", ".join([f"CAST({arm.weight} AS DOUBLE)", *[f"CAST(({m}) * ({arm.weight}) AS DOUBLE)" for m in arm.metrics]])
        structs.append(f"if({there}, struct({i} AS arm, CAST({arm.cell} AS INT) AS cell, array({x}) AS x), NULL)")
    names = [f"CAST({u} AS BIGINT) AS u{j}" for j, u in enumerate((*units, "0L")[:2])]
    return df.selectExpr(*names, f"inline(array_compact(array({', '.join(structs)})))")


def matrices(rows: DataFrame, replicates: int, seed: int = 42, block: int = BLOCK, draw: Draw = quick_weights,
             read: Read = by_row) -> DataFrame:
    """(arm, cell, block, task, sums): weighted sums of x, entry by entry over the block's replicates.

    rows (u0, u1, arm, cell, x): the unit in two numbers, an arm's place, its cell, and the weight with the weighted
    metrics; or whatever ``read`` makes groups of.  Block -1 holds the plain sums.
    """
    spans, key = blocks_of(replicates, block), ["arm", "cell", "block", "task"]
    parts = rows.mapInArrow(lambda it: _partial(it, spans, seed, draw, read), _SUMS)
    return parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(_added, _SUMS)


#: From {view: sums of (weight, metrics) x replicates} to {name: statistics x replicates}.
Statistic = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


#: Cells lo <= cell < hi, or a list of cells.
View = tuple[int, int] | list[int]


def unions(cells: dict[int, np.ndarray], views: dict[str, View]) -> dict[str, np.ndarray]:
    """Sums over the cells of each view that has any, from prefix and suffix sums of the ordered cells."""
    order = sorted(cells)
    if not order:
        return {}
    up = [cells[order[0]]]
    for c in order[1:]:
        up.append(up[-1] + cells[c])
    down = [cells[order[-1]]]
    for c in order[-2::-1]:
        down.append(down[-1] + cells[c])
    out = {}
    for name, view in views.items():
        if isinstance(view, list):
            some = [cells[c] for c in view if c in cells]
            out |= {name: sum(some[1:], some[0])} if some else {}
            continue
        lo, hi = view
        a, b = np.searchsorted(order, [lo, hi])
        if a >= b:
            continue
        if a == 0:
            out[name] = up[b - 1]
        elif b == len(order):
            out[name] = down[len(order) - 1 - a]
        else:
            out[name] = cells[order[a]] if b == a + 1 else up[b - 1] - up[a - 1]
    return out


def statistics(sums: DataFrame, arms: list[str], views: dict[str, View], statistic: Statistic, replicates: int,
               block: int = BLOCK) -> DataFrame:
    """matrices -> (arm, name, b, values): what statistic makes of the views, a row per replicate; b = -1 is the plain estimate."""
    sizes = [hi - lo for lo, hi in blocks_of(replicates, block)]
    names, kind = list(arms), pa.list_(pa.float64())

    def made(arm: int, k: int, cells: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        whole = unions(cells, views)
        with np.errstate(divide="ignore", invalid="ignore"):
            got = statistic(whole)
        for name, values in got.items():
            n = values.shape[1]
            b = np.arange(n, dtype=np.int64) + (k * block if k >= 0 else POINT)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[arm]] * n), pa.array([name] * n), pa.array(b),
                 pa.array([[None if np.isnan(v) else v for v in row] for row in values.T.tolist()], kind)],
                names=["arm", "name", "b", "values"])

    def rows(batches):
        now, cells = None, {}
        for batch in batches:
            at, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            for arm, cell, k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), at[:-1], at[1:]):
                if (arm, k) != now:
                    if now is not None:
                        yield from made(*now, cells)
                    now, cells = (arm, k), {}
                size = 1 if k == POINT else sizes[k]
                x = flat[a:b].reshape(-1, size)
                cells[cell] = cells[cell] + x if cell in cells else x.copy()
        if now is not None:
            yield from made(*now, cells)

    return (sums.repartition("arm", "block").sortWithinPartitions("arm", "block", "cell", "task")
            .mapInArrow(rows, "arm string, name string, b long, values array<double>"))


def means(sums: np.ndarray) -> np.ndarray:
    """Weighted means of the metrics, metric x replicate; no value where a replicate drew nothing."""
    return np.where(sums[0] > 0, sums[1:] / sums[0], np.nan)


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks down the columns; values are told apart on a 1e-6 grid."""
    x = np.floor(x * 1e6 + 0.50001)
    return (x[:, None] > x[None]).sum(axis=1) + ((x[:, None] == x[None]).sum(axis=1) + 1) / 2


def rank_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spearman's rho of the columns of two model x replicate arrays; no value where a side is constant or missing."""
    a, b = ranks(x), ranks(y)
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    out = (a * b).sum(axis=0) / np.sqrt((a * a).sum(axis=0) * (b * b).sum(axis=0))
    return np.where(np.isnan(x).any(axis=0) | np.isnan(y).any(axis=0), np.nan, out)


def fleet_rho(models: int) -> Statistic:
    """Rank correlation of the first models metrics with the next ones, and the sum of weights, per view."""
    def of(views: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {name: np.vstack([rank_correlation(m[:models], m[models: 2 * models]), s[0]])
                for name, s in views.items() for m in [means(s)]}
    return of


def interval(stats: DataFrame, value: int = 0, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """(arm, name, point, lo, hi, p_le_zero, replicates, n): percentiles of one statistic; n is the plain sum of weights,
    where the statistic carries it as its last value."""
    v = stats.selectExpr("arm", "name", "b", f"values[{value}] AS v", "element_at(values, -1) AS n")
    some = "b >= 0 AND v IS NOT NULL"
    return v.groupBy("arm", "name").agg(
        F.expr("max(if(b < 0, v, NULL))").alias("point"),
        F.percentile(F.expr(f"if({some}, v, NULL)"), lo).alias("lo"), F.percentile(F.expr(f"if({some}, v, NULL)"), hi).alias("hi"),
        F.expr(f"avg(if({some}, if(v <= 0, 1.0D, 0.0D), NULL))").alias("p_le_zero"),
        F.expr(f"count_if({some})").alias("replicates"), F.expr("max(if(b < 0, n, NULL))").alias("n"))
