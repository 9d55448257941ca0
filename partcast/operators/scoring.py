"""Forecast, policy and replay of a series for all models at once, in Arrow batches.

The same recurrences as `functions.smoothing`, `operators.policy` and
`operators.replay`, over the rows of a batch instead of the columns of a row: a
series stays one row and its models are the entries of arrays, so nothing is
exploded and regrouped.  As column arithmetic the nine models of a series make
one generated method that is too long for the JVM to compile.

Arrays are models x series, quarters x series for demand.  A missing number is
not-a-number here; `fmin` and `fmax` skip it like `least` and `greatest`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from partcast.config import DAYS_PER_QUARTER, LEAD_CV, CostTerms, Window
from partcast.operators.replicates import Group, Read

#: Series worked on at once: their arrays stay in the processor's cache.
ROWS = 2048
Values = dict[str, np.ndarray]


def _total(values) -> np.ndarray:
    return reduce(np.add, values)


def _smooth(start: np.ndarray, values, alpha: np.ndarray) -> np.ndarray:
    state = start
    for v in values:
        state = alpha * v + (1.0 - alpha) * state
    return state


def moments(v: np.ndarray) -> Values:
    """`smoothing.window_stats` of quarters x series."""
    train, some = len(v), v > 0
    nz, total = _total(some.astype(np.float64)), _total(v)
    mean = total / train
    size = np.where(nz > 0, _total(np.where(some, v, 0.0)) / np.fmax(nz, 1.0), 0.0)
    return {
        "nz": nz, "mean": mean, "size": size,
        "adi": np.where(nz > 0, train / np.fmax(nz, 1.0), float(train)),
        "var": _total((v - mean) * (v - mean)) / train,
    }


def levels(v: np.ndarray, a: np.ndarray, e: np.ndarray, equal_info: bool, models: tuple[str, ...],
           supplied: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forecast per model, clipped at zero, and the variance of the training window; EXT is the supplied forecast."""
    train, w = len(v), moments(v)
    seen = v if equal_info else v[:-1]
    top = max(train // 3, 2)
    out: Values = {"EXT": supplied} if supplied is not None else {}
    if {"SBA", "CROSTON", "TSB"} & set(models):
        level, period, prob = w["size"], w["adi"], w["nz"] / train
        for i, x in enumerate(seen):
            some = x > 0
            keep = np.where(some, 1.0 - a, 1.0)
            level = keep * level + np.where(some, a * x, 0.0)
            period = keep * period + np.where(some, a * (w["adi"] if i == 0 else 1.0), 0.0)
            prob = (1.0 - a) * prob + np.where(some, a, 0.0)
        out |= {"SBA": (1.0 - a / 2.0) * level / np.fmax(period, 1e-12), "CROSTON": level / np.fmax(period, 1e-12), "TSB": level * prob}
    if {"ADIDA", "IMAPA"} & set(models):
        near = np.rint(w["adi"])
        k_own, k_max = np.fmin(np.fmax(near, 1.0), max(train // 3, 1)), np.fmin(np.fmax(near, 2.0), top)
        blocks = []
        for k in range(1, top + 1):
            first = train - train // k * k
            b = [_total(v[i: i + k]) for i in range(first, train, k)]
            blocks.append(_smooth(b[0], b, e) / k)
        out["ADIDA"] = np.select([k_own == k for k in range(1, top + 1)], blocks, np.nan)
        out["IMAPA"] = _total([np.where(k_max >= k, b, 0.0) for k, b in enumerate(blocks, 1)]) / k_max
    mean, var = w["mean"], w["var"]
    if "ZIP" in models:
        over = (var > mean + 1e-12) & (mean > 0)
        pi = np.where(over, np.fmin((var - mean) / np.fmax(mean * mean + var - mean, 1e-12), 1.0 - 1e-6), 0.0)
        lam = np.fmax(np.where(over, mean + (var - mean) / np.fmax(mean, 1e-12), mean), 1e-6)
        out["ZIP"] = (1.0 - pi) * lam
    out |= {"SES": _smooth(v[1], v[1:], e), "MA": (v[-1] + v[-2]) / 2.0, "HURDLE_NB": w["nz"] / train * w["size"]}
    return np.fmax(np.stack([out[m] for m in models]), 0.0), var


def count_fits(v: np.ndarray) -> Values:
    """`smoothing.ZIP_FIT` and `smoothing.hurdle_fit` of quarters x series: what their count quantiles need."""
    w = moments(v)
    mean, var, size = w["mean"], w["var"], w["size"]
    over = (var > mean + 1e-12) & (mean > 0)
    apart = _total(np.where(v > 0, (v - size) * (v - size), 0.0)) / np.fmax(w["nz"], 1.0)
    disp = np.where((apart > size) & (size > 0), (apart - size) / np.fmax(size * size, 1e-12), 1e-6)
    return {
        "z_pi": np.where(over, np.fmin((var - mean) / np.fmax(mean * mean + var - mean, 1e-12), 1.0 - 1e-6), 0.0),
        "z_lam": np.fmax(np.where(over, mean + (var - mean) / np.fmax(mean, 1e-12), mean), 1e-6),
        "h_p": w["nz"] / len(v), "h_mu": size, "h_disp": np.fmin(np.fmax(disp, 1e-6), 1e6),
    }


def errors(level: np.ndarray, test: np.ndarray) -> Values:
    h = len(test)
    return {"mae": _total([np.abs(level - x) for x in test]) / h, "rmse": np.sqrt(_total([(level - x) * (level - x) for x in test]) / h)}


def pinball(q: np.ndarray, level: np.ndarray, test: np.ndarray) -> np.ndarray:
    """`distribution.pinball`: mean loss of forecast q at a quantile level per series."""
    return _total([np.where(x >= q, level * (x - q), (level - 1.0) * (x - q)) for x in test]) / len(test)


def economic_order(level: np.ndarray, price: np.ndarray, terms: CostTerms) -> np.ndarray:
    held = terms.holding_rate * price
    return np.fmax(np.sqrt(2.0 * (level * 4.0) * terms.order_cost / np.where(held > 0, held, 1e-9)), 1.0)


def normal_policy(level: np.ndarray, var: np.ndarray, z: np.ndarray, lead_days: np.ndarray, lead_q: np.ndarray, price: np.ndarray,
                  terms: CostTerms, lead_cv: float = LEAD_CV) -> Values:
    spread = lead_days * lead_cv / DAYS_PER_QUARTER
    sigma = np.sqrt(var)
    safety = z * np.sqrt(lead_q * (sigma * sigma) + level * level * (spread * spread))
    rp, eoq = np.fmax(level * lead_q + safety, 0.0), economic_order(level, price, terms)
    return {"rp": rp, "eoq": eoq, "up_to": rp + eoq}


def replayed(test: np.ndarray, rp: np.ndarray, up_to: np.ndarray, opening: np.ndarray, lead_q: np.ndarray, price: np.ndarray,
             terms: CostTerms) -> Values:
    """`replay` and `with_costs` of a policy."""
    orders, stocks, lost, placed = [], [], [], []
    stock = opening
    for t, d in enumerate(test):
        have = stock
        for j, order in enumerate(orders):
            have = have + np.where(lead_q == t - j, order, 0.0)
        served = np.fmin(have, d)
        stock = have - served
        position = stock
        for j, order in enumerate(orders):
            position = position + np.where(lead_q > t - j, order, 0.0)
        below = position < rp
        orders.append(np.where(below, np.fmax(up_to - position, 0.0), 0.0))
        stocks.append(stock)
        lost.append(d - served)
        placed.append(below)
    held, short, n, demand = _total(stocks), _total(lost), _total([p.astype(np.float64) for p in placed]), _total(test)
    out = {
        "on_hand_sum": held, "short_units": short, "n_orders": n,
        "hold_cost": held * price * (terms.holding_rate / terms.quarters_per_year),
        "order_cost": n * terms.order_cost, "short_cost": short * terms.stockout_cost,
        "fill": np.where(demand > 0, 1.0 - short / np.fmax(demand, 1e-12), 1.0),
    }
    return out | {"cost": out["hold_cost"] + out["order_cost"] + out["short_cost"]}


def opened(mode: str, rp: np.ndarray, up_to: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Opening stock: full, at the reorder point, empty, or part-way by u in [0, 1)."""
    return {"S": up_to, "s": rp, "zero": np.zeros_like(rp), "mid": rp + u * np.fmax(up_to - rp, 0.0)}[mode]


def arm_scores(arms: list[tuple], models: tuple[str, ...], terms: CostTerms) -> Callable[..., list[Values]]:
    """Per specification arm the scores over the models, and `holding`: 1 where holding costs at least as much as lost sales
    on average over the models.

    Arms that share a window share its forecasts, errors (the same arrays) and policy.
    """
    def scored(y, a, e, price, lead_days, lead_q, z, u) -> list[Values]:
        out: list[Values] = [{}] * len(arms)
        for win in dict.fromkeys(arm[1:4] for arm in arms):
            w = Window(*win)
            test = y[w.start: w.end]
            level, var = levels(y[:w.train], a, e, True, models)
            shared = errors(level, test)
            p = normal_policy(level, var, z, lead_days, lead_q, price, terms)
            for i, arm in enumerate(arms):
                if arm[1:4] != win:
                    continue
                got = shared | replayed(test, p["rp"], p["up_to"], opened(arm[4], p["rp"], p["up_to"], u), lead_q, price, terms)
                held = np.nansum(got["hold_cost"], axis=0) >= np.nansum(got["short_cost"], axis=0)
                out[i] = got | {"holding": held.astype(np.float64)}
        return out
    return scored


# -- between Arrow and models x series

def _numbers(x: pa.Array) -> np.ndarray:
    return x.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _matrix(x: pa.Array) -> np.ndarray:
    """Rows of one length -> entries x rows."""
    return np.ascontiguousarray(_numbers(x.flatten()).reshape(len(x), -1).T)


def _struct(values: Values) -> pa.StructArray:
    """A field per name: an array per series, or a number where the values have no models."""
    fields = []
    for x in values.values():
        flat = pa.array(np.ascontiguousarray(x.T).ravel(), from_pandas=True)
        fields.append(flat if x.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(x.shape[1] + 1, dtype=np.int32) * len(x)), flat))
    return pa.StructArray.from_arrays(fields, names=list(values))


def _empty(kinds: dict[str, pa.DataType]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array([], k) for k in kinds.values()], names=list(kinds))


def _in_chunks(of: Callable[..., Values], names: tuple[str, ...], n: int, columns: list[np.ndarray]) -> Values:
    parts = []
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for i in range(0, n, ROWS):
            got = of(*[c[..., i: i + ROWS] for c in columns])
            parts.append([got[k] for k in names])
    return {k: np.concatenate(x, axis=-1) for k, x in zip(names, zip(*parts))}


def _udf(of: Callable[..., Values], fields: dict[str, str], matrices: int) -> Callable[..., Column]:
    """A column function over Arrow batches: the first arguments are arrays of one length, the others numbers."""
    kinds = {k: pa.float64() if t == "double" else pa.list_(pa.float64()) for k, t in fields.items()}

    def run(*columns: pa.Array) -> pa.Array:
        if not len(columns[0]):
            return _empty(kinds)
        numpy = [_matrix(c) if i < matrices else _numbers(c) for i, c in enumerate(columns)]
        return _struct(_in_chunks(of, tuple(fields), len(columns[0]), numpy))

    # the annotations tell Spark that whole columns are passed
    return F.arrow_udf(run, "struct<" + ", ".join(f"{k}: {t}" for k, t in fields.items()) + ">")


def scores_udf(names: tuple[str, ...], window: Window, models: tuple[str, ...], equal_info: bool, terms: CostTerms) -> Callable[..., Column]:
    """Per series the named scores, an array over the models each."""
    def scored(y, a, e, price, lead_days, lead_q, z, *supplied):
        test = y[window.start: window.end]
        level, var = levels(y[:window.train], a, e, equal_info, models, *supplied)
        fractile = terms.stockout_cost / (terms.stockout_cost + terms.holding_per_quarter * price)
        out = {"level": level, "pin": pinball(level, fractile, test)} | errors(level, test)
        if not set(names) <= set(out):
            p = normal_policy(level, var, z, lead_days, lead_q, price, terms)
            out |= p | replayed(test, p["rp"], p["up_to"], p["up_to"], lead_q, price, terms)
        return out
    return _udf(scored, {k: "array<double>" for k in names}, 1)


def arms_udf(names: tuple[str, ...], arms: list[tuple], models: tuple[str, ...], terms: CostTerms) -> Callable[..., Column]:
    """Per series and specification arm the named scores; fields are called score_place, the arm's place among the arms.

    `holding_place` is that of :func:`arm_scores`.
    """
    of = arm_scores(arms, models, terms)

    def scored(*columns):
        return {f"{k}_{i}": got[k] for i, got in enumerate(of(*columns)) for k in (*names, "holding")}
    fields = {f"{k}_{i}": "array<double>" for i in range(len(arms)) for k in names}
    return _udf(scored, fields | {f"holding_{i}": "double" for i in range(len(arms))}, 1)


def distributional_udf(window: Window, quantiles: Callable[..., np.ndarray], place: int) -> Callable[..., Column]:
    """Per series mae, rmse and the quantile at a place of the level grid, for ZIP, HURDLE_NB and the supplied point (no quantile).

    ``quantiles`` gives series x grid for arrays (weight, mean, dispersion).
    """
    def scored(y, point):
        none = np.zeros(y.shape[1])
        level, _ = levels(y[:window.train], none, none, False, ("ZIP", "HURDLE_NB", "EXT"), point)
        fit = count_fits(y[:window.train])
        counted = [quantiles(1.0 - fit["z_pi"], fit["z_lam"], none), quantiles(fit["h_p"], fit["h_mu"], fit["h_disp"])]
        return errors(level, y[window.start: window.end]) | {"quantile": np.stack([q[:, place] for q in counted])}
    return _udf(scored, {k: "array<double>" for k in ("mae", "rmse", "quantile")}, 1)


# -- sums over the series of a task

def chunks(batches, keys: int = 0) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """ROWS series at a time: the first columns as whole numbers; then demand (quarters x series) and the others as numbers."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            columns = [part.column(j) for j in range(part.num_columns)]
            yield [c.to_numpy() for c in columns[:keys]], [_matrix(columns[keys]), *map(_numbers, columns[keys + 1:])]


def _counted(x: np.ndarray) -> list[np.ndarray]:
    """How many series have a number, and their sum, per model."""
    there = ~np.isnan(x)
    return [there.sum(axis=1), np.where(there, x, 0.0).sum(axis=1)]


def policy_means(panel: DataFrame, places: list[tuple[str, float]], window: Window, models: tuple[str, ...],
                 terms: CostTerms = CostTerms()) -> DataFrame:
    """(place, model, cost, fill): means over the series of the replayed normal policy, per place of a grid of (service
    factor as SQL, lead time variation).

    A task forecasts a series once, replays it per place and model, and sends a row per place and model.
    """
    factors = list(dict.fromkeys(z for z, _ in places))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((len(places), 4, len(models))), 0
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for _, (y, a, e, price, lead_days, lead_q, *z) in chunks(batches):
                test = y[window.start: window.end]
                level, var = levels(y[:window.train], a, e, False, models)
                for i, (factor, lead_cv) in enumerate(places):
                    p = normal_policy(level, var, z[factors.index(factor)], lead_days, lead_q, price, terms, lead_cv)
                    got = replayed(test, p["rp"], p["up_to"], p["up_to"], lead_q, price, terms)
                    sums[i] += [*_counted(got["cost"]), *_counted(got["fill"])]
                rows += y.shape[1]
        if rows:
            values = sums.transpose(1, 0, 2).reshape(4, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(places), dtype=np.int32), len(models))), pa.array([*models] * len(places)),
                 *map(pa.array, values)], names=["place", "model", "nc", "c", "nf", "f"])

    src = panel.selectExpr("y", "sba_alpha", "ses_alpha", "price", "lead_days", "lead_q", *[f"{z} AS z{i}" for i, z in enumerate(factors)])
    parts = src.mapInArrow(partial, "place int, model string, nc double, c double, nf double, f double")
    return parts.groupBy("place", "model").agg(
        F.expr("try_divide(sum(c), sum(nc)) AS cost"), F.expr("try_divide(sum(f), sum(nf)) AS fill"))


def arm_cells(rows: DataFrame, arms: list[tuple], models: tuple[str, ...], metrics: tuple[str, ...], terms: CostTerms) -> DataFrame:
    """(arm, cell, model, n, count and sum of each metric) of the specification arms, a row per task.

    rows: cell, a whole number per series, then what :func:`arm_scores` takes.  The cell of a series in an arm is twice its
    own and 1 more where holding costs prevail there; n counts the series.
    """
    of, numbers = arm_scores(arms, models, terms), [f"{k}_{m}" for m in metrics for k in ("n", "sum")]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for (own,), values in chunks(batches, 1):
                for i, got in enumerate(of(*values)):
                    cell = 2 * own + (got["holding"] > 0)
                    for c in np.unique(cell).tolist():
                        at = cell == c
                        add = np.array([np.full(len(models), at.sum()), *[x for m in metrics for x in _counted(got[m][:, at])]], np.float64)
                        sums[i, c] = sums[i, c] + add if (i, c) in sums else add
        if sums:
            key, values = np.array(list(sums), np.int32), np.concatenate(list(sums.values()), axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.repeat(key[:, j], len(models))) for j in range(2)), pa.array([*models] * len(key)),
                 pa.array(values[0].astype(np.int64)), *map(pa.array, values[1:])], names=["arm", "cell", "model", "n", *numbers])

    return rows.mapInArrow(partial, "arm int, cell int, model string, n long, " + ", ".join(f"{x} double" for x in numbers))


def arm_groups(arms: list[tuple], models: tuple[str, ...], metrics: tuple[str, ...], terms: CostTerms) -> Read:
    """Groups for `replicates.matrices` of the specification arms: a weight of 1 and the metrics, cells as in :func:`arm_cells`.

    rows: two keys and the cell, then what :func:`arm_scores` takes.  Series that are in the same cells in all arms are one
    group, whose numbers are multiplied once; errors that arms share are in it once.  A series that lacks a metric in an
    arm is left out of that arm.
    """
    of = arm_scores(arms, models, terms)

    def read(batches):
        for (u0, u1, own), values in chunks(batches, 3):
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                scores = of(*values)
            held: dict[int, tuple[int, np.ndarray]] = {}
            size, which, cells = 1, [], []
            for got in scores:
                for x in (got[m] for m in metrics):
                    if id(x) not in held:
                        held[id(x)] = size, x
                        size += len(x)
                which.append(np.concatenate([[0], *[held[id(got[m])][0] + np.arange(len(models)) for m in metrics]]))
                there = ~np.logical_or.reduce([np.isnan(got[m]).any(axis=0) for m in metrics])
                cells.append(np.where(there, 2 * own + (got["holding"] > 0), -1))
            cells = np.array(cells)
            order = np.lexsort(cells)
            cells, x = cells[:, order], np.concatenate([np.ones((1, len(u0))), *[x for _, x in held.values()]])[:, order]
            cut = [0, *(np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1).tolist(), len(order)]
            groups = [Group(slice(a, b), np.ascontiguousarray(x[:, a:b]), [(i, c, which[i]) for i, c in enumerate(cells[:, a].tolist()) if c >= 0])
                      for a, b in zip(cut[:-1], cut[1:])]
            yield np.column_stack([u0, u1])[order], [g for g in groups if g.into]
    return read


def fill_curve(rows: DataFrame, kappas: dict[str, list[float]], terms: CostTerms = CostTerms()) -> DataFrame:
    """(model, kappa, fill, cost): means of the quantile policy scaled by each of the model's factors.

    rows: model, level, q_service, lead_q, price, test.  A task replays its rows once per factor and sends a row per
    model and factor.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, float], np.ndarray] = {}
        for batch in batches:
            model, test = np.array(batch.column(0).to_pylist()), _matrix(batch.column(5))
            numbers = [_numbers(batch.column(i)) for i in range(1, 5)]
            for m in kappas.keys() & set(model.tolist()):
                mine = np.flatnonzero(model == m)
                for i in range(0, len(mine), ROWS):
                    at = mine[i: i + ROWS]
                    level, q, lead_q, price = (x[at] for x in numbers)
                    d, eoq = test[:, at], economic_order(level, price, terms)
                    for k in dict.fromkeys(kappas[m]):
                        rp = k * np.fmax(lead_q * q, 0.0)
                        got = replayed(d, rp, rp + eoq, rp + eoq, lead_q, price, terms)
                        some = [x[~np.isnan(x)] for x in (got["fill"], got["cost"])]
                        add = np.array([f(x) for x in some for f in (len, np.sum)], np.float64)
                        sums[m, k] = sums[m, k] + add if (m, k) in sums else add
        if sums:
            values = np.array(list(sums.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([m for m, _ in sums]), pa.array([k for _, k in sums]), *[pa.array(values[:, i]) for i in range(4)]],
                names=["model", "kappa", "nf", "f", "nc", "c"])

    src = rows.select("model", "level", "q_service", "lead_q", "price", "test")
    parts = src.mapInArrow(partial, "model string, kappa double, nf double, f double, nc double, c double")
    return parts.groupBy("model", "kappa").agg(F.expr("sum(f) / sum(nf) AS fill"), F.expr("sum(c) / sum(nc) AS cost"))


def loss_differences(rows: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """(a, b, n, mean, sd) of the difference in squared error of each pair of models, pooled over series and quarters.

    rows: level (an array over the models) and test.  A task sends count, mean and squared deviations per pair; they are
    merged as such, so no large sums of squares are subtracted.
    """
    pairs = [(i, j) for i in range(len(models)) for j in range(i + 1, len(models))]
    first, second = (np.array(x) for x in zip(*pairs))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, count = 0, np.zeros(len(pairs))
        mean, apart = np.zeros(len(pairs)), np.zeros(len(pairs))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                level, test = _matrix(part.column(0)), _matrix(part.column(1))
                loss = ((level[:, None] - test) * (level[:, None] - test)).reshape(len(level), -1)
                d = loss[first] - loss[second]
                there = ~np.isnan(d)
                k = there.sum(axis=1)
                mid = np.where(there, d, 0.0).sum(axis=1) / np.maximum(k, 1)
                dev = np.where(there, d - mid[:, None], 0.0)
                both, gap = np.maximum(count + k, 1), mid - mean
                apart += (dev * dev).sum(axis=1) + gap * gap * count * k / both
                mean += gap * k / both
                count += k
                rows += d.shape[1]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([models[i] for i in first]), pa.array([models[j] for j in second]), pa.array([rows] * len(pairs), pa.int64()),
                 pa.array(count), pa.array(mean), pa.array(apart)], names=["a", "b", "n", "k", "mean", "apart"])

    parts = rows.select("level", "test").mapInArrow(partial, "a string, b string, n long, k double, mean double, apart double")
    whole = parts.groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.expr("try_divide(sum(k * mean), sum(k))").alias("mean"),
        F.sum("apart").alias("apart"), F.collect_list(F.struct("k", "mean")).alias("_tasks"))
    between = "aggregate(_tasks, 0.0D, (s, t) -> s + t.k * (t.mean - mean) * (t.mean - mean))"
    return whole.selectExpr("a", "b", "n", "mean", f"if(k > 1, sqrt((apart + {between}) / (k - 1)), NULL) AS sd")


# -- rank statistics over the models of a series

LEAST_MODELS = 3


def snapped(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.50001) / 1e6


def tau_b(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Kendall's tau-b down the columns; not a number as `arrays.tau_text` is null."""
    both, nx, ny = (np.zeros(x.shape[1]) for _ in range(3))
    for i in range(len(x) - 1):
        a, b = np.nan_to_num(np.sign(x[i] - x[i + 1:])), np.nan_to_num(np.sign(y[i] - y[i + 1:]))
        both, nx, ny = both + (a * b).sum(axis=0), nx + np.abs(a).sum(axis=0), ny + np.abs(b).sum(axis=0)
    den = np.sqrt(nx * ny)
    return np.where(((~np.isnan(x)).sum(axis=0) >= LEAST_MODELS) & (den > 0), both / den, np.nan)


def average_ranks(x: np.ndarray) -> np.ndarray:
    out = 0.5 + _total([np.where(z < x, 1.0, np.where(z == x, 0.5, 0.0)) for z in x])
    return np.where(np.isnan(x), np.nan, out)


def rho(rx: np.ndarray, ry: np.ndarray) -> np.ndarray:
    """Correlation of ranks that are missing in the same places; not a number as `arrays.spearman_text` is null."""
    n = (~np.isnan(rx)).sum(axis=0)
    a, b = np.nan_to_num(rx - (n + 1) / 2.0), np.nan_to_num(ry - (n + 1) / 2.0)
    den = np.sqrt((a * a).sum(axis=0) * (b * b).sum(axis=0))
    return np.where((n >= LEAST_MODELS) & (den > 0), (a * b).sum(axis=0) / den, np.nan)


def ranks_udf(metrics: list[str], wanted: dict[str, tuple[str, str, str]]) -> Callable[..., Column]:
    """Named statistics ("tau" or "rho", x, y) of metric arrays, each a number per series.

    A model that lacks one of the metrics is left out of its series.
    """
    def stats(*columns):
        whole = np.logical_and.reduce([~np.isnan(c) for c in columns])
        at = {m: np.where(whole, snapped(c), np.nan) for m, c in zip(metrics, columns)}
        rank = {m: average_ranks(at[m]) for m in {m for k, x, y in wanted.values() if k == "rho" for m in (x, y)}}
        return {n: tau_b(at[x], at[y]) if k == "tau" else rho(rank[x], rank[y]) for n, (k, x, y) in wanted.items()}
    return _udf(stats, {n: "double" for n in wanted}, len(metrics))
