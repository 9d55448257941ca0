"""Reusable SQL fragments: the same definitions, stated for a SQL engine.

Recurrences are written in their textbook step-by-step form with recursive
CTEs, independently of the column expressions they check.
"""

from __future__ import annotations

from statistics import NormalDist

from partcast.catalog.rounding import expand
from partcast.config import CLEAN, MODELS, CostTerms, Window
from partcast.functions.resampling import mix_columns, poisson_sql


def num(x: float) -> str:
    """A DOUBLE literal (plain decimals would be DECIMAL)."""
    return f"{x!r}::DOUBLE"


def series(grain: str = "sku") -> str:
    site = "l_suppkey" if grain == "sku" else "0::BIGINT"
    return f"""
cells AS (
  SELECT l_partkey AS item_id, {site} AS site_id,
         (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) AS q,
         sum(l_quantity) AS qty, sum(l_extendedprice) AS rev
  FROM lineitem GROUP BY ALL),
heads AS (
  SELECT item_id, site_id, floor(sum(rev) / sum(qty) * 100.0::DOUBLE + 0.50001::DOUBLE) / 100.0::DOUBLE AS price0
  FROM cells GROUP BY item_id, site_id),
series AS (
  SELECT h.item_id, h.site_id, any_value(h.price0) AS price0,
         list(coalesce(c.qty, 0.0::DOUBLE) ORDER BY g.q) AS y
  FROM heads h CROSS JOIN (SELECT unnest(range(1, 29)) AS q) g
  LEFT JOIN cells c ON c.item_id = h.item_id AND c.site_id = h.site_id AND c.q = g.q
  GROUP BY h.item_id, h.site_id),
seg0 AS (
  SELECT item_id, site_id, count(*)::DOUBLE AS n, sum(qty) AS s, sum(qty * qty) AS ss
  FROM cells WHERE qty > 0 GROUP BY item_id, site_id),
seg AS (
  SELECT item_id, site_id,
    CASE WHEN 28.0::DOUBLE / n < 1.32::DOUBLE
         THEN CASE WHEN n * ss - s * s < 0.49::DOUBLE * (s * s) THEN 'Smooth' ELSE 'Erratic' END
         ELSE CASE WHEN n * ss - s * s < 0.49::DOUBLE * (s * s) THEN 'Intermittent' ELSE 'Lumpy' END
    END AS seg
  FROM seg0),
raw AS (
  SELECT a.item_id, a.site_id, y, price0,
    CASE WHEN a.item_id % 29 = 0 THEN NULL WHEN a.item_id % 31 = 0 THEN 0.0::DOUBLE ELSE price0 END AS price_raw,
    CASE WHEN a.item_id % 13 = 0 THEN NULL ELSE (15 + (a.item_id * 37 + a.site_id * 11) % 300)::DOUBLE END AS lead_raw,
    CASE WHEN a.item_id % 11 = 0 THEN NULL ELSE 0.05::DOUBLE + 0.05::DOUBLE * (a.item_id % 4) END AS sba_alpha_raw,
    CASE WHEN a.item_id % 7 = 0 THEN NULL ELSE 0.2::DOUBLE + 0.1::DOUBLE * (a.site_id % 4) END AS ses_alpha_raw,
    CASE (a.item_id * 7 + a.site_id * 3) % 10 WHEN 0 THEN 'Critical' WHEN 1 THEN ' high ' WHEN 2 THEN 'Low'
      WHEN 3 THEN '3' WHEN 4 THEN NULL ELSE 'Normal' END AS criticality,
    CASE (a.item_id * 3 + a.site_id) % 7 WHEN 0 THEN 'A' WHEN 1 THEN ' A' WHEN 2 THEN 'B' WHEN 3 THEN 'B '
      WHEN 4 THEN 'C' WHEN 5 THEN 'X' END AS abc_raw,
    CASE WHEN a.item_id % 9 < 5 THEN 'Strategy ' || (a.item_id % 9 + 1)::VARCHAR WHEN a.item_id % 9 = 5 THEN 'Other'
      WHEN a.item_id % 9 = 6 THEN ' Strategy 1 ' WHEN a.item_id % 9 = 7 THEN 'strategy 9' END AS strategy_raw,
    CASE WHEN a.item_id % 17 = 0 THEN NULL WHEN a.item_id % 19 = 0 THEN ' ' || seg || ' ' ELSE seg END AS segment_raw
  FROM series a JOIN seg USING (item_id, site_id))"""


def panel(grain: str = "sku") -> str:
    return series(grain) + """,
panel AS (
  SELECT item_id, site_id, y,
    CASE WHEN price_raw > 0 THEN price_raw ELSE 1.0::DOUBLE END AS price,
    CASE WHEN lead_raw > 0 THEN lead_raw ELSE 60.0::DOUBLE END AS lead_days,
    greatest(ceil((CASE WHEN lead_raw > 0 THEN lead_raw ELSE 60.0::DOUBLE END) / 91.3125::DOUBLE), 1)::BIGINT AS lead_q,
    coalesce(sba_alpha_raw, 0.1::DOUBLE) AS sba_alpha,
    coalesce(ses_alpha_raw, 0.5::DOUBLE) AS ses_alpha,
    CASE WHEN lower(trim(criticality)) IN ('critical', 'high', '1') THEN 'high'
         WHEN lower(trim(criticality)) IN ('low', '3') THEN 'low' ELSE 'mid' END AS tier,
    CASE WHEN trim(segment_raw) IN ('Smooth', 'Erratic', 'Intermittent', 'Lumpy') THEN trim(segment_raw) ELSE 'Unknown' END AS segment,
    CASE WHEN trim(abc_raw) IN ('A', 'B', 'C') THEN trim(abc_raw) ELSE 'Unknown' END AS abc,
    CASE WHEN trim(strategy_raw) IN ('Strategy 1', 'Strategy 2', 'Strategy 3', 'Strategy 4', 'Strategy 5', 'Other')
         THEN trim(strategy_raw) ELSE 'Unknown' END AS strategy
  FROM raw)"""


def _block(k: int, t: int) -> str:
    n = t // k
    first = t - n * k
    parts = ", ".join(
        "(" + " + ".join(f"tr[{first + i * k + j + 1}]" for j in range(k)) + ")" for i in range(n))
    return f"[{parts}]"


def forecasts(train: int = 16, equal_info: bool = False, models=MODELS, tag: str = "", src: str = "panel") -> str:
    """fc{tag}: one row per series with f_<model> and the window moments."""
    t = train
    top = max(t // 3, 2)
    upd = t if not equal_info else t + 1
    ses_k = ",\n    ".join(
        f"list_reduce({_block(k, t)}, lambda f, v: ses_alpha * v + (1.0::DOUBLE - ses_alpha) * f, ({_block(k, t)})[1]) / {num(k)} AS b{k}"
        for k in range(1, top + 1))
    kcase = " ".join(f"WHEN {k} THEN b{k}" for k in range(1, top + 1))
    ksum = " + ".join(f"(CASE WHEN kmax >= {k} THEN b{k} ELSE 0.0::DOUBLE END)" for k in range(1, top + 1))
    cols = {
        "SBA": "(1.0::DOUBLE - sba_alpha / 2.0::DOUBLE) * level / greatest(period, 1e-12::DOUBLE)",
        "CROSTON": "level / greatest(period, 1e-12::DOUBLE)",
        "TSB": "level * prob",
        "SES": "list_reduce(tr[2:], lambda f, v: ses_alpha * v + (1.0::DOUBLE - ses_alpha) * f, tr[2])",
        "MA": f"(tr[{t}] + tr[{t - 1}]) / 2.0::DOUBLE",
        "ADIDA": f"CASE k {kcase} END",
        "IMAPA": f"({ksum}) / kmax",
        "ZIP": "(1.0::DOUBLE - z_pi) * z_lam",
        "HURDLE_NB": "h_p * h_mu",
    }
    sel = ",\n    ".join(f"{cols[m]} AS f_{m}" for m in models)
    return f"""
w0{tag} AS (
  SELECT *, y[1:{t}] AS tr, list_sum(y[1:{t}]) / {num(t)} AS m,
    len(list_filter(y[1:{t}], lambda x: x > 0))::DOUBLE AS nz,
    coalesce(list_sum(list_filter(y[1:{t}], lambda x: x > 0)), 0.0::DOUBLE) AS spos
  FROM {src}),
w1{tag} AS (
  SELECT *, CASE WHEN nz > 0 THEN spos / nz ELSE 0.0::DOUBLE END AS size0,
    CASE WHEN nz > 0 THEN {num(t)} / nz ELSE {num(t)} END AS adi,
    list_sum(list_transform(tr, lambda x: (x - m) * (x - m))) / {num(t)} AS v
  FROM w0{tag}),
w2{tag} AS (
  SELECT *, CASE WHEN nz > 0 THEN list_sum(list_transform(list_filter(tr, lambda x: x > 0), lambda x: (x - size0) * (x - size0))) / nz
       ELSE 0.0::DOUBLE END AS size_var
  FROM w1{tag}),
w3{tag} AS (
  SELECT *, sqrt(v) AS sigma,
    CASE WHEN v > m + 1e-12::DOUBLE AND m > 0 THEN m + (v - m) / m ELSE m END AS lam0,
    CASE WHEN v > m + 1e-12::DOUBLE AND m > 0 THEN least((v - m) / (m * m + v - m), (1 - 1e-6::DOUBLE)) ELSE 0.0::DOUBLE END AS z_pi,
    nz / {num(t)} AS h_p, size0 AS h_mu,
    least(greatest(CASE WHEN size_var > size0 AND size0 > 0 THEN (size_var - size0) / (size0 * size0) ELSE 1e-6::DOUBLE END, 1e-6::DOUBLE), 1e6::DOUBLE) AS h_disp,
    least(greatest(round_even(adi, 0), 1), {max(t // 3, 1)})::BIGINT AS k,
    least(greatest(round_even(adi, 0), 2), {top})::BIGINT AS kmax,
    {ses_k}
  FROM w2{tag}),
steps{tag} AS (
  SELECT item_id, site_id, 1 AS t, tr, sba_alpha, size0 AS level, adi AS period, adi AS gap, nz / {num(t)} AS prob FROM w3{tag}
  UNION ALL
  SELECT item_id, site_id, t + 1, tr, sba_alpha,
    CASE WHEN tr[t] > 0 THEN sba_alpha * tr[t] + (1.0::DOUBLE - sba_alpha) * level ELSE level END,
    CASE WHEN tr[t] > 0 THEN sba_alpha * gap + (1.0::DOUBLE - sba_alpha) * period ELSE period END,
    CASE WHEN tr[t + 1] > 0 THEN 1.0::DOUBLE ELSE gap + 1.0::DOUBLE END,
    (CASE WHEN tr[t] > 0 THEN sba_alpha ELSE 0.0::DOUBLE END) + (1.0::DOUBLE - sba_alpha) * prob
  FROM steps{tag} WHERE t < {upd}),
fc{tag} AS (
  SELECT w.* EXCLUDE (tr), greatest(lam0, 1e-6::DOUBLE) AS z_lam, level, period, prob,
    {sel.replace('z_lam', 'greatest(lam0, 1e-6::DOUBLE)')}
  FROM w3{tag} w JOIN (SELECT item_id, site_id, level, period, prob FROM steps{tag} WHERE t = {upd}) s USING (item_id, site_id))"""


def long_rows(window: Window = CLEAN, models=MODELS, tag: str = "", fc: str | None = None) -> str:
    """lr{tag}: one row per series and model with level, mae, rmse, test demand."""
    fc = fc or f"fc{tag}"
    h = window.horizon
    names = ", ".join(f"'{m}'" for m in models)
    vals = ", ".join(f"greatest(f_{m}, 0.0::DOUBLE)" for m in models)
    ab = " + ".join(f"abs(level - test[{i}])" for i in range(1, h + 1))
    sq = " + ".join(f"(level - test[{i}]) * (level - test[{i}])" for i in range(1, h + 1))
    return f"""
ex{tag} AS (
  SELECT item_id, site_id, segment, abc, strategy, tier, price, lead_days, lead_q, sigma,
    y[{window.start + 1}:{window.end}] AS test,
    unnest([{names}]) AS model, unnest([{vals}]) AS level
  FROM {fc}),
lr{tag} AS (
  SELECT *, ({ab}) / {num(h)} AS mae, sqrt(({sq}) / {num(h)}) AS rmse, list_sum(test) AS test_demand
  FROM ex{tag})"""


def z_of(sl: float) -> float:
    return NormalDist().inv_cdf(min(max(sl, 1e-3), 1 - 1e-3))


def z_case(terms: CostTerms = CostTerms()) -> str:
    return (f"(CASE tier WHEN 'high' THEN {num(z_of(terms.sl_high))} WHEN 'low' THEN "
            f"{num(z_of(terms.sl_low))} ELSE {num(z_of(terms.sl_mid))} END)")


def policy(tag: str = "", src: str | None = None, out: str | None = None, z: str | None = None, cv: str = "0.3::DOUBLE",
           k: str = "50.0::DOUBLE", h: str = "0.25::DOUBLE", sigma: str = "sigma") -> str:
    """pl{tag}: adds rp, eoq, up_to, opening stock (up_to)."""
    src = src or f"lr{tag}"
    out = out or f"pl{tag}"
    z = z or z_case()
    return f"""
{out} AS (
  SELECT *, rp + eoq AS up_to, rp + eoq AS opening FROM (
    SELECT *,
      greatest(level * lead_q + {z} * sqrt(lead_q * ({sigma} * {sigma}) + (level * level) * ((lead_days * {cv} / 91.3125::DOUBLE) * (lead_days * {cv} / 91.3125::DOUBLE))), 0.0::DOUBLE) AS rp,
      greatest(sqrt(2.0::DOUBLE * (level * 4.0::DOUBLE) * {k} / (CASE WHEN {h} * price > 0 THEN {h} * price ELSE 1e-9::DOUBLE END)), 1.0::DOUBLE) AS eoq
    FROM {src}))"""


def replay(horizon: int, ids: str, tag: str = "", src: str | None = None, out: str | None = None) -> str:
    """rp{tag}: replays src (rp, up_to, opening, lead_q, test) keyed by ``ids``.

    Kept in arrivals form: a list of future receipts is shifted each quarter.
    """
    src = src or f"pl{tag}"
    out = out or f"rep{tag}"
    size = horizon + 6
    zero = "[" + ", ".join(["0.0::DOUBLE"] * size) + "]"
    return f"""
{out}_s AS (
  SELECT {ids}, 0 AS t, test, rp, up_to, lead_q, opening AS stock, {zero} AS due,
    0.0::DOUBLE AS held, 0.0::DOUBLE AS short_units, 0::BIGINT AS n_orders
  FROM {src}
  UNION ALL
  SELECT {ids}, t, test, rp, up_to, lead_q, stock,
    list_concat(list_transform(due[2:], lambda v, i: CASE WHEN below AND i = lead_q THEN v + qty ELSE v END), [0.0::DOUBLE]),
    held + stock, short_units, n_orders + (CASE WHEN below THEN 1 ELSE 0 END)
  FROM (
    SELECT *, stock + list_sum(due[2:]) < rp AS below,
      greatest(up_to - (stock + list_sum(due[2:])), 0.0::DOUBLE) AS qty
    FROM (
      SELECT {ids}, t + 1 AS t, test, rp, up_to, lead_q, due, held, n_orders,
        short_units + (test[t + 1] - least(stock + due[1], test[t + 1])) AS short_units,
        stock + due[1] - least(stock + due[1], test[t + 1]) AS stock
      FROM {out}_s WHERE t < {horizon}))),
{out} AS (
  SELECT p.*, s.held AS on_hand_sum, s.short_units, s.n_orders, s.stock AS end_on_hand,
    list_sum(p.test) AS demand_units
  FROM {src} p JOIN (SELECT {ids}, held, short_units, n_orders, stock FROM {out}_s WHERE t = {horizon}) s USING ({ids}))"""


def costs(tag: str = "", src: str | None = None, out: str | None = None, h: str = "0.25::DOUBLE",
          k: str = "50.0::DOUBLE", p: str = "100.0::DOUBLE") -> str:
    src = src or f"rep{tag}"
    out = out or f"sc{tag}"
    return f"""
{out} AS (
  SELECT *, hold_cost + order_cost + short_cost AS cost FROM (
    SELECT *, on_hand_sum * price * ({h} / 4.0::DOUBLE) AS hold_cost, n_orders * {k} AS order_cost,
      short_units * {p} AS short_cost,
      CASE WHEN demand_units > 0 THEN 1.0::DOUBLE - short_units / demand_units ELSE 1.0::DOUBLE END AS fill
    FROM {src}))"""


def scored(window: Window = CLEAN, grain: str = "sku", equal_info: bool = False, models=MODELS,
           tag: str = "", with_panel: bool = True) -> str:
    parts = [panel(grain)] if with_panel else []
    parts += [
        forecasts(window.train, equal_info, models, tag), long_rows(window, models, tag),
        policy(tag), replay(window.horizon, "item_id, site_id, model", tag), costs(tag),
    ]
    return ",".join(parts)


def with_external(sql_parts_before: str, tag: str = "", train: int = 16) -> str:
    """fcx: the forecast table with the supplied external model joined on."""
    return sql_parts_before + f""",
ext AS (
  SELECT item_id, site_id, (s[{train // 2}] + s[{train // 2 + 1}]) / 2.0::DOUBLE AS point,
    [s[{train // 2}], s[{train - 3}], s[{train - 1}], s[{train}], s[{train}]] AS q
  FROM (SELECT item_id, site_id, list_sort(y[1:{train}]) AS s FROM panel WHERE item_id % 7 <> 0)),
fcx AS (
  SELECT f.*, coalesce(e.point, 0.0::DOUBLE) AS f_EXT FROM fc{tag} f LEFT JOIN ext e USING (item_id, site_id))"""


def avg_rank(col: str, part: str) -> str:
    """Fractional rank of a column inside a partition."""
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {col}) + "
            f"(count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0::DOUBLE)")


def safe_corr(x: str, y: str) -> str:
    """Correlation, null when a side is constant."""
    return (f"(CASE WHEN var_pop({x}) * var_pop({y}) > 0 THEN covar_pop({x}, {y}) / "
            f"sqrt(var_pop({x}) * var_pop({y})) END)")


def means(src: str, by: str, metrics: dict[str, str], out: str = "mean_t") -> str:
    """Model means per group, snapped to six digits."""
    cols = ", ".join(f"rd6({e}) AS {m}" for m, e in metrics.items())
    return f"{out} AS (SELECT {by}, model, {cols}, count(*) AS n FROM {src} GROUP BY {by}, model)"


def rho(by: str, x: str, y: str, src: str = "mean_t", out: str = "rho_t") -> str:
    """Rank correlation of two columns per group, over the rows of the group."""
    return (f"{out} AS (SELECT {by}, {safe_corr('rx', 'ry')} AS rho, count(*) AS m, max(n) AS n FROM ("
            f"SELECT *, {avg_rank(x, by)} AS rx, {avg_rank(y, by)} AS ry FROM {src}) GROUP BY {by})")


def grouped(src: str = "sc", out: str = "g") -> str:
    """Rows under 'all' and under their price regime."""
    return (f"{out} AS (SELECT *, 'all' AS grp FROM {src} UNION ALL "
            f"SELECT *, CASE WHEN price >= 1600 THEN 'holding' ELSE 'stockout' END FROM {src})")


def p_value(rho_expr: str, n: int) -> str:
    """Two-sided t p-value of a rank correlation over n points (odd n - 2)."""
    df = n - 2
    assert df % 2 == 1 and df >= 3
    r2 = f"({rho_expr}) * ({rho_expr})"
    th = f"atan(abs(({rho_expr}) * sqrt({df} / greatest(1 - {r2}, 1e-12::DOUBLE))) / sqrt({df}))"
    terms, coef = ["1.0::DOUBLE"], "1.0::DOUBLE"
    for j in range(1, (df - 1) // 2):
        coef = f"{coef} * {2 * j} / {2 * j + 1}"
        terms.append(f"({coef}) * pow(cos({th}), {2 * j})")
    return (f"CASE WHEN abs({rho_expr}) >= 1 - 1e-12::DOUBLE THEN 0.0::DOUBLE ELSE 1 - 2 / pi() * ({th} + sin({th}) * cos({th}) * ("
            + " + ".join(terms) + ")) END")


def tau(src: str, x: str, y: str, out: str = "tau_t", carry: str = "") -> str:
    """Tau-b per series by enumerating model pairs."""
    extra = f", {carry}" if carry else ""
    pick = "".join(f", any_value(a.{c.strip()}) AS {c.strip()}" for c in carry.split(",") if c)
    return f"""
{out}_v AS (SELECT item_id, site_id, model{extra}, rd6({x}) AS vx, rd6({y}) AS vy FROM {src}),
{out} AS (SELECT * EXCLUDE (s, nx, ny), CASE WHEN nx * ny > 0 THEN s / sqrt(nx * ny) END AS tau FROM (
  SELECT a.item_id, a.site_id{pick}, sum(sign(a.vx - b.vx) * sign(a.vy - b.vy))::DOUBLE AS s,
    sum(abs(sign(a.vx - b.vx)))::DOUBLE AS nx, sum(abs(sign(a.vy - b.vy)))::DOUBLE AS ny
  FROM {out}_v a JOIN {out}_v b ON a.item_id = b.item_id AND a.site_id = b.site_id AND a.model < b.model
  GROUP BY a.item_id, a.site_id))"""


def series_rho(src: str, pairs: dict[str, tuple[str, str]], out: str = "sr", carry: str = "") -> str:
    """Spearman per series for each named metric pair."""
    ms = sorted({m for p in pairs.values() for m in p})
    part = "item_id, site_id"
    vals = ", ".join(f"rd6({m}) AS v_{m}" for m in ms)
    ranks = ", ".join(f"{avg_rank('v_' + m, part)} AS r_{m}" for m in ms)
    extra = f", {carry}" if carry else ""
    pick = "".join(f", any_value({c.strip()}) AS {c.strip()}" for c in carry.split(",") if c)
    cors = ", ".join(f"{safe_corr('r_' + x, 'r_' + y)} AS rho_{n}" for n, (x, y) in pairs.items())
    return f"""
{out}_v AS (SELECT item_id, site_id{extra}, {vals} FROM {src}),
{out}_r AS (SELECT item_id, site_id{extra}, {ranks} FROM {out}_v),
{out} AS (SELECT item_id, site_id{pick}, {cors} FROM {out}_r GROUP BY item_id, site_id)"""


def rho_summary(src: str, col: str, by: str = "", where: str = "true") -> str:
    lead = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return (f"SELECT {lead}count(*) AS n, rd6(avg(v)) AS mean, rd6(median(v)) AS median, "
            f"rd6(avg(CASE WHEN v > 0.999 THEN 1.0::DOUBLE ELSE 0 END)) AS share_plus1, rd6(avg(CASE WHEN v < -0.999 THEN 1.0::DOUBLE ELSE 0 END)) AS share_minus1, "
            f"rd6(avg(CASE WHEN abs(v) > 0.99 THEN 1.0::DOUBLE ELSE 0 END)) AS share_abs99, rd6(avg(CASE WHEN v > 0.9 THEN 1.0::DOUBLE ELSE 0 END)) AS share_gt90 "
            f"FROM (SELECT *, rd9({col}) AS v FROM {src} WHERE {col} IS NOT NULL AND {where}){grp}")


def weights(src: str, replicates: int, seed: int = 42, out: str = "bw", key: str = "item_id * 2147483647 + site_id") -> str:
    """Every row of src once per replicate b with its Poisson weight w."""
    cols = ", ".join(f"{e} AS {n}" for n, e in mix_columns("_k", "b", seed).items())
    return (f"{out} AS (SELECT *, {poisson_sql('_h4')} AS w FROM (SELECT *, {cols} FROM ("
            f"SELECT *, ({key})::BIGINT AS _k FROM {src}) CROSS JOIN (SELECT unnest(range({replicates}))::BIGINT AS b)))")


def query(ctes: str, select: str) -> str:
    return expand("WITH RECURSIVE " + ctes.strip() + "\n" + select)
