"""Tuning, scoring, preparation and stream queries in SQL."""

from __future__ import annotations

from skuflow.operators import scoring as C
from skuflow.operators import tuning as T
from skuflow.plans.demand_oracle import EWM, EWM_7, LINE_FIT, LINE_GRID, PART_FIT, PART_GRID, SEGMENTS, STATS, frame, r, with_
from skuflow.plans.warehouse_oracle import CUSTOMER_SLOTS, EVENTS, PLAN, WHOLE

SQL: dict[str, str] = {}

# ---------------------------------------------------------------------- tuning

TUNING = (
    *PART_GRID,
    EWM.format(rows="(SELECT grid.* FROM grid JOIN bounds ON day > d1 - INTERVAL 30 DAY)"),
    f"""
rolled AS (SELECT *, avg(demand) {frame(28)} AS reg FROM grid),
average AS (SELECT sku, coalesce(avg(demand) FILTER (demand > 0), 0) AS base FROM daily GROUP BY sku),
evals AS (
  SELECT g.sku, (datediff('day', d1, g.day) + 29) // 10 AS win, demand AS actual, base, reg, {EWM_7} AS ewm,
         CAST((g.sku * 31 + day_no * 17) % 1000 AS DOUBLE) / 1000 AS p
  FROM rolled g JOIN average USING (sku) LEFT JOIN ewm ON ewm.sku = g.sku AND ewm.day = g.day
  JOIN bounds ON g.day > d1 - INTERVAL 30 DAY)""",
)
_METRICS = """sum(abs(actual - pred)) / sum(actual) * 100 AS wape, (sum(pred) - sum(actual)) / sum(actual) * 100 AS bias"""
_PENALTY = "round(wape + CASE WHEN bias < 0 THEN -3 * bias ELSE 3 * greatest(0, bias - 5) END, 6) AS score"


def _axis(name: str, values: list[int]) -> str:
    return f"{name}s AS (SELECT unnest({values}) AS {name})"


def _fine_axis(name: str, a: T.Axis) -> str:
    return (
        f"{name}s AS (SELECT unnest(range(greatest({a.start}, {name} - {a.reach}), least({a.stop}, {name} + {a.reach}), "
        f"{a.fine_step})) AS {name} FROM coarse_best)"
    )


def _search(axes: dict[str, T.Axis], sums: str, scored: str) -> str:
    """CTEs for a coarse and a fine pass; ``sums`` and ``scored`` carry a {p} prefix for their own and the axis names."""

    def stage(p: str, lists: str) -> str:
        return (
            f"{lists},\n{sums.format(p=p)}{scored.format(p=p)},\n"
            f"{p}_ranked AS (SELECT *, {_PENALTY} FROM {p}_scored),\n"
            f"{p}_best AS (SELECT * FROM {p}_ranked ORDER BY score, {', '.join(axes)} LIMIT 1)"
        )

    coarse = ",\n".join(_axis(n, a.coarse()).replace(f"{n}s AS", f"coarse_{n}s AS", 1) for n, a in axes.items())
    fine = ",\n".join(_fine_axis(n, a).replace(f"{n}s AS", f"fine_{n}s AS", 1) for n, a in axes.items())
    return stage("coarse", coarse) + ",\n" + stage("fine", fine)


def _winner(names: list[str]) -> str:
    cols = ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)
    return f"""
SELECT {cols}, {r('wape', 'wape')}, {r('bias', 'bias')}, {r('score', 'score')} FROM (
  SELECT 0 AS stage, * FROM coarse_best UNION ALL SELECT 1, * FROM fine_best) ORDER BY score, stage LIMIT 1"""


_BLEND = "(CAST(alpha AS DOUBLE) / 1000 * {b} + (1 - CAST(alpha AS DOUBLE) / 1000) * {o})"
_THRESHOLD_AXES = {"thr": T.THRESHOLD, "alpha": T.ALPHA, "mult": T.MULTIPLIER}
_THRESHOLD_SUMS = """
{p}_sums AS (
  SELECT win, sku, thr, sum(actual) AS actual, sum(CASE WHEN p >= CAST(thr AS DOUBLE) / 1000 THEN base ELSE 0 END) AS b,
         sum(CASE WHEN p >= CAST(thr AS DOUBLE) / 1000 THEN reg ELSE 0 END) AS o
  FROM evals CROSS JOIN {p}_thrs GROUP BY win, sku, thr HAVING sum(actual) > 0),"""
_THRESHOLD_SCORED = f"""
{{p}}_scored AS (
  SELECT thr, alpha, mult, {_METRICS} FROM (
    SELECT thr, alpha, mult, actual, {_BLEND.format(b='b', o='o')} * (CAST(mult AS DOUBLE) / 100) AS pred
    FROM {{p}}_sums CROSS JOIN {{p}}_alphas CROSS JOIN {{p}}_mults) GROUP BY thr, alpha, mult)"""
SQL["tune_threshold"] = (
    with_(*TUNING, _search(_THRESHOLD_AXES, _THRESHOLD_SUMS, _THRESHOLD_SCORED)) + _winner(["thr", "alpha", "mult"])
)
_EV_AXES = {"alpha": T.ALPHA, "mult": T.EV_MULTIPLIER, "power": T.POWER}
_EV_SUMS = f"""
{{p}}_sums AS (
  SELECT win, sku, alpha, power, sum(actual) AS actual,
         sum(greatest(pow(p, CAST(power AS DOUBLE) / 100) * {_BLEND.format(b='base', o='reg')}, 0)) AS blend
  FROM evals CROSS JOIN {{p}}_alphas CROSS JOIN {{p}}_powers GROUP BY win, sku, alpha, power HAVING sum(actual) > 0),"""
_EV_SCORED = f"""
{{p}}_scored AS (
  SELECT alpha, mult, power, {_METRICS} FROM (
    SELECT alpha, mult, power, actual, blend * (CAST(mult AS DOUBLE) / 100) AS pred FROM {{p}}_sums CROSS JOIN {{p}}_mults)
  GROUP BY alpha, mult, power)"""
SQL["tune_expected_value"] = with_(*TUNING, _search(_EV_AXES, _EV_SUMS, _EV_SCORED)) + _winner(["alpha", "mult", "power"])
_DAILY_SCORED = f"""
{{p}}_scored AS (
  SELECT thr, alpha, mult, {_METRICS} FROM (
    SELECT thr, alpha, mult, actual, CASE WHEN p >= CAST(thr AS DOUBLE) / 1000
           THEN {_BLEND.format(b='base', o='ewm')} * (CAST(mult AS DOUBLE) / 100) ELSE 0 END AS pred
    FROM evals CROSS JOIN {{p}}_thrs CROSS JOIN {{p}}_alphas CROSS JOIN {{p}}_mults WHERE actual > 0) GROUP BY thr, alpha, mult)"""
SQL["tune_daily"] = with_(*TUNING, _search(_THRESHOLD_AXES, "", _DAILY_SCORED)) + _winner(["thr", "alpha", "mult"])
SQL["tuned_mode"] = f"""
WITH t AS ({SQL['tune_threshold']}), e AS ({SQL['tune_expected_value']})
SELECT 'threshold' AS mode, thr, alpha, mult, CAST(100 AS BIGINT) AS power, wape, bias FROM t
WHERE (SELECT wape FROM e) >= (SELECT wape FROM t)
UNION ALL
SELECT 'expected_value', CAST(NULL AS BIGINT), alpha, mult, power, wape, bias FROM e
WHERE (SELECT wape FROM e) < (SELECT wape FROM t)"""

# --------------------------------------------------------------------- scoring


def future(days: int) -> str:
    return f"""
future_days AS (
  SELECT day, datediff('day', d0, day) AS t, isodow(day) - 1 AS dow, month(day) AS month,
         CASE WHEN day IN (SELECT ds FROM events_of) THEN 1 ELSE 0 END AS hol
  FROM (SELECT CAST(unnest(generate_series(d1 + INTERVAL 1 DAY, d1 + INTERVAL {days} DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds)
  CROSS JOIN bounds),
future AS (
  SELECT line.sku, f.day, CASE WHEN q.sku IS NULL THEN simple_avg
         ELSE greatest(0, greatest(intercept + slope * t, 0.1 * mean_y) * w * m * h) * cal_factor END AS base_yhat,
         simple_avg, demand_freq
  FROM line CROSS JOIN future_days f JOIN weekly USING (sku, dow) JOIN yearly USING (sku, month)
  JOIN holiday USING (sku, hol) JOIN cal_factor USING (sku) JOIN average USING (sku)
  JOIN (SELECT sku, avg(has_demand) AS demand_freq FROM grid GROUP BY sku) USING (sku) LEFT JOIN fitted q ON q.sku = line.sku),
priced AS (
  SELECT *, greatest(demand_freq * ({C.ALPHA} * base_yhat + (1 - {C.ALPHA}) * simple_avg) * {C.BIAS_MULTIPLIER}, 0) AS pred FROM future),
scored AS (
  SELECT *, 1.96 * CASE WHEN simple_avg > 0 THEN 0.4 * simple_avg ELSE 0.5 * pred END AS band FROM priced)"""


FORECAST = (*LINE_FIT, future(31))
_BAND = f"{r('pred', 'pred', 2)}, {r('greatest(0, pred - band)', 'conf_low', 2)}, {r('greatest(0, pred + band)', 'conf_high', 2)}"
SQL["batch_forecast"] = f"{with_(*FORECAST)} SELECT sku, day, {_BAND}, {r('demand_freq', 'probability')} FROM scored"
_CENTS = f"cents AS (SELECT sku, day, {r('pred', 'pred', 2)} FROM scored)"
SQL["forecast_summary"] = f"""{with_(*FORECAST, _CENTS)}
SELECT count(DISTINCT sku) AS n_products, count(DISTINCT day) AS n_days, count(*) AS n_rows,
       count(*) FILTER (pred > 0) AS n_positive, round(sum(pred), 2) AS total_quantity FROM cents"""
SQL["forecast_sample"] = f"""{with_(*FORECAST, _CENTS)}
(SELECT sku, day, pred, 'head' AS part FROM cents ORDER BY day, sku LIMIT 5) UNION ALL
(SELECT sku, day, pred, 'tail' AS part FROM cents ORDER BY day DESC, sku DESC LIMIT 5)"""
SQL["forecast_file"] = f"""{with_(*FORECAST)}
SELECT strftime(day, '%d-%m-%Y') AS "Date", count(*) AS n_products, {r('sum(round(pred, 2))', 'quantity', 1)} FROM scored GROUP BY day"""

PROFILE = f"""
profile AS (
  SELECT sku, segment, avg(b.base_yhat) AS mean_yhat, any_value(cal_factor) AS cal_factor, any_value(simple_avg) AS avg_demand,
         avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS demand_freq,
         (arg_max(base_trend, day) - arg_min(base_trend, day)) / count(*) AS trend_slope
  FROM base b JOIN fitted USING (sku) JOIN cal_factor USING (sku) JOIN average USING (sku) JOIN segments USING (sku)
  GROUP BY sku, segment),
day_totals AS (SELECT sku, count(*) AS demand_days FROM daily GROUP BY sku)"""


def _text(c: str, digits: int) -> str:
    return f"printf('%.{digits}f', CAST(coalesce({c}, 0) AS DOUBLE) + 1e-9)"


SQL["forecast_explained"] = f"""{with_(*LINE_FIT, SEGMENTS, PROFILE, future(1))}
SELECT sku, day, segment, {_BAND}, CASE WHEN pred > 0 THEN 'demand predicted' ELSE 'no demand' END AS decision,
  'Baseline (mean_yhat)|' || {_text('mean_yhat', 2)} || '|high; Classifier probability|' || {_text('s.demand_freq', 4)}
  || CASE WHEN s.demand_freq > 0.5 THEN '|high' ELSE '|medium' END
  || '; Demand frequency|' || {_text('p.demand_freq', 4)} || '|high; Segment|' || segment || '|medium; Avg historical demand|'
  || {_text('avg_demand', 2)} || '|medium; Calendar (day_of_week)|' || (isodow(day) - 1) || '|low; Trend slope|'
  || {_text('trend_slope', 4)} || '|low; Calibration factor|' || {_text('cal_factor', 3)} || '|medium' AS factors
FROM scored s JOIN profile p USING (sku)"""
_hf = "CASE WHEN segment = 'HF' THEN 1.0 ELSE 0.0 END"
_since = "1.0 / greatest(demand_freq, 0.01)"
_approx = {
    "lag_1": "mean_yhat", "lag_28": "mean_yhat", "rmean_7": "mean_yhat", "rmean_wday4": "mean_yhat", "rstd_14": "0.3 * mean_yhat",
    "rmax_28": "1.5 * mean_yhat", "rmin_7": "0.5 * mean_yhat", "rmed_14": "mean_yhat", "rsum_28": "28 * mean_yhat",
    "dfreq_60": "demand_freq", "days_since": _since, "cv_28": "0.5", "ewm_7": "mean_yhat",
    "ewm28_norm": "mean_yhat / greatest(avg_demand, 1e-6)", "lag1_norm": "mean_yhat / greatest(avg_demand, 1e-6)",
    "rmean7_over_28": "1.0", "base_yhat": "mean_yhat", "base_ratio": "mean_yhat / greatest(avg_demand, 1e-6)",
    "base_over_ewm7": "mean_yhat / (mean_yhat + 1e-6)", "prod_std_demand": "0.5 * avg_demand", "prod_n_days": "demand_days",
    "day_idx": "600", "day_idx_sq": "0.36", "dow": "isodow(day) - 1", "week": "week(day)",
    "is_month_end": "CASE WHEN day(day) >= 28 THEN 1 ELSE 0 END", "del_rolling_7": "0", "base_weekly": "0",
    "hf_x_dow": f"{_hf} * (isodow(day) - 1)", "hf_x_lag1": f"{_hf} * mean_yhat", "hf_x_dfreq7": f"{_hf} * demand_freq",
    "hf_x_days_since": f"{_hf} * {_since}", "fourier_sin_y1": "sin(2 * pi() * dayofyear(day) / 365.25)",
}
SQL["approximate_features"] = f"""{with_(*LINE_FIT, SEGMENTS, PROFILE)},
days_ahead AS (
  SELECT CAST(unnest(generate_series(d1 + INTERVAL 1 DAY, d1 + INTERVAL 31 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds)
SELECT sku, day, {", ".join(r(f"CAST({e} AS DOUBLE)", n, 3) for n, e in _approx.items())}
FROM profile JOIN day_totals USING (sku) CROSS JOIN days_ahead"""

SQL["preparation_order"] = f"""{with_(*PLAN, STATS)},
average AS (SELECT sku, coalesce(avg(demand) FILTER (demand > 0), 0) AS level FROM daily GROUP BY sku),
part_forecast AS (
  SELECT sku, CASE WHEN demand_freq >= 0.0115
         THEN greatest(({C.ALPHA} * level + (1 - {C.ALPHA}) * prod_med_demand) * {C.BIAS_MULTIPLIER}, 0) ELSE 0 END AS pred
  FROM average JOIN stats USING (sku) JOIN freq USING (sku)),
asked AS (SELECT sku, {r('sum(qty)', 'override_qty', 2)} FROM ev WHERE direction = 'out' GROUP BY sku),
first_slot AS (
  SELECT a.sku, arg_min(s.slot_id, (ts, event_id)) AS slot_id, arg_min(s.code, (ts, event_id)) AS code
  FROM assigned a JOIN slots s ON s.slot_id = a.slot_id GROUP BY a.sku),
l AS (
  SELECT *, coalesce(override_qty, pred) AS q FROM part_forecast LEFT JOIN asked USING (sku) LEFT JOIN first_slot USING (sku))
SELECT sku, round_even(pred, 2) + 0.0 AS predicted_demand, override_qty IS NOT NULL AS override_applied,
       coalesce(code, 'Non stocke') AS source_location, coalesce(slot_id, 0) AS source_location_id,
       round_even(q, 2) + 0.0 AS quantity_to_prepare,
       CASE WHEN slot_id IS NULL THEN 'missing_stock' ELSE 'ready' END AS status,
       CASE WHEN slot_id IS NOT NULL THEN greatest(1, CAST(round_even(q, 0) AS BIGINT)) END AS pick_quantity
FROM l WHERE q > 0"""

SQL["dated_preparation_order"] = f"""
WITH ahead AS ({with_(*PART_FIT, future(7))} SELECT sku, day, base_yhat, simple_avg, demand_freq FROM future),
tuned AS (SELECT CAST(thr AS DOUBLE) / 1000 AS thr, CAST(alpha AS DOUBLE) / 1000 AS alpha, CAST(mult AS DOUBLE) / 100 AS mult
          FROM ({SQL['tune_threshold']})),
forecast AS (
  SELECT sku, day, CASE WHEN demand_freq >= thr THEN greatest((alpha * base_yhat + (1 - alpha) * simple_avg) * mult, 0) ELSE 0 END AS pred
  FROM ahead CROSS JOIN tuned),
first_slot AS (
  {with_(*PLAN)}
  SELECT a.sku, arg_min(s.slot_id, (ts, event_id)) AS slot_id, arg_min(s.code, (ts, event_id)) AS code
  FROM assigned a JOIN slots s ON s.slot_id = a.slot_id GROUP BY a.sku),
asked AS (
  {with_(EVENTS)}
  SELECT sku, CAST((SELECT min(day) FROM ahead) + CAST(6 - datediff('day', ev.day, last) AS INTEGER) AS DATE) AS day, {r('sum(qty)', 'override_qty', 2)}
  FROM ev CROSS JOIN (SELECT max(day) AS last FROM ev) WHERE direction = 'out' AND datediff('day', ev.day, last) < 7 GROUP BY ALL),
l AS (
  SELECT *, coalesce(override_qty, pred) AS q FROM forecast LEFT JOIN asked USING (sku, day) LEFT JOIN first_slot USING (sku))
SELECT sku, day, round_even(pred, 2) + 0.0 AS predicted_demand, override_qty IS NOT NULL AS override_applied,
       coalesce(code, 'Non stocke') AS source_location, coalesce(slot_id, 0) AS source_location_id,
       round_even(q, 2) + 0.0 AS quantity_to_prepare,
       CASE WHEN slot_id IS NULL THEN 'missing_stock' ELSE 'ready' END AS status,
       CASE WHEN slot_id IS NOT NULL THEN greatest(1, CAST(round_even(q, 0) AS BIGINT)) END AS pick_quantity
FROM l WHERE q > 0"""

SQL["product_features"] = f"""{with_(*LINE_GRID)},
p AS (
  SELECT sku, sum(demand) AS p_total, CAST(sum(has_demand) AS DOUBLE) AS p_days, coalesce(avg(demand) FILTER (demand > 0), 0) AS p_avg,
         avg(has_demand) AS p_freq FROM grid GROUP BY sku),
s AS (SELECT *, p_total / max(p_total) OVER () AS p_demand_score, p_freq / max(p_freq) OVER () AS p_freq_score FROM p),
a AS (
  SELECT p_brand || '|' || p_type AS sku, max(p_type) AS category, max(p_size) AS fardeau, sum(p_size) AS palette,
         round(max(p_retailprice) / 100, 4) AS volume, max(p_size) / 5.0 AS kg, CASE WHEN min(p_size) % 2 = 0 THEN 1.0 ELSE 0.0 END AS gerbable
  FROM part GROUP BY 1),
c AS (SELECT *, dense_rank() OVER (ORDER BY category) - 1 AS code FROM a)
SELECT s.sku, {r('CAST(code AS DOUBLE)', 'cat_enc')}, {r('CAST(fardeau AS DOUBLE)', 'colisage_fardeau')}, {r('CAST(palette AS DOUBLE)', 'colisage_palette')},
       {r('volume', 'volume_pcs')}, {r('CAST(kg AS DOUBLE)', 'poids_kg')}, {r('CAST(gerbable AS DOUBLE)', 'is_gerbable')},
       {r('p_total', 'p_total')}, {r('p_days', 'p_days')}, {r('p_avg', 'p_avg')}, {r('p_freq', 'p_freq')},
       {r('(p_demand_score + p_freq_score) / 2', 'p_prio')}, {r('p_demand_score', 'p_demand_score')}, {r('p_freq_score', 'p_freq_score')}
FROM s LEFT JOIN c USING (sku)"""

# --------------------------------------------------------------- files, streams

SQL["event_file"] = f"""{with_(EVENTS)}
SELECT day, sku, direction, count(*) AS n, CAST(sum(floor(qty)) AS BIGINT) AS qty FROM ev GROUP BY day, sku, direction"""
SQL["stream_congestion"] = f"""{with_(EVENTS, CUSTOMER_SLOTS)}
SELECT day, zone, count(*) AS n, count(*) > 5 AS alert FROM ev JOIN slots ON slot_id = sku WHERE direction <> 'unknown' GROUP BY day, zone"""
SQL["stream_ledger"] = f"""{with_(*WHOLE)}
SELECT o.event_id, o.site, o.sku, o.direction, o.ok, i.event_id AS in_event
FROM led o LEFT JOIN led i ON o.direction = 'out' AND o.ok AND i.direction = 'in' AND i.site = o.site AND i.sku = o.sku
                              AND i.fifo_no = o.fifo_no
WHERE o.direction <> 'unknown'"""
SQL["stream_ledger_keyed"] = SQL["stream_ledger"]
