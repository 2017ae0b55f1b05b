"""The demand queries in SQL, written independently of the Spark plans: the dense
grid is a plain join, windows are plain frames, weighted means are direct sums."""

from __future__ import annotations

from skuflow.functions import holidays as H
from skuflow.operators import features as X

LINES = """
lines AS (
  SELECT l_partkey AS sku, CAST(CAST(l_shipdate AS DATE) + INTERVAL 28 YEAR AS DATE) AS day, l_quantity AS qty
  FROM lineitem)"""
PRODUCT_LINES = """
lines AS (
  SELECT p_brand || '|' || p_type AS sku, CAST(CAST(l_shipdate AS DATE) + INTERVAL 28 YEAR AS DATE) AS day,
         l_quantity AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
DAILY = """
raw_daily AS (SELECT sku, day, greatest(sum(qty), 0) AS demand FROM lines GROUP BY sku, day),
daily AS (
  SELECT sku, day, least(demand, quantile_cont(demand, 0.99) OVER (PARTITION BY sku)) AS demand FROM raw_daily),
bounds AS (SELECT min(day) AS d0, max(day) AS d1, datediff('day', min(day), max(day)) + 1 AS n_days FROM lines),
cal AS (
  SELECT CAST(unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM bounds)"""
GRID = """
grid AS (
  SELECT s.sku, c.day, datediff('day', b.d0, c.day) AS day_no, coalesce(d.demand, 0) AS demand,
         CASE WHEN d.demand > 0 THEN 1 ELSE 0 END AS has_demand
  FROM (SELECT DISTINCT sku FROM daily) s CROSS JOIN cal c CROSS JOIN bounds b
  LEFT JOIN daily d ON d.sku = s.sku AND d.day = c.day)"""
SEGMENTS = """
day_counts AS (SELECT sku, count(*) FILTER (demand > 0) AS demand_days FROM daily GROUP BY sku),
segments AS (
  SELECT sku, demand_days,
         CASE WHEN row_number() OVER (ORDER BY demand_days DESC, sku) <= floor(count(*) OVER () * 0.2)
              THEN 'HF' ELSE 'LF' END AS segment
  FROM day_counts)"""
STATS = """
stats AS (
  SELECT sku, avg(demand) AS prod_avg_demand, median(demand) AS prod_med_demand,
         coalesce(stddev_samp(demand), 1) AS prod_std_demand, count(DISTINCT day) AS prod_n_days
  FROM daily GROUP BY sku)"""
EWM = """
ewm AS (
  SELECT g.sku, g.day,
         sum(p.demand * pow(0.75, g.day_no - 1 - p.day_no)) AS s7,
         sum(p.demand * pow(27.0 / 29.0, g.day_no - 1 - p.day_no)) AS s28
  FROM {rows} g JOIN grid p ON p.sku = g.sku AND p.day < g.day AND p.has_demand = 1
  GROUP BY g.sku, g.day)"""
EWM_7 = "coalesce(s7, 0) * 0.25 / (1 - pow(0.75, day_no))"
EWM_28 = "coalesce(s28, 0) * (2.0 / 29.0) / (1 - pow(27.0 / 29.0, day_no))"
HISTORY = "WINDOW w AS (PARTITION BY sku ORDER BY day)"


def r(expr: str, name: str, digits: int = 4) -> str:
    return f"round({expr} + 1e-9, {digits}) + 0.0 AS {name}"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def frame(w: int) -> str:
    return f"OVER (PARTITION BY sku ORDER BY day ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


PART = (LINES, DAILY)
PART_GRID = (LINES, DAILY, GRID)
LINE_GRID = (PRODUCT_LINES, DAILY, GRID)


def demand_rows(exprs: dict[str, str], *more: str) -> str:
    """Window expressions over the whole grid, returned for the demand rows."""
    inner = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    outer = ", ".join(r(n, n) for n in exprs)
    return (
        f"{with_(*PART_GRID, *more)}, f AS (SELECT sku, day, has_demand, {inner} FROM grid) "
        f"SELECT sku, day, {outer} FROM f WHERE has_demand = 1"
    )


SQL: dict[str, str] = {}

SQL["daily_demand_capped"] = f"{with_(*PART)} SELECT sku, day, {r('demand', 'demand')} FROM daily"
DELIVERIES = """
deliveries AS (
  SELECT l_partkey AS sku, CAST(o_orderdate AS DATE) AS day, count(l_quantity) AS n_deliveries,
         greatest(sum(l_quantity), 0) AS qty_delivered
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2)"""
SQL["delivery_stats"] = f"""{with_(DELIVERIES)}
SELECT sku, CAST(sum(n_deliveries) AS BIGINT) AS del_total_count, sum(qty_delivered) AS del_total_qty,
       count(DISTINCT day) AS del_n_days, {r('avg(qty_delivered)', 'del_avg_qty')}
FROM deliveries GROUP BY sku"""
SQL["demand_grid"] = f"""{with_(*PART_GRID)}
SELECT day, count(*) AS cells, CAST(sum(has_demand) AS BIGINT) AS filled, {r('sum(demand)', 'demand')}
FROM grid GROUP BY day"""
SQL["demand_frequency"] = f"{with_(*PART_GRID)} SELECT sku, {r('avg(has_demand)', 'demand_freq', 6)} FROM grid GROUP BY sku"
SQL["sparsity_profile"] = f"""{with_(*PART_GRID)}, f AS (SELECT sku, avg(has_demand) AS q FROM grid GROUP BY sku)
SELECT count(DISTINCT sku) AS n_skus, count(DISTINCT day) AS n_days, count(*) AS cells,
       count(*) FILTER (demand > 0) AS filled_cells,
       (SELECT count(*) FROM f WHERE q > 0.05) AS high_freq_skus,
       (SELECT count(*) FROM f WHERE q < 0.01) AS low_freq_skus,
       {r('avg(CASE WHEN demand = 0 THEN 1.0 ELSE 0.0 END)', 'sparsity', 6)}
FROM grid"""
SQL["sku_stats"] = f"""{with_(*PART, STATS)}
SELECT sku, {r('prod_avg_demand', 'prod_avg_demand')}, {r('prod_med_demand', 'prod_med_demand')},
       {r('prod_std_demand', 'prod_std_demand')}, prod_n_days FROM stats"""
SQL["sku_totals_topk"] = f"""{with_(*PART)}
SELECT sku, {r('sum(demand)', 'total_demand')}, count(*) AS n_demand_days FROM daily GROUP BY sku
ORDER BY total_demand DESC, sku LIMIT 15"""
SQL["baseline_candidates"] = f"""{with_(*PART)}
SELECT sku, CASE WHEN count(*) >= 25 THEN 'fitted' ELSE 'average' END AS kind FROM daily GROUP BY sku"""
SQL["demand_summary"] = f"""{with_(*PART)}
SELECT count(demand) AS n, {r('avg(demand)', 'mean')}, {r('stddev_samp(demand)', 'std')}, {r('min(demand)', 'min')},
       {r('quantile_cont(demand, 0.25)', 'q1')}, {r('median(demand)', 'median')},
       {r('quantile_cont(demand, 0.75)', 'q3')}, {r('max(demand)', 'max')} FROM daily"""
SQL["segment_counts"] = f"{with_(*PART, SEGMENTS)} SELECT segment, count(*) AS n FROM segments GROUP BY segment"
SQL["sku_segments"] = f"{with_(*PART, SEGMENTS)} SELECT sku, demand_days, segment FROM segments"

_lags = {f"lag_{n}": f"lag(demand, {n}) OVER (PARTITION BY sku ORDER BY day)" for n in X.LAGS}
_wday = " + ".join(f"coalesce(lag(demand, {n}) OVER (PARTITION BY sku ORDER BY day), 0)" for n in (7, 14, 21, 28))
SQL["lag_features"] = demand_rows(
    _lags | {"lag_w1": _lags["lag_7"], "lag_w2": _lags["lag_14"], "lag_w4": _lags["lag_28"], "rmean_wday4": f"({_wday}) / 4"}
)
SQL["rolling_features"] = demand_rows(
    {f"rmean_{w}": f"avg(demand) {frame(w)}" for w in X.MEAN_WINDOWS}
    | {f"rstd_{w}": f"coalesce(stddev_samp(demand) {frame(w)}, 0)" for w in X.MEAN_WINDOWS}
)
SQL["rolling_extremes"] = demand_rows(
    {f"r{f}_{w}": f"{f}(demand) {frame(w)}" for f in ("max", "min", "sum") for w in X.EXTREME_WINDOWS}
)
SQL["rolling_median"] = demand_rows({f"rmed_{w}": f"median(demand) {frame(w)}" for w in X.EXTREME_WINDOWS})
SQL["freq_features"] = demand_rows({f"dfreq_{w}": f"avg(has_demand) {frame(w)}" for w in X.FREQ_WINDOWS})
_latest = (
    "max(CASE WHEN has_demand = 1 THEN day_no END) "
    "OVER (PARTITION BY sku ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND {n} PRECEDING)"
)
SQL["days_since"] = demand_rows(
    {
        "days_since": f"CAST(coalesce(day_no - 1 - {_latest.format(n=2)}, 999) AS DOUBLE)",
        "days_since_last": f"CAST(coalesce(day_no - {_latest.format(n=1)}, 999) AS DOUBLE)",
    }
)
_ROWS = "(SELECT * FROM grid WHERE has_demand = 1)"
SQL["ewm_features"] = f"""{with_(*PART_GRID, EWM.format(rows=_ROWS))}
SELECT g.sku, g.day, {r(f'CASE WHEN day_no > 0 THEN {EWM_7} END', 'ewm_7')},
       {r(f'CASE WHEN day_no > 0 THEN {EWM_28} END', 'ewm_28')}
FROM grid g LEFT JOIN ewm USING (sku, day) WHERE has_demand = 1"""
_mean = "(prod_avg_demand + 1e-6)"
SQL["ratio_features"] = f"""{with_(*PART_GRID, STATS, EWM.format(rows=_ROWS))},
f AS (
  SELECT sku, day, day_no, has_demand, lag(demand, 1) OVER (PARTITION BY sku ORDER BY day) AS lag_1,
         avg(demand) {frame(7)} AS rmean_7, avg(demand) {frame(28)} AS rmean_28,
         coalesce(stddev_samp(demand) {frame(28)}, 0) AS rstd_28, ({_wday}) / 4 AS rmean_wday4
  FROM grid)
SELECT f.sku, f.day, {r('rstd_28 / (rmean_28 + 1e-6)', 'cv_28')}, {r(f'lag_1 / {_mean}', 'lag1_norm')},
       {r(f'rmean_7 / {_mean}', 'rmean7_norm')}, {r(f'rmean_28 / {_mean}', 'rmean28_norm')},
       {r(f'CASE WHEN day_no > 0 THEN {EWM_7} / {_mean} END', 'ewm7_norm')},
       {r(f'CASE WHEN day_no > 0 THEN {EWM_28} / {_mean} END', 'ewm28_norm')},
       {r(f'rmean_wday4 / {_mean}', 'rmean_wday4_norm')}
FROM f JOIN stats USING (sku) LEFT JOIN ewm ON ewm.sku = f.sku AND ewm.day = f.day WHERE has_demand = 1"""
_SHIFTED_DELIVERIES = DELIVERIES.replace(
    "CAST(o_orderdate AS DATE) AS day", "CAST(CAST(o_orderdate AS DATE) + INTERVAL 28 YEAR AS DATE) AS day"
)
_del = {"n_deliveries": "n_deliveries", "qty_delivered": "qty_delivered"}
_del |= {f"del_rolling_{w}": f"sum(n_deliveries) {frame(w)}" for w in (7, 14, 28)}
_del |= {f"del_qty_rolling_{w}": f"sum(qty_delivered) {frame(w)}" for w in (7, 28)}
SQL["delivery_rolling"] = f"""{with_(*PART_GRID, _SHIFTED_DELIVERIES)},
full_grid AS (
  SELECT g.sku, g.day, has_demand, CAST(coalesce(n_deliveries, 0) AS DOUBLE) AS n_deliveries,
         coalesce(qty_delivered, 0) AS qty_delivered
  FROM grid g LEFT JOIN deliveries USING (sku, day)),
f AS (SELECT sku, day, has_demand, {", ".join(f"{e} AS {n}" for n, e in _del.items())} FROM full_grid)
SELECT sku, day, {", ".join(r(n, n) for n in _del)} FROM f WHERE has_demand = 1"""

_cal = {
    "dow": "isodow(day) - 1", "month": "month(day)", "week": "week(day)", "dom": "day(day)", "qtr": "quarter(day)",
    "is_wknd": "CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END", "is_month_start": "CASE WHEN day(day) <= 3 THEN 1 ELSE 0 END",
    "is_month_end": "CASE WHEN day(day) >= 28 THEN 1 ELSE 0 END", "is_week_start": "CASE WHEN isodow(day) = 1 THEN 1 ELSE 0 END",
    "is_first_of_month": "CASE WHEN day(day) = 1 THEN 1 ELSE 0 END",
    "is_last_of_month": "CASE WHEN day = last_day(day) THEN 1 ELSE 0 END",
    "day_idx": "datediff('day', d0, day)", "day_idx_sq": "pow(datediff('day', d0, day), 2) / 1e6",
}
for _n, _angle, _ks in (
    ("y", "dayofyear(day) / 365.25", (1, 2, 3, 4)),
    ("w", "(isodow(day) - 1) / 7.0", (1, 2)),
    ("m", "day(day) / 31.0", (1, 2)),
):
    for _k in _ks:
        for _f in ("sin", "cos"):
            _cal[f"fourier_{_f}_{_n}{_k}"] = f"{_f}(2 * pi() * {_k} * CAST({_angle} AS DOUBLE))"
SQL["calendar_features"] = f"""{with_(*PART)}, per_day AS (SELECT day, sum(qty) AS qty FROM lines GROUP BY day)
SELECT day, qty, {", ".join(r(f"CAST({e} AS DOUBLE)", n, 6) for n, e in _cal.items())} FROM per_day CROSS JOIN bounds"""


# ------------------------------------------------------------------ holidays

HOLIDAYS = (
    "movable AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{h}', DATE '{d}')" for h, ds in H.MOVABLE.items() for d in ds)
    + ") AS t(holiday, d)),\nnational AS (SELECT * FROM (VALUES "
    + ", ".join(f"({m}, {d}, '{n}')" for m, d, n in H.NATIONAL_DAYS)
    + ") AS t(m, d, holiday)),\nperiods AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{e}', '{h}', {a}, {b})" for e, h, a, b in H.PERIODS)
    + ") AS t(event, holiday, a, b))"
)
EVENTS = f"""
events_of AS (
  SELECT event AS holiday, CAST(unnest(generate_series(d + a * INTERVAL 1 DAY, d + b * INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS ds
  FROM movable JOIN periods USING (holiday)
  UNION ALL
  SELECT holiday, make_date(y, m, d) FROM national CROSS JOIN range({H.FIRST_YEAR}, {H.LAST_YEAR + 1}) AS t(y))"""
SQL["holiday_events"] = f"""{with_(LINES, HOLIDAYS, EVENTS)},
per_day AS (SELECT day, sum(qty) AS qty, count(*) AS n FROM lines GROUP BY day)
SELECT holiday, ds, 0 AS lower_window, 0 AS upper_window, coalesce(qty, 0) AS qty, coalesce(n, 0) AS n_lines
FROM events_of LEFT JOIN per_day ON ds = day"""


def _flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"


_near = """{n} AS (
  SELECT c.day, arg_min(m.d, abs(datediff('day', c.day, m.d)) * 100000 + datediff('day', DATE '2000-01-01', m.d)) AS d
  FROM cal c CROSS JOIN movable m WHERE m.holiday = '{h}' GROUP BY c.day)"""
HOLIDAY_DAYS = ",".join(
    [
        _near.format(n=n, h=h)
        for n, h in (("nf", "eid_al_fitr"), ("na", "eid_al_adha"), ("nm", "mawlid"), ("ny", "islamic_new_year"), ("ns", "ashura"))
    ]
    + [
        """
nat AS (
  SELECT c.day, min(datediff('day', c.day, h)) FILTER (h > c.day) AS gap, max(CASE WHEN h = c.day THEN 1 ELSE 0 END) AS today
  FROM cal c CROSS JOIN (
    SELECT make_date(y, m, d) AS h FROM national CROSS JOIN range(2022, 2032) AS t(y)) x
  WHERE h BETWEEN c.day AND c.day + INTERVAL 400 DAY GROUP BY c.day)""",
        """
ram AS (
  SELECT c.day, datediff('day', t.d, c.day) + 1 AS day_in, datediff('day', c.day, t.d) AS to_this,
         datediff('day', c.day, n.d) AS to_next, datediff('day', p.d, c.day) - 29 AS since_prev
  FROM cal c
  LEFT JOIN movable t ON t.holiday = 'ramadan' AND year(t.d) = year(c.day)
  LEFT JOIN movable n ON n.holiday = 'ramadan' AND year(n.d) = year(c.day) + 1
  LEFT JOIN movable p ON p.holiday = 'ramadan' AND year(p.d) = year(c.day) - 1)""",
        f"""
gaps AS (
  SELECT cal.day, CASE WHEN day_in BETWEEN 1 AND 30 THEN day_in ELSE 0 END AS din,
         CASE WHEN to_this > 0 THEN to_this WHEN to_next > 0 THEN to_next ELSE 999 END AS to_r,
         CASE WHEN day_in > 30 THEN day_in - 30 WHEN since_prev > 0 THEN since_prev ELSE 999 END AS since_r,
         datediff('day', cal.day, nf.d) AS f, datediff('day', cal.day, na.d) AS a, cal.day = nm.d AS m, cal.day = ny.d AS y,
         datediff('day', ns.d, cal.day) AS s, coalesce(nat.gap, 999) AS g, nat.today AS nd
  FROM cal JOIN ram USING (day) JOIN nf USING (day) JOIN na USING (day) JOIN nm USING (day) JOIN ny USING (day)
  JOIN ns USING (day) JOIN nat USING (day) WHERE year(cal.day) BETWEEN {H.FIRST_YEAR} AND {H.LAST_YEAR}),
hol AS (
  SELECT day, {_flag('din > 0')} AS is_ramadan, din AS ramadan_day, din / 30.0 AS ramadan_progress,
         least(to_r, 60) AS days_to_ramadan, least(since_r, 60) AS days_since_ramadan,
         {_flag('to_r BETWEEN 1 AND 14')} AS ramadan_prep, {_flag('din > 23')} AS ramadan_last_week,
         {_flag('f BETWEEN -2 AND 0')} AS is_eid_fitr, least(greatest(f, 0), 30) AS days_to_eid_fitr,
         {_flag('f BETWEEN 1 AND 7')} AS eid_fitr_prep,
         {_flag('a BETWEEN -2 AND 0')} AS is_eid_adha, least(greatest(a, 0), 30) AS days_to_eid_adha,
         {_flag('a BETWEEN 1 AND 10')} AS eid_adha_prep,
         {_flag('m')} AS is_mawlid, {_flag('y')} AS is_islamic_new_year, {_flag('s BETWEEN 0 AND 1')} AS is_ashura,
         {_flag('nd = 1')} AS is_national_holiday, least(g, 30) AS days_to_national_holiday,
         {_flag('nd = 1 OR f BETWEEN -2 AND 0 OR a BETWEEN -2 AND 0 OR m OR y')} AS is_any_holiday,
         {_flag('f BETWEEN 1 AND 3 OR a BETWEEN 1 AND 3 OR g BETWEEN 1 AND 3')} AS pre_holiday_3d
  FROM gaps)""",
    ]
)
SQL["holiday_features"] = f"""{with_(*PART, HOLIDAYS, HOLIDAY_DAYS)},
per_day AS (SELECT day, sum(qty) AS qty FROM lines GROUP BY day)
SELECT day, qty, {", ".join(r(f"CAST({f} AS DOUBLE)", f, 6) for f in H.HOLIDAY_FEATURES)}
FROM per_day LEFT JOIN hol USING (day)"""

SQL["category_codes"] = """
WITH codes AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS DOUBLE) AS cat_enc
               FROM (SELECT DISTINCT p_type AS category FROM part))
SELECT category, cat_enc, count(*) AS n_skus FROM part JOIN codes ON p_type = category GROUP BY 1, 2"""
_base_of = {
    "lag_1": "lag(demand, 1) OVER (PARTITION BY sku ORDER BY day)",
    "rmean_7": f"avg(demand) {frame(7)}",
    "dfreq_7": f"avg(has_demand) {frame(7)}",
    "days_since": f"CAST(coalesce(day_no - 1 - {_latest.format(n=2)}, 999) AS DOUBLE)",
    "dow": "isodow(day) - 1",
    "month": "month(day)",
    "is_wknd": _flag("isodow(day) >= 6"),
}
_hf = {n: c for n, c in X.HF_INTERACTIONS.items() if n != "hf_x_base"}
SQL["hf_interactions"] = f"""{with_(*PART_GRID, SEGMENTS, HOLIDAYS, HOLIDAY_DAYS)},
f AS (SELECT sku, day, has_demand, {", ".join(f"{e} AS {n}" for n, e in _base_of.items())} FROM grid)
SELECT f.sku, f.day,
  {", ".join(r(f"CASE WHEN segment = 'HF' THEN coalesce({c}, 0) ELSE 0 END", n) for n, c in _hf.items())}
FROM f JOIN segments USING (sku) LEFT JOIN hol ON hol.day = f.day WHERE has_demand = 1"""


# ------------------------------------------------------------------ baseline

FIT = f"""
classed AS (
  SELECT g.sku, g.day, g.day_no AS t, g.demand AS y, isodow(g.day) - 1 AS dow, month(g.day) AS month,
         CASE WHEN e.ds IS NULL THEN 0 ELSE 1 END AS hol
  FROM grid g LEFT JOIN (SELECT DISTINCT ds FROM events_of) e ON e.ds = g.day),
line AS (SELECT sku, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, avg(y) AS mean_y FROM classed GROUP BY sku),
c1 AS (SELECT *, greatest(intercept + slope * t, 0.1 * mean_y) AS trend FROM classed JOIN line USING (sku)),
c2 AS (SELECT *, y / trend AS r FROM c1),
weekly AS (
  SELECT sku, dow, CASE WHEN avg(avg(r)) OVER p = 0 THEN 1.0 ELSE avg(r) / ((sum(sum(r)) OVER p) / (sum(count(*)) OVER p)) END AS w
  FROM c2 GROUP BY sku, dow WINDOW p AS (PARTITION BY sku)),
c3 AS (SELECT *, coalesce(r / nullif(w, 0), 0) AS r2 FROM c2 JOIN weekly USING (sku, dow)),
yearly AS (
  SELECT sku, month, CASE WHEN avg(avg(r2)) OVER p = 0 THEN 1.0 ELSE avg(r2) / ((sum(sum(r2)) OVER p) / (sum(count(*)) OVER p)) END AS m
  FROM c3 GROUP BY sku, month WINDOW p AS (PARTITION BY sku)),
c4 AS (SELECT *, coalesce(r2 / nullif(m, 0), 0) AS r3 FROM c3 JOIN yearly USING (sku, month)),
holiday AS (
  SELECT sku, hol, CASE WHEN avg(avg(r3)) OVER p = 0 THEN 1.0 ELSE avg(r3) / ((sum(sum(r3)) OVER p) / (sum(count(*)) OVER p)) END AS h
  FROM c4 GROUP BY sku, hol WINDOW p AS (PARTITION BY sku)),
raw AS (
  SELECT sku, day, t, y, trend, w, m, greatest(0, trend * w * m * h) AS raw FROM c4 JOIN holiday USING (sku, hol)),
cal_factor AS (
  SELECT sku, CASE WHEN avg(raw) FILTER (y > 0) > 0.01
                   THEN least(greatest(avg(y) FILTER (y > 0) / avg(raw) FILTER (y > 0), 0.2), 5.0) ELSE 1.0 END AS cal_factor
  FROM raw GROUP BY sku),
fitted AS (SELECT sku FROM daily GROUP BY sku HAVING count(*) >= 10),
average AS (SELECT sku, coalesce(avg(demand) FILTER (demand > 0), 0) AS simple_avg FROM daily GROUP BY sku),
base AS (
  SELECT raw.sku, raw.day, y, CASE WHEN f.sku IS NULL THEN simple_avg ELSE raw * cal_factor END AS base_yhat,
         CASE WHEN f.sku IS NULL THEN 0 ELSE trend END AS base_trend,
         CASE WHEN f.sku IS NULL THEN 0 ELSE w - 1 END AS base_weekly,
         CASE WHEN f.sku IS NULL THEN 0 ELSE m - 1 END AS base_yearly
  FROM raw JOIN cal_factor USING (sku) JOIN average USING (sku) LEFT JOIN fitted f ON f.sku = raw.sku)"""
LINE_FIT = (*LINE_GRID, HOLIDAYS, EVENTS, FIT)
PART_FIT = (*PART_GRID, HOLIDAYS, EVENTS, FIT)
SQL["baseline_parameters"] = f"""{with_(*LINE_FIT)},
classes AS (
  SELECT sku, 'dow' AS level, dow AS class, w AS idx FROM weekly UNION ALL
  SELECT sku, 'month', month, m FROM yearly UNION ALL SELECT sku, 'hol', hol, h FROM holiday)
SELECT sku, level, class, {r('idx', 'idx')}, {r('slope', 'slope', 6)}, {r('intercept', 'intercept')}
FROM classes JOIN line USING (sku)"""
_b = ("base_yhat", "base_trend", "base_weekly", "base_yearly")
SQL["baseline_components"] = f"{with_(*LINE_FIT)} SELECT sku, day, {', '.join(r(c, c, 3) for c in _b)} FROM base WHERE y > 0"
SQL["baseline_calibrated"] = f"""{with_(*LINE_FIT, SEGMENTS)}
SELECT sku, segment, {r('avg(base_yhat)', 'mean_yhat')}, {r('any_value(cal_factor)', 'cal_factor')},
       {r('avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END)', 'demand_freq')},
       {r('(arg_max(base_trend, day) - arg_min(base_trend, day)) / count(*)', 'trend_slope', 6)}
FROM base JOIN fitted USING (sku) JOIN cal_factor USING (sku) JOIN segments USING (sku) GROUP BY sku, segment"""
SQL["baseline_features"] = f"""{with_(*LINE_FIT, STATS)},
f AS (
  SELECT base.*, lag(y - base_yhat) OVER (PARTITION BY sku ORDER BY day) AS base_resid_lag1,
         avg(y - base_yhat) {frame(7)} AS base_resid_rmean7, base_yhat / {_mean} AS base_ratio,
         base_trend / ({_mean} + 1e-6) AS base_trend_norm, abs(base_weekly) AS base_weekly_abs,
         abs(base_yearly) AS base_yearly_abs, abs(base_weekly) + abs(base_yearly) AS base_seasonal_str
  FROM base JOIN stats USING (sku))
SELECT sku, day, {', '.join(r(c, c, 3) for c in ('base_ratio', 'base_resid_lag1', 'base_resid_rmean7', 'base_trend_norm',
'base_weekly_abs', 'base_yearly_abs', 'base_seasonal_str'))} FROM f WHERE y > 0"""

# ---------------------------------------------------------------- evaluation

EVALUATION = (
    *LINE_FIT,
    SEGMENTS,
    """
lagged AS (SELECT *, lag(demand) OVER (PARTITION BY sku ORDER BY day) AS lag_1 FROM grid)""",
    EWM.format(rows="(SELECT grid.* FROM grid JOIN bounds ON day > d1 - INTERVAL 30 DAY)"),
    f"""
test AS (
  SELECT sku, day, datediff('day', d1, day) + 29 AS no, segment, demand AS actual, lag_1, {EWM_7} AS ewm_7, base_yhat
  FROM lagged JOIN segments USING (sku) JOIN base USING (sku, day) LEFT JOIN ewm USING (sku, day)
  JOIN bounds ON day > d1 - INTERVAL 30 DAY)""",
)
_models = {"lag_1": "lag_1", "ewm_7": "ewm_7", "baseline": "base_yhat"}
_models |= {f"blend_{a}": f"{a} * base_yhat + (1 - {a}) * ewm_7" for a in (0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0)}
_long = "long AS (" + " UNION ALL ".join(
    f"SELECT sku, day, no, actual, '{n}' AS model, coalesce({e}, 0) AS pred FROM test" for n, e in _models.items()
) + ")"
WAPE = "sum(abs(actual - pred)) / sum(actual) * 100"
BIAS = "(sum(pred) - sum(actual)) / sum(actual) * 100"
_DD = "FILTER (actual > 0)"
SQL["wape_models"] = f"""{with_(*EVALUATION, _long)}
SELECT model, {r(f'sum(abs(actual - pred)) {_DD} / sum(actual) {_DD} * 100', 'wape_dd', 3)},
       {r(f'(sum(pred) {_DD} - sum(actual) {_DD}) / sum(actual) {_DD} * 100', 'bias_dd', 3)},
       {r(WAPE, 'wape_grid', 3)}, {r(BIAS, 'bias_grid', 3)}, count(*) {_DD} AS n_demand, count(*) AS n_rows
FROM long GROUP BY model"""
_sums = "sums AS (SELECT {k}, sku, no // 10 AS win, sum(actual) AS actual, sum(pred) AS pred FROM {t} GROUP BY ALL HAVING sum(actual) > 0)"
SQL["wape_10d"] = f"""{with_(*EVALUATION, _long, _sums.format(k='model', t='long'))}
SELECT model, {r(WAPE, 'wape_10d', 3)}, {r(BIAS, 'bias_10d', 3)} FROM sums GROUP BY model"""
SQL["wape_segment"] = f"""{with_(*EVALUATION, 'rated AS (SELECT *, base_yhat AS pred FROM test)',
_sums.format(k='segment', t='rated'))},
horizon AS (SELECT segment, {WAPE} AS wape_10d FROM sums GROUP BY segment),
daily_scores AS (
  SELECT coalesce(segment, 'ALL') AS segment, {WAPE} AS wape_dd, {BIAS} AS bias_dd, count(*) AS n_demand
  FROM rated WHERE actual > 0 GROUP BY ROLLUP (segment))
SELECT segment, {r('wape_dd', 'wape_dd', 3)}, {r('bias_dd', 'bias_dd', 3)}, {r('wape_10d', 'wape_10d', 3)}, n_demand
FROM daily_scores LEFT JOIN horizon USING (segment)"""
SQL["lag1_accuracy"] = f"""{with_(*PART_GRID)},
f AS (SELECT demand AS actual, coalesce(lag(demand) OVER (PARTITION BY sku ORDER BY day), 0) AS pred FROM grid)
SELECT {r(WAPE, 'wape', 3)}, {r(BIAS, 'bias', 3)}, count(*) AS n_rows FROM f WHERE actual > 0"""
PSEUDO = "scored AS (SELECT sku, day, has_demand AS label, ((sku * 31 + day_no * 17) % 1000) / 1000.0 AS score FROM grid)"
SQL["auc_exact"] = f"""{with_(*PART_GRID, PSEUDO)},
c AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
x AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score) - neg / 2.0 AS below FROM c)
SELECT {r('CAST(sum(pos * below) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))', 'auc', 6)},
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM x"""
SQL["confusion"] = f"""{with_(*PART_GRID, PSEUDO)},
c AS (
  SELECT count(*) FILTER (score >= 0.4 AND label = 1) AS tp, count(*) FILTER (score >= 0.4 AND label = 0) AS fp,
         count(*) FILTER (score < 0.4 AND label = 1) AS fn, count(*) FILTER (score < 0.4 AND label = 0) AS tn FROM scored)
SELECT tp, fp, fn, tn, {r('tp / greatest(tp + fp, 1)', 'precision', 6)}, {r('tp / greatest(tp + fn, 1)', 'recall', 6)} FROM c"""
