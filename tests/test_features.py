import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skuflow.operators import demand as D
from skuflow.operators import features as X
from skuflow.operators import grid as G

D0 = date(2023, 1, 1)
ALL = [X.LAG, X.SAME_WEEKDAY, X.MOMENTS, X.EXTREMES, X.SUMS, X.MEDIANS, X.FREQUENCY, X.DAYS_SINCE, X.EWM]


def series(n_days=200, seed=3, density=0.3):
    rng = random.Random(seed)
    a = {d: float(rng.randrange(1, 50)) for d in range(n_days) if rng.random() < density}
    a.setdefault(0, 5.0), a.setdefault(n_days - 1, 7.0)
    return {"a": a, "b": {40: 9.0}}


def grid_of(spark, data):
    rows = [(s, D0 + timedelta(days=d), q) for s, v in data.items() for d, q in v.items()]
    daily = D.daily_demand(spark.createDataFrame(rows, "sku string, day date, qty double"))
    start, end = G.day_bounds(daily)
    return G.demand_grid(D.spread_by_sku(daily, 3), start, end)


def expected(values: dict, n: int) -> pd.DataFrame:
    y = pd.Series([values.get(i, 0.0) for i in range(n)])
    past, out = y.shift(1), {}
    for k in X.LAGS:
        out[f"lag_{k}"] = y.shift(k)
    for w in X.MEAN_WINDOWS:
        roll = past.rolling(w, min_periods=1)
        out[f"rmean_{w}"], out[f"rstd_{w}"] = roll.mean(), roll.std().fillna(0)
    for w in X.EXTREME_WINDOWS:
        roll = past.rolling(w, min_periods=1)
        out |= {f"rmax_{w}": roll.max(), f"rmin_{w}": roll.min(), f"rmed_{w}": roll.median(), f"rsum_{w}": roll.sum()}
    for w in X.FREQ_WINDOWS:
        out[f"dfreq_{w}"] = (past > 0).astype(float).where(past.notna()).rolling(w, min_periods=1).mean()
    for s in (7, 28):
        out[f"ewm_{s}"] = past.ewm(span=s, min_periods=1).mean()
    had, since, last = [v > 0 for v in y], [], None
    for i in range(n):
        if i >= 2 and had[i - 2]:
            last = i - 2
        since.append(999.0 if last is None else float(i - 1 - last))
    out["days_since"] = pd.Series(since)
    return pd.DataFrame(out)


@pytest.mark.parametrize("n_days,density", [(200, 0.3), (2600, 0.1), (120, 0.9)])
def test_features_equal_pandas(spark, n_days, density):
    data = series(n_days, density=density)
    got = X.add(grid_of(spark, data), *ALL).toPandas().sort_values(["sku", "day"])
    assert len(got) == 2 * n_days
    for sku, values in data.items():
        mine = got[got.sku == sku].reset_index(drop=True)
        want = expected(values, n_days)
        for c in want.columns:
            np.testing.assert_allclose(
                mine[c].astype(float), want[c].astype(float), rtol=1e-7, atol=1e-6, equal_nan=True, err_msg=f"{sku} {c}"
            )


def test_no_leakage(spark):
    data = series(150)
    changed = {s: dict(v) for s, v in data.items()}
    changed["a"][100] = 1000.0
    before, after = (X.add(grid_of(spark, d), *ALL).toPandas().sort_values(["sku", "day"]) for d in (data, changed))
    cols = [c for c in before.columns if c not in ("demand", "has_demand")]
    upto = lambda p: p[p.day_no <= 100][cols].reset_index(drop=True)
    pd.testing.assert_frame_equal(upto(before), upto(after))
    assert not before.equals(after)


def test_full_feature_set_needs_few_windows_and_shuffles(spark):
    plan = X.add(grid_of(spark, series()), *ALL)._jdf.queryExecution().executedPlan().toString()
    # one to fill the gaps, four for all features
    assert plan.count("Window [") == 5
    assert plan.count("Exchange hashpartitioning") <= 3


def test_percentile_cap(spark):
    rows = [("a", D0 + timedelta(days=i), q) for i, q in enumerate([1.0, 2.0, 10.0])]
    daily = spark.createDataFrame(rows, "sku string, day date, demand double")
    top = D.capped_daily(daily).agg(F.max("demand")).first()[0]
    assert top == pytest.approx(9.84)
    early = D.capped_daily(daily, fit_until=F.lit(D0 + timedelta(days=1))).agg(F.max("demand")).first()[0]
    assert early == pytest.approx(1.99)


def test_negative_totals_become_zero(spark):
    df = spark.createDataFrame([("a", D0, -5.0), ("a", D0, 2.0)], "sku string, day date, qty double")
    assert D.daily_demand(df).first().demand == 0.0


def test_deliveries_merge_onto_demand_calendar_only(spark):
    daily = spark.createDataFrame([("a", D0, 1.0), ("a", D0 + timedelta(days=4), 2.0)], "sku string, day date, demand double")
    dels = spark.createDataFrame(
        [("a", D0 + timedelta(days=2), 3, 9.0), ("a", D0 - timedelta(days=2), 1, 1.0), ("z", D0, 1, 1.0)],
        "sku string, day date, n_deliveries long, qty_delivered double",
    )
    start, end = G.day_bounds(daily)
    facts = G.merge_facts(daily, dels, start, end)
    got = G.demand_grid(facts, start, end, ("demand", "n_deliveries", "qty_delivered")).orderBy("day").collect()
    assert [(r.demand, r.n_deliveries, r.qty_delivered) for r in got] == [
        (1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 3.0, 9.0), (0.0, 0.0, 0.0), (2.0, 0.0, 0.0)]


def test_segments_cut_inside_a_tie(spark):
    rows = [(i, D0 + timedelta(days=d), 1.0) for i in range(10) for d in range(2 if i < 5 else 1)]
    daily = spark.createDataFrame(rows, "sku int, day date, demand double")
    hf = {r.sku for r in D.segments(daily).where("segment = 'HF'").collect()}
    assert hf == {0, 1}


def test_moments_survive_level_shifts_fractions_and_near_constant_series(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    n = 400
    series = {
        "shift6": np.where(np.arange(n) < 200, 1e6, 1.0) + rng.integers(0, 2, n),
        "shift7": np.where(np.arange(n) < 200, 1e7, 1.0) + rng.random(n),
        "near": 1000 + 0.03 * rng.random(n),
        "constant": np.full(n, 0.1),
        "fraction": rng.random(n) / 7,
        "rare": np.where(rng.random(n) < 0.05, rng.random(n) * 100, 0.0),
    }
    rows = [(k, date(2024, 1, 1) + timedelta(days=i), i, float(v), 1 if v > 0 else 0, float(v), float(v), 0) for k, s in series.items() for i, v in enumerate(s)]
    grid = spark.createDataFrame(rows, "sku string, day date, day_no int, demand double, has_demand int, n_deliveries double, qty_delivered double, epoch int")
    got = X.add(grid, X.MOMENTS, X.SUMS, X.FREQUENCY, X.DELIVERY_ROLLING).toPandas().sort_values("day_no")
    for k, s in series.items():
        mine, past = got[got.sku == k], pd.Series(s).shift(1)
        for w in X.MEAN_WINDOWS:
            frame = past.rolling(w, min_periods=1)
            # deviations one by one: pandas' own rolling deviation loses digits here
            std = past.rolling(w, min_periods=1).apply(lambda x: np.std(x[~np.isnan(x)], ddof=1) if (~np.isnan(x)).sum() > 1 else 0.0, raw=True)
            mean = past.rolling(w, min_periods=1).apply(lambda x: np.mean(x[~np.isnan(x)]), raw=True)
            assert np.allclose(mine[f"rmean_{w}"].to_numpy(float)[1:], mean[1:], rtol=1e-9, atol=1e-12), (k, w, frame)
            assert np.allclose(mine[f"rstd_{w}"].to_numpy(float)[1:], std[1:], rtol=1e-9, atol=1e-9), (k, w)
        for w in X.EXTREME_WINDOWS:
            total = past.rolling(w, min_periods=1).apply(np.nansum, raw=True)
            assert np.allclose(mine[f"rsum_{w}"].to_numpy(float)[1:], total[1:], rtol=1e-12)
            assert (mine[f"rsum_{w}"].to_numpy(float)[1:] >= 0).all()
        for w in X.FREQ_WINDOWS:
            share = (past > 0).where(past.notna()).astype(float).rolling(w, min_periods=1).mean()
            assert np.allclose(mine[f"dfreq_{w}"].to_numpy(float)[1:], share[1:], rtol=1e-12)
