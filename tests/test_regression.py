"""The regression baseline against a dense solver over the full grid of every SKU."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuflow.operators import regression as R

START = date(2024, 1, 1)
N = 420


def _demand(spark):
    rng, rows = random.Random(2), []
    for sku in (1, 2, 3, None):
        for t in range(N):
            if rng.random() < 0.3:
                day = START + timedelta(days=t)
                rows.append((sku, day, 5.0 + 0.01 * t * (sku or 0) + 3.0 * (day.weekday() == 2) + rng.random()))
    rows += [(9, START + timedelta(days=k), 2.0) for k in range(4)]  # too few days
    rows += [(1, START - timedelta(days=3), 99.0), (2, START + timedelta(days=N + 5), 99.0)]  # outside the calendar
    return spark.createDataFrame(rows, "sku long, day date, demand double"), rows


@pytest.fixture(scope="module")
def case(spark):
    daily, rows = _demand(spark)
    days = spark.createDataFrame([(START + timedelta(days=t),) for t in range(N)], "day date")
    start = F.lit(START)
    calendar, made = R.calendar_design(days, start, N)
    x = {r["day"]: r["x"] for r in calendar.collect()}
    return daily, rows, days, start, calendar, made, x


def test_coefficients_equal_a_dense_solver(case):
    daily, rows, days, start, _, made, x = case
    got = {r["sku"]: r["beta"] for r in R.fit(daily, days, start).coefficients.collect()}
    assert set(got) == {1, 2, 3, None}
    order = sorted(x)
    grid = np.array([x[d] for d in order])
    ridge = np.sqrt([R.RIDGE[k] for k in made.kinds])
    for sku, beta in got.items():
        sold = {d: q for s, d, q in rows if s == sku}
        y = np.array([sold.get(d, 0.0) for d in order])  # the dense series
        want = np.linalg.lstsq(np.vstack([grid, np.diag(ridge)]), np.append(y, np.zeros(len(ridge))), rcond=None)[0]
        np.testing.assert_allclose(grid @ np.array(beta), grid @ want, atol=1e-6)


def test_predictions_are_their_parts_and_not_negative(case):
    daily, _, days, start, calendar, made, x = case
    fitted = R.fit(daily, days, start)
    beta = {r["sku"]: np.array(r["beta"]) for r in fitted.coefficients.collect()}
    rows = daily.where("sku IN (1, 3, 9)").select("sku", "day")
    for r in R.predict(fitted, rows, calendar).collect():
        if r["sku"] == 9 or r["day"] not in x:
            assert r["yhat"] is None
            continue
        whole = float(beta[r["sku"]] @ np.array(x[r["day"]]))
        assert r["yhat"] == pytest.approx(max(0.0, whole))
        assert sum(r[p] for p in R.PARTS) == pytest.approx(whole)


def test_no_demand(spark, case):
    daily, _, days, start, *_ = case
    assert R.fit(daily.limit(0), days, start).coefficients.count() == 0


def test_products_of_a_prediction_are_made_once(case):
    daily, _, days, start, calendar, *_ = case
    fitted = R.fit(daily, days, start)
    plan = R.predict(fitted, daily.select("sku", "day"), calendar)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(beta") == 1
