from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_features import D0, series

from skuflow.operators import demand as D
from skuflow.operators import features as X
from skuflow.operators import grid as G
from skuflow.operators import sparse_features as Y

NAMES = ["LAG", "SAME_WEEKDAY", "MOMENTS", "EXTREMES", "SUMS", "MEDIANS", "FREQUENCY", "DAYS_SINCE", "EWM"]


def both(spark, data, names, measures=("demand",)):
    rows = [(s, D0 + timedelta(days=d), q) for s, v in data.items() for d, q in v.items()]
    daily = spark.createDataFrame(rows, "sku string, day date, demand double")
    for c in measures[1:]:
        daily = daily.withColumn(c, (F.col("demand") * 3 + F.length("sku")) % 7)
    start, end = G.day_bounds(daily)
    dense = X.add(G.demand_grid(D.spread_by_sku(daily, 3), start, end, measures), *[getattr(X, n) for n in names])
    facts = X.add(G.demand_grid(daily, start, end, measures, empty_days=False), *[getattr(Y, n) for n in names])
    return rows, dense, facts


@pytest.mark.parametrize("n_days,density", [(200, 0.3), (2600, 0.02), (120, 0.9), (70, 1.0)])
def test_equal_to_the_dense_grid_on_the_days_with_facts(spark, n_days, density):
    data = series(n_days, density=density) | {"zeros": {0: 0.0, 5: 0.0, n_days - 1: 2.0}, "late": {n_days - 1: 4.0}, None: {3: 1.0, 9: 2.0}}
    rows, dense, facts = both(spark, data, [*NAMES, "DELIVERY_ROLLING"], ("demand", "n_deliveries", "qty_delivered"))
    want = {(r.sku, r.day): r.asDict() for r in dense.collect()}
    got = facts.collect()
    assert sorted(((r.sku or "", r.day) for r in got)) == sorted((r[0] or "", r[1]) for r in rows)
    assert set(facts.columns) == set(dense.columns)
    for r in got:
        for c, v in want[(r.sku, r.day)].items():
            if v is None or isinstance(v, (str, date)):
                assert r[c] == v, (r.sku, r.day, c)
            else:
                assert r[c] is not None and np.isclose(r[c], v, rtol=1e-9, atol=1e-9), (r.sku, r.day, c)


@pytest.mark.parametrize(
    "query", ["delivery_rolling", "ratio_features", "rolling_features", "rolling_median", "hf_interactions", "freq_features",
              "ewm_features", "rolling_extremes", "days_since", "lag_features"]
)
def test_demand_row_queries_make_no_empty_days(spark, sf, query):
    from skuflow.plans.registry import QUERIES

    plan = QUERIES[query](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(_from" not in plan


def test_products_with_a_line_without_a_day_keep_their_zeros(spark):
    rows = [("a", None, 3.0), ("a", D0, 5.0), ("a", D0 + timedelta(days=3), 6.0), ("b", None, 1.0), ("b", D0 + timedelta(days=10), 2.0), ("c", D0, 1.0)]
    daily = spark.createDataFrame(rows, "sku string, day date, demand double")
    start, end = G.day_bounds(daily)
    names = ["LAG", "EXTREMES", "SUMS", "FREQUENCY", "DAYS_SINCE"]
    dense = X.add(G.demand_grid(D.spread_by_sku(daily, 2), start, end), *[getattr(X, n) for n in names])
    facts = X.add(G.demand_grid(daily, start, end, empty_days=False), *[getattr(Y, n) for n in names])
    want = sorted(map(str, dense.where("has_demand = 1").select(sorted(dense.columns)).collect()))
    assert sorted(map(str, facts.select(sorted(dense.columns)).collect())) == want
