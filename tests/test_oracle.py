import pytest
from oracle_check import compare, connect

from skuflow.plans.registry import ORACLE, QUERIES

QUICK = [
    "daily_demand_capped", "delivery_stats", "demand_grid", "sparsity_profile", "sku_segments", "lag_features", "rolling_features",
    "rolling_median", "ewm_features", "delivery_rolling", "holiday_features", "baseline_parameters", "wape_10d", "auc_exact",
    "stock_ledger", "site_load", "slot_assignment", "event_outcomes", "pick_tours", "tune_threshold", "batch_forecast",
    "preparation_order", "event_file", "rolling_extremes", "freq_features", "ratio_features", "chariot_split", "wape_models", "tune_daily",
    "lag1_accuracy", "product_features", "stream_ledger",
    "keyed_parameters", "mixed_event_files", "instruction_file", "published_totals", "tour_totals", "dated_preparation_order",
]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, connect(sf), QUERIES[name], ORACLE[name], sf) == ""


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
