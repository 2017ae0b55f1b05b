import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from skuflow.operators import models as M
from skuflow.operators import scoring as C
from skuflow.plans import training

D0 = date(2024, 1, 1)


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(4)
    rows = [(f"s{s}", D0 + timedelta(days=d), float(5 + 10 * ((d + s) % 7 == 0) + rng.randrange(3)))
            for s in range(5) for d in range(240) if (d + s) % 7 < 3 or d in (0, 239)]
    history = spark.createDataFrame(rows, "sku string, day date, qty double")
    dels = spark.createDataFrame([("s1", D0 + timedelta(days=5), 2, 9.0)], "sku string, day date, n_deliveries long, qty_delivered double")
    return training.train(history, dels, rounds=3, classifier_depth=3, regressor_depth=3)


def test_features_and_scores(trained):
    assert len(trained.features) > 120 and "demand" not in trained.features and "has_demand" not in trained.features
    rows = trained.scored_test.collect()
    assert len(rows) == 5 * 30
    assert all(0 <= r.probability <= 1 and r.pred >= 0 and r.reg_qty >= 0 for r in rows)
    hit = [r.probability for r in rows if r.demand > 0]
    miss = [r.probability for r in rows if r.demand == 0]
    assert sum(hit) / len(hit) > sum(miss) / len(miss)
    assert trained.params.count() == 1


def test_save_and_load(spark, trained, tmp_path):
    dims = spark.createDataFrame([("s1", 1.0)], "sku string, simple_avg double")
    M.save(str(tmp_path), trained.classifier, trained.regressor, dims, trained.params)
    classifier, regressor, dim, params = M.load(spark, str(tmp_path))
    assert classifier.stages[-1].getNumTrees == trained.classifier.stages[-1].getNumTrees
    assert dim.count() == 1 and params.first().mode == trained.params.first().mode


def test_importance(spark, trained):
    top = M.importance(trained.classifier, trained.features, spark, k=5).collect()
    assert len(top) == 5 and top[0].gain >= top[-1].gain


def test_band_and_blend(spark):
    df = spark.createDataFrame([(1.0, 10.0, 0.5), (2.0, 0.0, 0.5)], "pred double, avg_demand double, probability double")
    got = C.with_band(df).collect()
    assert got[0].conf_low == 0 and got[0].conf_high == pytest.approx(1 + 1.96 * 4)
    assert got[1].conf_low == pytest.approx(2 - 1.96) and got[1].conf_high == pytest.approx(2 + 1.96)
    rows = spark.createDataFrame([(0.5, 10.0, 20.0)], "probability double, base_yhat double, reg_qty double")
    r = rows.select(M.expected_value(0.725, 0.9, 3.0).alias("e"), M.gated(0.5, 0.725, 0.9).alias("g"), M.gated(0.6, 0.725, 0.9).alias("n")).first()
    assert r.e == pytest.approx(0.125 * 12.75 * 0.9) and r.g == pytest.approx(12.75 * 0.9) and r.n == 0.0


def test_preparation_order(spark):
    forecast = spark.createDataFrame([(1, 2.345), (2, 0.0), (3, 0.0), (4, 5.0)], "sku long, pred double")
    overrides = spark.createDataFrame([(2, 7.5), (4, 0.0)], "sku long, override_qty double")
    stock = spark.createDataFrame([(2, 11, "S11")], "sku long, slot_id long, code string")
    got = {r.sku: r for r in C.preparation_order(forecast, overrides, stock).collect()}
    assert set(got) == {1, 2}
    assert (got[2].status, got[2].source_location, got[2].pick_quantity, got[2].override_applied) == ("ready", "S11", 8, True)
    assert (got[1].status, got[1].source_location, got[1].pick_quantity, got[1].quantity_to_prepare) == ("missing_stock", "Non stocke", None, 2.34)


# The features of the published model; its baseline columns carry another name here.
PUBLISHED = """
cat_enc colisage_fardeau colisage_palette cv_28 day_idx day_idx_sq days_since days_since_ramadan days_to_eid_adha days_to_eid_fitr
days_to_national_holiday days_to_ramadan del_avg_qty del_n_days del_qty_rolling_28 del_qty_rolling_7 del_rolling_14 del_rolling_28
del_rolling_7 del_total_count del_total_qty dfreq_14 dfreq_28 dfreq_60 dfreq_7 dom dow eid_adha_prep eid_fitr_prep ewm28_norm ewm7_norm
ewm_28 ewm_7 fourier_cos_m1 fourier_cos_m2 fourier_cos_w1 fourier_cos_w2 fourier_cos_y1 fourier_cos_y2 fourier_cos_y3 fourier_cos_y4
fourier_sin_m1 fourier_sin_m2 fourier_sin_w1 fourier_sin_w2 fourier_sin_y1 fourier_sin_y2 fourier_sin_y3 fourier_sin_y4 hf_x_days_since
hf_x_dfreq7 hf_x_dow hf_x_eid_adha hf_x_eid_fitr hf_x_is_wknd hf_x_lag1 hf_x_month hf_x_base hf_x_ramadan hf_x_ramadan_prep hf_x_rmean7
is_any_holiday is_ashura is_eid_adha is_eid_fitr is_gerbable is_hf is_islamic_new_year is_mawlid is_month_end is_month_start
is_national_holiday is_ramadan is_week_start is_wknd lag1_norm lag_1 lag_14 lag_2 lag_21 lag_28 lag_3 lag_7 lag_w1 lag_w2 lag_w4 month
p_avg p_days p_demand_score p_freq p_freq_score p_prio p_total poids_kg pre_holiday_3d prod_avg_demand prod_med_demand prod_n_days
prod_std_demand base_over_ewm7 base_over_rmean7 base_ratio base_resid_lag1 base_resid_rmean7 base_seasonal_str base_trend base_trend_norm
base_weekly base_weekly_abs base_yearly base_yearly_abs base_yhat qtr ramadan_day ramadan_last_week ramadan_prep ramadan_progress rmax_14
rmax_28 rmax_7 rmean28_norm rmean7_norm rmean7_over_28 rmean_14 rmean_28 rmean_3 rmean_60 rmean_7 rmean_wday4 rmean_wday4_norm rmed_14
rmed_28 rmed_7 rmin_14 rmin_28 rmin_7 rstd_14 rstd_28 rstd_3 rstd_60 rstd_7 rsum_14 rsum_28 rsum_7 volume_pcs week
""".split()


def test_all_published_features_are_in_the_grid(trained):
    assert len(PUBLISHED) == 147
    assert set(PUBLISHED) <= set(trained.features), sorted(set(PUBLISHED) - set(trained.features))


def test_totals_do_not_see_the_hold_out(spark):
    days = [D0 + timedelta(days=d) for d in range(200)]
    history = spark.createDataFrame([("s1", d, 2.0) for d in days], "sku string, day date, qty double")
    dels = spark.createDataFrame([("s1", days[5], 2, 9.0), ("s1", days[190], 50, 900.0)], "sku string, day date, n_deliveries long, qty_delivered double")
    products = spark.createDataFrame([("s1", None, "6", "x", "0.5", "1.5", "True")], "sku string, category string, colisage_fardeau string, colisage_palette string, volume_pcs string, poids_kg string, is_gerbable string")
    grid, _ = training.feature_grid(history, dels, holdout_days=60, products=products)
    r = grid.orderBy("day").first()
    assert (r.del_total_count, r.del_total_qty, r.p_days, r.p_total) == (2, 9.0, 140.0, 280.0)
    assert (r.colisage_fardeau, r.colisage_palette, r.poids_kg, r.is_gerbable, r.cat_enc) == (6.0, 0.0, 1.5, 1.0, 0.0)


def test_saved_models_score_future_days(spark, trained, tmp_path):
    first, last = D0 + timedelta(days=240), D0 + timedelta(days=270)
    static = {n: 0.0 for n in training.STATIC if n != "segment"}
    rows = [{"sku": f"s{s}", "mean_yhat": 5.0 + s, "avg_demand": 6.0 + s, "demand_freq": 0.4, "demand_days": 90, **static} for s in range(5)]
    M.save(str(tmp_path), trained.classifier, trained.regressor, spark.createDataFrame(rows), trained.params)
    got = training.forecast(spark, str(tmp_path), trained.features, F.lit(first), F.lit(last)).collect()
    assert {(r.sku, r.day) for r in got} == {(f"s{s}", first + timedelta(days=d)) for s in range(5) for d in range(31)}
    p = trained.params.first()
    for r in got:
        blend = p.alpha / 1000 * r.base_yhat + (1 - p.alpha / 1000) * r.reg_qty
        ev = r.probability ** (p.power / 100) * blend * p.mult / 100
        gated = blend * p.mult / 100 if p.thr is not None and r.probability >= p.thr / 1000 else 0.0
        assert r.pred == pytest.approx(max(0.0, ev if p["mode"] == "expected_value" else gated))


def test_unknown_features_are_an_error(spark):
    rows = spark.createDataFrame([("s1", D0, 1.0, 1.0, 0.5, 3)], "sku string, day date, mean_yhat double, avg_demand double, demand_freq double, demand_days int")
    with pytest.raises(ValueError, match="moon_phase"):
        C.approximate_features(rows, ["lag_1", "moon_phase"])


def test_bounded_sample_keeps_demand_rows(spark):
    rows = spark.range(40_000).selectExpr("cast(id % 100 as string) AS sku", "date_add(date'2024-01-01', cast(id / 100 as int)) AS day", "cast(id % 50 = 0 as int) AS has_demand")
    counts = {r["has_demand"]: r["count"] for r in training.sample_rows(rows, 1000).groupBy("has_demand").count().collect()}
    assert 350 < counts[1] < 650 and 350 < counts[0] < 650
    assert training.sample_rows(rows, 1_000_000).count() == 40_000
