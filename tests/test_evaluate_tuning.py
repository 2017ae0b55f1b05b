import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from skuflow.operators import evaluate as E
from skuflow.operators import tuning as T


def test_auc_with_ties(spark):
    rows = [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (0, 0.9), (1, 0.1)]
    pairs = [(p, n) for lp, p in rows if lp for ln, n in rows if not ln]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    got = E.auc(spark.createDataFrame(rows, "label int, score double")).first()
    assert got.auc == pytest.approx(want) and (got.n_pos, got.n_neg) == (3, 3)


def test_confusion_without_hits(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "label int, score double")
    got = E.confusion(df, 0.5).first()
    assert (got.tp, got.fp, got.fn, got.tn, got.precision, got.recall) == (0, 0, 1, 1, 0.0, 0.0)


def test_left_over_day_is_dropped(spark):
    d0 = date(2026, 1, 1)
    rows = [("a", d0 + timedelta(days=i), 1.0 if i < 30 else 1000.0, 2.0) for i in range(31)]
    df = spark.createDataFrame(rows, "sku string, day date, actual double, pred double")
    tagged = E.windowed(df, F.lit(d0), 31)
    assert tagged.agg(F.max("win")).first()[0] == 2 and tagged.count() == 30
    got = E.window_scores(tagged).first()
    assert (got.wape_10d, got.bias_10d) == (pytest.approx(100.0), pytest.approx(100.0))
    assert E.windowed(df.limit(4), F.lit(d0), 4).select("win").distinct().count() == 1


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [
        (w, s, float(rng.randrange(0, 9)) if rng.random() < 0.5 else 0.0, rng.random() * 2, rng.random() * 90, rng.random() * 5, rng.randrange(1000) / 1000)
        for w in range(3) for s in range(6) for _ in range(10)
    ]


SCHEMA = "win int, sku int, actual double, base double, reg double, ewm double, p double"


def horizon_score(rows, pred):
    a, p = {}, {}
    for r in rows:
        k = (r[0], r[1])
        a[k], p[k] = a.get(k, 0) + r[2], p.get(k, 0) + pred(r)
    keys = [k for k in a if a[k] > 0]
    total = sum(a[k] for k in keys)
    return sum(abs(a[k] - p[k]) for k in keys) / total * 100, (sum(p[k] for k in keys) - total) / total * 100


def test_threshold_scores_equal_loop(spark, rows):
    got = {(r.thr, r.alpha, r.mult): r for r in T.threshold_scores(spark.createDataFrame(rows, SCHEMA), [20, 500], [0, 1025], [50, 90]).collect()}
    assert len(got) == 8
    for (t, a, m), r in got.items():
        w, b = horizon_score(rows, lambda x: ((a * x[3] + (1000 - a) * x[4]) / 1000 * m / 100) if x[6] >= t / 1000 else 0.0)
        assert (r.wape, r.bias) == (pytest.approx(w), pytest.approx(b))
        assert r.score == pytest.approx(w + (3 * -b if b < 0 else 3 * max(0, b - 5)), abs=1e-5)


def test_expected_value_scores_floor_rows_for_alpha_above_one(spark, rows):
    got = {(r.alpha, r.mult, r.power): r for r in T.expected_value_scores(spark.createDataFrame(rows, SCHEMA), [500, 1025], [50, 90], [50, 150]).collect()}
    floored = 0
    for (a, m, k), r in got.items():
        def pred(x):
            v = x[6] ** (k / 100) * (a * x[3] + (1000 - a) * x[4]) / 1000 * m / 100
            nonlocal floored
            floored += v < 0
            return max(v, 0.0)

        w, b = horizon_score(rows, pred)
        assert (r.wape, r.bias) == (pytest.approx(w), pytest.approx(b))
    assert floored > 0


def test_daily_scores_equal_loop(spark, rows):
    got = {(r.thr, r.alpha, r.mult): r for r in T.daily_scores(spark.createDataFrame(rows, SCHEMA), [20, 300, 480], [0, 700], [100]).collect()}
    real = [x for x in rows if x[2] > 0]
    total = sum(x[2] for x in real)
    for (t, a, m), r in got.items():
        pred = [((a * x[3] + (1000 - a) * x[5]) / 1000 * m / 100) if x[6] >= t / 1000 else 0.0 for x in real]
        assert r.wape == pytest.approx(sum(abs(x[2] - p) for x, p in zip(real, pred)) / total * 100)
        assert r.bias == pytest.approx((sum(pred) - total) / total * 100)


def test_fine_axis_stays_inside_its_range():
    assert T.THRESHOLD.coarse()[0] == 20 and T.THRESHOLD.coarse()[-1] == 480
    assert len(T.ALPHA.coarse()) == 11 and len(T.MULTIPLIER.coarse()) == 15 and len(T.EV_MULTIPLIER.coarse()) == 32
    assert T.THRESHOLD.fine(20)[0] == 20 and T.ALPHA.fine(1000)[-1] == 1025 and T.POWER.fine(200)[-1] == 225


def test_mode_choice(spark):
    t = spark.createDataFrame([(20, 500, 90, 40.0, 1.0, 40.0)], "thr long, alpha long, mult long, wape double, bias double, score double")
    e = spark.createDataFrame([(500, 90, 150, 40.0, 1.0, 40.0)], "alpha long, mult long, power long, wape double, bias double, score double")
    assert T.choose_mode(t, e).first().mode == "threshold"
    better = e.withColumn("wape", F.lit(39.0))
    assert T.choose_mode(t, better).first().mode == "expected_value"


def test_dense_days_and_fits_are_dealt_by_rows(spark, monkeypatch):
    from skuflow.operators import baseline as B
    from skuflow.operators import grid as G
    from skuflow.operators import prefix

    monkeypatch.setattr(prefix, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(B, "FIT_ROWS", 40)
    daily = spark.sql("SELECT id % 100 AS sku, date_add(DATE'2024-01-01', cast(id / 100 AS int)) AS day, 1.0D AS demand FROM range(1000)")
    start, end = F.lit("2024-01-01").cast("date"), F.lit("2024-01-10").cast("date")
    grid = G.recent_grid(daily, start, end, 10, {"ewm_7": 0.9})
    parts = grid.groupBy(F.spark_partition_id()).count().collect()
    assert grid.count() == 1000 and len(parts) == 5
    assert B.fitted_dimension(daily, G.calendar(start, end, spark), start).rdd.getNumPartitions() >= 1000 // 40
    assert grid.rdd.getNumPartitions() == 5
