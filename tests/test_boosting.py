"""Histogram boosting against plain numpy trees over the same bins."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuflow.operators import boosting as H

PLAIN = H.Settings("squared", rounds=5, depth=3, step=0.3, rows=1.0, per_tree=1.0, per_level=1.0, min_child=4.0, min_gain=0.01, bins=16)
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(5)
    n = 900
    a, b, c = rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.random(n)
    b[::17] = np.nan
    y = 2.0 * (a > 0.3) + np.where(np.isnan(b), -1.5, 0.5 * b) + 0.05 * rng.normal(size=n)
    rows = [(i, float(a[i]), None if np.isnan(b[i]) else float(b[i]), float(c[i]), float(y[i]), int(y[i] > 1), i % 5 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, hit int, held boolean").repartition(5, "id")


def _plain(model, rows, label, s):
    """Boost the same bins with loops; returns the predictions and the feature gains."""
    bins = np.array([[0 if r[f] is None else 1 + sum(cut <= r[f] for cut in model.cuts[i]) for r in rows] for i, f in enumerate(NAMES)])
    y = np.array([float(r[label]) for r in rows])
    margin = np.full(len(y), model.base)
    gains = dict.fromkeys(NAMES, 0.0)
    shrink = lambda g: np.sign(g) * max(abs(g) - s.l1, 0)
    score = lambda g, h: shrink(g) ** 2 / (h + s.l2)
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (margin - y, np.ones(len(y))) if s.objective == "squared" else (p - y, p * (1 - p))
        add = np.zeros(len(y))

        def grow(at, depth, g=g, h=h, add=add):
            best = (s.min_gain, None, None)
            if depth < s.depth:
                for f in range(3):
                    for cut in range(s.bins):
                        left = at[bins[f, at] <= cut]
                        right = at[bins[f, at] > cut]
                        if min(h[left].sum(), h[right].sum()) >= s.min_child:
                            gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[at].sum(), h[at].sum())
                            if gain > best[0] + 1e-9:
                                best = (gain, f, cut)
            if best[1] is None:
                add[at] = -shrink(g[at].sum()) / (h[at].sum() + s.l2)
            else:
                gains[NAMES[best[1]]] += best[0]
                grow(at[bins[best[1], at] <= best[2]], depth + 1)
                grow(at[bins[best[1], at] > best[2]], depth + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + s.step * add
    return (margin if s.objective == "squared" else 1 / (1 + np.exp(-margin))), gains


@pytest.mark.parametrize(("objective", "label"), [("squared", "y"), ("logistic", "hit")])
def test_equals_plain_trees(spark, case, objective, label):
    s = replace(PLAIN, objective=objective)
    model = H.fit(case, NAMES, label, s)
    got = {r["id"]: r["p"] for r in model.predict(case, "p").select("id", "p").collect()}
    rows = case.collect()
    want, gains = _plain(model, rows, label, s)
    assert [got[r["id"]] for r in rows] == pytest.approx(list(want), abs=1e-7)
    assert {r["feature"]: r["gain"] for r in model.gains(spark).collect()} == pytest.approx({f: g for f, g in gains.items() if g > 0}, rel=1e-6)


def test_merging_in_steps_changes_nothing(case, monkeypatch):
    one = H.fit(case, NAMES, "y", PLAIN)
    monkeypatch.setattr(H, "HISTOGRAM", 1)  # one feature a group
    monkeypatch.setattr(H, "REWRITE", 2)
    other = H.fit(case, NAMES, "y", PLAIN)
    for x, y in zip(one.trees, other.trees, strict=True):
        assert (x.feature == y.feature).all() and (x.bin == y.bin).all() and np.allclose(x.value, y.value)


def test_cuts_follow_the_weight(spark):
    rows = spark.range(0, 20_000, 1, 70).select(F.col("id").cast("double").alias("v"), F.when(F.col("id") < 2_000, 9.0).otherwise(1.0).alias("w"), F.lit(1.0).alias("same"))
    v, same = H.quantile_cuts(rows, ["v", "same"], "w", 12)
    assert len(v) == 10 and len(same) == 0
    weight = lambda x: 9 * min(x, 2_000) + max(0, x - 2_000)
    assert [weight(x) / 36_000 for x in v] == pytest.approx([k / 11 for k in range(1, 11)], abs=0.005)


def test_early_stop_sampling_and_round_trip(spark, case, tmp_path):
    s = replace(PLAIN, rounds=40, step=0.6, rows=0.7, per_tree=0.7, per_level=0.8, patience=3, bins=64)  # 16 bins miss the step of a at 0.3 by up to 1/15 of the rows
    model = H.fit(case, NAMES, "y", s, valid="held")
    assert 0 < len(model.trees) < 40 and min(model.losses) == model.losses[len(model.trees)]
    again = H.fit(case, NAMES, "y", s, valid="held")
    assert len(again.trees) == len(model.trees) and np.allclose(again.losses, model.losses)
    model.save(spark, str(tmp_path))
    back = H.Model.load(spark, str(tmp_path))
    pairs = back.predict(model.predict(case, "p"), "q").select("y", "p", "q").collect()
    assert all(r.p == pytest.approx(r.q, abs=1e-12) for r in pairs)
    assert np.mean([(r.p - r.y) ** 2 for r in pairs]) < 0.04


def test_nothing_to_learn(spark, case):
    assert H.fit(case.limit(0), NAMES, "hit", replace(PLAIN, objective="logistic")).predict(case, "p").select("p").distinct().collect()[0].p == 0.5
    one = case.withColumns({f: F.lit(None).cast("double") for f in NAMES}).withColumn("y", F.when(F.col("id") > 5, F.lit(3.0)))
    got = {round(r.p, 9) for r in H.fit(one, NAMES, "y", PLAIN).predict(one, "p").select("p").collect()}
    assert got == {3.0}
