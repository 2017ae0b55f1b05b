"""Toxicity from few, balanced and rare labels, and the model against its own definition."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuflow.llm import toxicity


def _table(spark, tmp_path, n, toxic, seed=1):
    draw = random.Random(seed)
    sentence = lambda: " ".join(f"w{draw.randrange(300)}" for _ in range(8)) + "."
    rows = []
    for i in range(3 * n):
        bad = i % n < toxic
        text = [sentence() for _ in range(draw.randrange(1, 5))]
        if bad:
            text.insert(draw.randrange(len(text) + 1), f"{sentence()[:-1]} vilething {sentence()}")
        rows.append((i, " ".join(text), int(bad)))
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id long, text string, toxic int").write.parquet(path)
    docs = spark.read.parquet(path)
    return docs.select("doc_id", "text"), docs.where(F.col("doc_id") < n).select("doc_id", "toxic"), {i: t for i, _, t in rows}


@pytest.mark.parametrize("n,toxic", [(16, 8), (68, 10), (68, 34), (400, 12), (400, 200)])
def test_one_word_is_learned_from_any_number_of_labels(spark, tmp_path, n, toxic):
    docs, labels, truth = _table(spark, tmp_path, n, toxic)
    model = toxicity.train(docs, labels, F.lit(True))
    assert len(model.keys)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, spans=False).collect()}
    right = sum((got[i] >= 0.5) == bool(t) for i, t in truth.items() if i >= n)
    assert right >= 0.95 * 2 * n
    clean, bad = ([s for i, s in got.items() if truth[i] == k] for k in (0, 1))
    assert np.mean(bad) > 0.8 > 0.2 > np.mean(clean)


def test_labels_that_no_word_explains_give_their_share(spark, tmp_path):
    docs, _, _ = _table(spark, tmp_path, 10, 5)
    same = docs.withColumn("text", F.lit("the same words in every text"))
    labels = same.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.train(same, labels, F.lit(True))
    scores = {r["score"] for r in toxicity.score(same, model, spans=False).collect()}
    assert len(scores) == 1 and scores.pop() == pytest.approx(8 / 30)
