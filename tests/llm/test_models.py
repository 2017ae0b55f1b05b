from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuflow.llm import language, toxicity
from skuflow.llm.queries import fold

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 0, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (3, 1, None), (5, None, 0), (5, None, 1), (9999, 1, 1)]
    return spark.createDataFrame(rows, LABELS)


def test_toxicity_finds_the_sentence(spark):
    rows = [(i, f"Plain words number {i} go here. " + ("You utter numskull of a man! " if i % 5 == 0 else "") + "More plain words follow.") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(300)], LABELS)
    model = toxicity.train(docs, labels, fold(5) != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all((r["score"] >= 0.5) == (i % 5 == 0) for i, r in got.items())
    bad = got[10]
    assert "numskull" in rows[10][1].encode()[bad["worst_start"] : bad["worst_end"]].decode()
    assert bad["offending"] == [bad["worst_start"]]


def test_toxicity_of_messy_rows(messy, labels):
    model = toxicity.train(messy, labels, fold(5) != 0)
    got = toxicity.score(messy, model).collect()
    assert len(got) == messy.count()
    assert all(0.0 <= r["score"] <= 1.0 for r in got)
    by_text = {}
    for r, s in zip(messy.select("doc_id", "text").collect(), got, strict=True):
        assert r["doc_id"] == s["doc_id"]
        assert by_text.setdefault(r["text"] or "", s["score"]) == s["score"]  # only the text enters
    assert toxicity.train(messy, labels.limit(0), fold(5) != 0).fixed == 0.0
    assert toxicity.train(messy, labels.where("toxic = 1"), fold(5) != -2).fixed == 1.0


def test_sentences_of_rows():
    raw = np.frombuffer(b"A b. C!d.\n\nE", np.uint8)
    begins, row = toxicity.sentences(np.concatenate([raw, raw]), np.array([0, 0, len(raw), len(raw), 2 * len(raw)]))
    assert row.tolist() == [0] + [1] * 6 + [2] + [3] * 6
    assert begins.tolist() == [0, 0, 4, 7, 9, 10, 11, 12, 12, 16, 19, 21, 22, 23]


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 8, 20):
        code = language.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2 if n < 4 else 4)


def test_language_of_messy_rows(messy):
    model = language.train(messy, fold(3) != 1)
    got = language.predict(messy, model).collect()
    assert len(got) == messy.count()
    for r, text in zip(got, (x["text"] for x in messy.select("text").collect()), strict=True):
        letters = any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0.0 <= r["score"] <= 1.0
    assert {r["lang_pred"] for r in got} <= {"und", "en", "de"}
    none = language.train(messy, F.lit(False))
    assert {r["lang_pred"] for r in language.predict(messy, none).collect()} == {"und"}


def test_empty(nothing, labels):
    assert language.predict(nothing, language.train(nothing, fold(3) != 1)).count() == 0
    assert toxicity.score(nothing, toxicity.train(nothing, labels, fold(5) != 0)).count() == 0


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = language.train(docs, fold(3) != 1)
    held = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold(3) == 1)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    model = toxicity.train(docs, labels, fold(5) != 0)
    known = toxicity.score(docs, model).join(labels, "doc_id").where(fold(5) == 0)
    assert known.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int"))).first()[0] > 0.95
