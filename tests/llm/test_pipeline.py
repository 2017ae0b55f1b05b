"""The pipeline against what its decisions must leave, and on tables with nulls and none at all."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
from skuflow.llm import decontaminate, toxicity
from skuflow.llm.queries import fold


def through(spark, docs, sf, folder):
    out = []
    for name, stage in pipeline.STAGES:
        path = f"{folder}/{name.replace(' ', '_')}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_every_stage_takes_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean, single, honest, mixed, placed = through(spark, docs, sf, tmp_path)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), fold(5) != 0)
    bad = {r["doc_id"] for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - bad

    from test_simhash import plain_fingerprint, plain_groups

    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in clean.collect()}
    roots = plain_groups(list(prints.values()), 2)
    first: dict[int, int] = {}
    for key, p in prints.items():
        first[roots[p]] = min(key, first.get(roots[p], key))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(first.values())

    leaks = {r["doc_id"] for r in decontaminate.contained(single, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert sorted(r["doc_id"] for r in honest.collect()) == sorted(set(first.values()) - leaks)

    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= {r["doc_id"] for r in honest.collect()} and max(copies.values()) <= 3
    assert all(r["text"] == texts[r["doc_id"]] for r in mixed.collect())
    assert Counter(r["doc_id"] for r in placed.collect()) == copies
    for stage in (clean, single, honest, mixed):
        assert stage.columns == pipeline.COLUMNS


def test_messy_and_empty_tables(spark, sf, messy, nothing, tmp_path):
    for name, docs in (("messy", messy), ("nothing", nothing)):
        steps = through(spark, docs, sf, tmp_path / name)
        assert [s.count() for s in steps[-2:]].count(steps[-1].count()) == 2
    kept = through(spark, messy, sf, tmp_path / "again")
    assert kept[0].count() == messy.count()  # nothing in it is toxic


def test_row_numbers_hold_when_splits_change(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(600)
    path = str(tmp_path / "docs")
    docs.union(docs.limit(200)).repartition(2).write.option("parquet.block.size", 65536).parquet(path)
    docs = spark.read.parquet(path)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    for stage in (pipeline.drop_near_copies, pipeline.mix_sources):
        want = Counter(stage(spark, docs, sf).collect())
        lazy = stage(spark, docs, sf)
        before = docs.rdd.getNumPartitions()
        try:
            spark.conf.set(key, "65536")  # as when an executor is lost or added before the last join
            assert spark.read.parquet(path).rdd.getNumPartitions() != before
            assert Counter(lazy.collect()) == want, stage
        finally:
            spark.conf.set(key, old)
