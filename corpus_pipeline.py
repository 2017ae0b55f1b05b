"""Documents to training shards: toxicity, near duplicates, benchmark leaks, source mix, shards.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Stages but the last return the
columns of ``documents``; each result is written as Parquet and read again as the next one's ``docs``. Row keys used
inside a stage are the file and row number in that written table, so every reading and every repeated task sees the same
ones however Spark splits the files.

Defined cases: null keys and texts pass like any other row (a null text scores as an empty one, groups with other empty
texts, contains no benchmark item and has no words to mix); repeated rows are rows of their own; empty tables pass as
empty; columns beyond those of ``documents`` are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm import address, decontaminate, mixing, sharding, simhash, toxicity
from skuflow.llm.queries import SHARDS, fold, table
from skuflow.session import new_shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_ROW = "_stage_row"


def _numbered(docs: DataFrame) -> DataFrame:
    return address.numbered(docs.select(*COLUMNS), _ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents with a score of 0.5 or more go."""
    rows = _numbered(docs)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    clean = toxicity.score(rows, model, row=F.col(_ROW), spans=False).where("score < 0.5").select(F.col("row").alias(_ROW))
    return rows.join(clean, _ROW, "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near copies the document with the smallest key stays."""
    rows = _numbered(docs)
    grouped = simhash.near_duplicates(rows, width=3, budget=2, row=F.col(_ROW), group_by_row=True)
    first = grouped.where("is_first").select(F.col("row").alias(_ROW))
    return rows.join(first, _ROW, "left_semi").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that contain a benchmark item go."""
    leaks = decontaminate.contained(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h"))
    return docs.join(leaks, same, "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: every document as often as the mix takes it."""
    rows = _numbered(docs)
    copies = mixing.mix_sources(rows, row=_ROW).where("copies > 0").select(F.col("row").alias(_ROW), "copies")
    taken = rows.join(copies, _ROW).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: shard and slot of every row."""
    placed = sharding.shard_rows(docs, {i: 1.0 for i in range(SHARDS)}, {i: 1.0 for i in range(SHARDS + 1)})
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("source mix", mix_sources),
    ("sharding", shard),
]

#: Trained scores, fingerprints and sampled copies have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each through a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = new_shared_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
