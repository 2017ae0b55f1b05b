"""Registered queries of the pipeline operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm import decontaminate, fmindex, language, mixing, oracle, runs, sharding, simhash, suffixes, topk, toxicity, trielm, warc, whitening
from skuflow.session import new_shared_path

SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, key: str = "doc_id") -> Column:
    """Remainder that decides which rows teach: crc32 of the key as text, modulo ``n``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(-1))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    folder = warc.write_archive(table(spark, sf_dir, "pages"), new_shared_path(spark, "warc"))
    back = warc.read_archive(spark, folder)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item: five-word shingles, containment of 0.8 or more."""
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "found", "shingles").distinct()


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, fold(3) != 1)
    out = language.predict(docs, model)
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in at most two bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, budget=2).select("doc_id", "fingerprint", "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on eight shards, and on nine."""
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), {i: 1.0 for i in range(SHARDS)}, {i: 1.0 for i in range(SHARDS + 1)})
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of any 35-word window that occurs twice."""
    left = fmindex.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return left.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    out = toxicity.score(docs, model, spans=False)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_end")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents so that each source nears its target of words."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of any 200-byte string that occurs twice."""
    left = suffixes.remove_repeats(table(spark, sf_dir, "documents"), window=200)
    return left.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable vector."""
    rows = whitening.Whitening(table(spark, sf_dir, "embeddings")).rows()
    return rows.withColumnRenamed("key", "vec_id")


def looped(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by crc32 of its key, repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("_w")
    chosen = docs.withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    placed = chosen.withColumn("_a", F.when(n > 0, (g % n).cast("int"))).withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    stretch = F.slice("_w", F.col("_a") + 1, F.col("_p"))
    times = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    changed = F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.flatten(F.array_repeat(stretch, times))), F.lit(1), n)
    return placed.withColumn("text", F.when(n > 0, F.array_join(changed, " ")).otherwise(F.col("text"))).drop("_w", "_a", "_p")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of 12 words and more in every document, and digests of the texts without them."""
    found = runs.collapse_runs(looped(table(spark, sf_dir, "documents").select("doc_id", "text")), least=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        F.col("key").cast("long").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op13_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, learned from six sevenths of them."""
    model = trielm.train(table(spark, sf_dir, "documents"), fold(7) != 2)
    rows = model.scores().withColumnRenamed("key", "doc_id")
    return rows.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.lexicon.n).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontaminate, op3_language, op4_simhash, op5_sharding, op6_substrings, op7_topk, op8_toxicity, op9_mixing, op10_suffixes, op11_whitening, op12_runs, op13_scores)}
ORACLE = dict(oracle.SQL)
