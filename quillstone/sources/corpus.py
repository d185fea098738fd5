"""The engine's tables, from the corpus tables: docs (doc_id, title, body), queries (qid, text), qrels (qid, doc_id, rel), vectors (id, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title is a text's first line, the body the rest."""
    t = F.col("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring_index(t, "\n", 1).alias("title"), F.when(F.instr(t, "\n") > 0, F.substr(t, F.instr(t, "\n") + 1)).otherwise("").alias("body"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages, whole."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document that holds a query's whole passage is relevant to it.

    Joined on the passage's second to fourth word, as the first may be part of a longer one; candidates are then compared as text.
    Passages of fewer than five words are looked up one by one."""
    needles = queries(spark, sf_dir).withColumnRenamed("text", "needle").withColumn("w", F.split("needle", " "))
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = F.split("text", " ")
    threes = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"), F.slice(words, F.lit(3), F.size(words)).alias("c"))
    keyed = texts.select("doc_id", F.explode(F.array_distinct(F.transform(threes, lambda x: F.xxhash64(x["a"], x["b"], x["c"])))).alias("key"))
    long = needles.where(F.size("w") >= 5).select("qid", "needle", F.xxhash64(F.get("w", F.lit(1)), F.get("w", F.lit(2)), F.get("w", F.lit(3))).alias("key"))
    some = keyed.join(long, "key").select("doc_id", "qid", "needle").join(texts, "doc_id").where(F.contains("text", "needle")).select("qid", "doc_id").distinct()
    for r in needles.where(F.size("w") < 5).select("qid", "needle").collect():
        some = some.union(texts.where(F.contains("text", F.lit(r["needle"]))).select(F.lit(r["qid"]).alias("qid"), "doc_id"))
    return some.select("qid", "doc_id", F.lit(1).cast("long").alias("rel"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
