"""The corpus pipeline: documents in, encoded mixture out.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents (the last one: codes).  A stage sees what its predecessor kept and
nothing else.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.bpe import bpe_digest
from quillstone.llm.mixing import mix_sources
from quillstone.llm.neardup import near_duplicates, surrogate
from quillstone.llm.quality import quality_rules
from quillstone.llm.substrings import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules(docs).where("kept").select("row.*")


def neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the smallest id stays; of rows that share an id, one."""
    uid = F.expr(surrogate("doc_id", "text"))
    groups = near_duplicates(docs.select(uid.alias("uid"), F.col("text").alias("t")), size=5, percent=80)
    gone = groups.where("uid <> component").select("uid").distinct()
    return docs.withColumn("uid", uid).join(gone, "uid", "left_anti").dropDuplicates(["uid"]).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that repeat go; a text without any stays as it is, white space included."""
    got = substring_dedup(docs)
    cut = F.col("n_removed") > 0
    out = got.select("row.*", F.col("kept").alias("_kept"), cut.alias("_cut"))
    text = F.when(F.col("_cut"), F.col("_kept")).otherwise(F.col("text"))
    return out.select(*[text.alias("text") if c == "text" else F.when(F.col("_cut"), F.length("_kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else c for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; rows that repeat are taken together."""
    copies = mix_sources(docs).groupBy("h").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    keyed = docs.withColumn("h", F.xxhash64("doc_id", "text")).dropDuplicates(["h"])
    return keyed.join(copies, "h").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe_digest(docs, str(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("MinHash near-dedup", neardup), ("substring dedup", substrings), ("mixing sources to target weights", mix), ("BPE encoding and decoding", encode)]

#: The hashed log-likelihood ratio, the sampling order and the encoding are not SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
