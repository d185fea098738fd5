"""Pairs of claims and chunks to train a verifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def training_pairs(evidence: DataFrame, cited: DataFrame, chunks: DataFrame, ranked: DataFrame, deep: int = 30, first: int = 2) -> DataFrame:
    """evidence (qid, doc_id, label, sentences), cited (qid, doc_id), chunks (doc_id, chunk, start, end), ranked (qid, doc_id, chunk, rank)
    -> qid, doc_id, chunk, label, type.

    gold: of an evidence document the chunk [start, end) with most of the sentences, the first of equals; same_doc: its chunks without any; nei_cited: the
    first chunks of what a claim without evidence cites; bm25_neg: the best ranked chunk down to `deep` of a document that is neither.  All but
    gold are UNSUPPORTED."""
    inside = F.size(F.filter(F.array_distinct("sentences"), lambda x: (x >= F.col("start")) & (x < F.col("end"))))
    laid = evidence.join(chunks, "doc_id").withColumn("shared", inside)
    gold = laid.groupBy("qid", "doc_id", "label").agg(F.max(F.struct("shared", (-F.col("chunk")).alias("back"))).alias("m")).select("qid", "doc_id", (-F.col("m.back")).alias("chunk"), "label", F.lit("gold").alias("type"))
    wrong = lambda df, kind: df.select("qid", "doc_id", "chunk", F.lit("UNSUPPORTED").alias("label"), F.lit(kind).alias("type"))
    same = wrong(laid.where("shared = 0"), "same_doc")
    silent = cited.join(evidence.select("qid").distinct(), "qid", "left_anti").distinct()
    nei = wrong(silent.join(chunks.where(F.col("chunk") < first), "doc_id"), "nei_cited")
    involved = evidence.select("qid", "doc_id").union(cited.select("qid", "doc_id")).distinct()
    other = ranked.where(F.col("rank") <= deep).join(involved, ["qid", "doc_id"], "left_anti").groupBy("qid").agg(F.min(F.struct("rank", "doc_id", "chunk")).alias("m"))
    return gold.union(same).union(nei).union(wrong(other.select("qid", "m.doc_id", "m.chunk"), "bm25_neg"))
