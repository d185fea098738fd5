"""Pools, normalisation and fusion of ranked lists (qid, unit, sparse, dense)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.lexical import top


def pool(sparse: DataFrame, dense: DataFrame, n: int) -> DataFrame:
    """The n best of either list, with both scores (0 where a list has none)."""
    ids = top(sparse.where("score > 0"), n).select("qid", "unit").union(top(dense, n).select("qid", "unit")).distinct()
    out = ids.join(sparse.withColumnRenamed("score", "sparse"), ["qid", "unit"], "left").join(dense.withColumnRenamed("score", "dense"), ["qid", "unit"], "left")
    return out.select("qid", "unit", F.coalesce("sparse", F.lit(0.0)).alias("sparse"), F.coalesce("dense", F.lit(0.0)).alias("dense"))


def min_max(c: str):
    w = Window.partitionBy("qid")
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high - low < 1e-9, 0.0).otherwise((F.col(c) - low) / (high - low))


def _rank(c: str):
    return F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "unit"))


def rrf(pooled: DataFrame, k: int = 60) -> DataFrame:
    return pooled.select("qid", "unit", F.round(1 / (k + _rank("sparse")) + 1 / (k + _rank("dense")), 6).alias("score"))


def convex(pooled: DataFrame, alpha: float) -> DataFrame:
    return pooled.select("qid", "unit", F.round(alpha * min_max("sparse") + (1 - alpha) * min_max("dense"), 6).alias("score"))


def best_unit(scores: DataFrame, doc: str) -> DataFrame:
    """MaxP: each document's best unit."""
    w = Window.partitionBy("qid", doc).orderBy(F.desc("score"), "unit")
    return scores.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def rerank_append(run: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """The first n of a run in the order of other scores (none: 0), then the rest as it was."""
    j = run.withColumnRenamed("score", "old").join(scores, ["qid", "unit"], "left").withColumn("late", F.col("rank") > n)
    key = F.when(F.col("late"), F.col("old")).otherwise(F.coalesce("score", F.lit(0.0)))
    return j.select("qid", "unit", F.row_number().over(Window.partitionBy("qid").orderBy("late", key.desc(), "unit")).cast("long").alias("rank"))


def alpha_curves(pooled: DataFrame, qrels: DataFrame, steps: int = 20, k: int = 10) -> DataFrame:
    """qid, alpha, ndcg of the convex mixture for alpha = 0, 1/steps, .. 1; judgments are binary, queries without any are left out."""
    mixed = pooled.select("qid", "unit", min_max("sparse").alias("s"), min_max("dense").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    mixed = mixed.withColumn("alpha", F.col("i") / steps).withColumn("score", F.round(F.col("alpha") * F.col("s") + (1 - F.col("alpha")) * F.col("t"), 6))
    run = mixed.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "alpha").orderBy(F.desc("score"), "unit"))).where(F.col("rank") <= k)
    gain = 1 / F.log2(F.col("rank") + 1.0)
    rel = qrels.select("qid", F.col("doc_id").alias("unit"), F.lit(1).alias("hit"))
    dcg = run.join(rel, ["qid", "unit"], "left").groupBy("qid", "alpha").agg(F.sum(F.when(F.col("hit") == 1, gain).otherwise(0.0)).alias("dcg"))
    ideal = rel.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("unit"))).where(F.col("rank") <= k).groupBy("qid").agg(F.sum(gain).alias("idcg"))
    return dcg.join(ideal, "qid").select("qid", "alpha", F.round(F.col("dcg") / F.col("idcg"), 6).alias("ndcg"))


def post_features(pooled: DataFrame, idf_sums: DataFrame) -> DataFrame:
    """pooled (qid, unit, sparse, dense), idf_sums (qid, s) -> twelve features of the two lists: tops, gaps, spreads, agreement, crossed ranks from 0."""
    r = pooled.withColumn("rs", _rank("sparse")).withColumn("rd", _rank("dense"))
    s, d, rs, rd = (F.col(c) for c in ("sparse", "dense", "rs", "rd"))
    at = lambda rank, k, c: F.coalesce(F.max(F.when(rank == k, c)), F.lit(0.0))
    got = r.groupBy("qid").agg(
        at(rs, 1, s).alias("s1"), at(rs, 2, s).alias("s2"), at(rd, 1, d).alias("d1"), at(rd, 2, d).alias("d2"), F.stddev_pop(F.when(rs <= 100, s)).alias("std"), F.avg(F.when(rs <= 100, s)).alias("mean"),
        F.stddev_pop(F.when(rd <= 10, d)).alias("std10"), F.avg(F.when(rd <= 10, d)).alias("mean10"), (F.count_if((rs <= 10) & (rd <= 10)) / F.greatest(F.count_if((rs <= 10) | (rd <= 10)), F.lit(1))).alias("jacc"),
        F.max(((rs == 1) & (rd == 1)).cast("double")).alias("same"), F.log1p(F.max(F.when(rs == 1, rd - 1))).alias("sd"), F.log1p(F.max(F.when(rd == 1, rs - 1))).alias("ds"),
    ).join(idf_sums, "qid")
    six = lambda c, name: F.round(c, 6).alias(name)
    return got.select(
        "qid", six(F.col("s1"), "sp_top1"), six(F.col("s1") / (F.col("s") + 1e-9), "sp_top1_rel"), six((F.col("s1") - F.col("s2")) / (F.col("s1") + 1e-9), "sp_gap12"), six(F.col("std") / (F.col("mean") + 1e-9), "sp_nqc"), six(F.col("d1"), "de_top1"),
        six(F.col("d1") - F.col("d2"), "de_gap12"), six(F.col("std10"), "de_std10"), six(F.col("mean10"), "de_mean10"), six(F.col("jacc"), "agree_jacc10"), six(F.col("same"), "agree_top1"), six(F.col("sd"), "sp1_rank_in_de"), six(F.col("ds"), "de1_rank_in_sp"),
    )


def arbitration(sparse: DataFrame, dense: DataFrame, scorer: DataFrame) -> DataFrame:
    """A scorer's (qid, unit, score) view of the first three of both runs (qid, unit, rank): a shorter list is filled with its last one."""

    def three(run: DataFrame, name: str) -> DataFrame:
        s = run.where("rank <= 3").join(scorer, ["qid", "unit"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        by = s.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("one"), F.sum("score").alias("sum"), F.count("*").alias("n"), F.max_by("score", "rank").alias("last"), F.max("score").alias("top"))
        return by.select("qid", F.col("one").alias(f"{name}1"), ((F.col("sum") + (3 - F.col("n")) * F.col("last")) / 3).alias(f"{name}3"), F.col("top").alias(f"{name}top"))

    j = three(sparse, "sp").join(three(dense, "de"), "qid")
    six = lambda c, name: F.round(c, 6).alias(name)
    return j.select("qid", six(F.col("sp1"), "ce_sp1"), six(F.col("de1"), "ce_de1"), six(F.col("sp3"), "ce_sp3"), six(F.col("de3"), "ce_de3"), six(F.col("sp1") - F.col("de1"), "ce_diff1"), six(F.col("sptop") - F.col("detop"), "ce_diff3"))


def mean_ndcg(scores: DataFrame, qrels: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """scores (qid, unit, score and the columns `by`) -> by, ndcg: the mean over judged queries; judgments are binary."""
    run = scores.join(qrels.select("qid").distinct(), "qid", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("qid", *by).orderBy(F.desc("score"), "unit"))).where(F.col("rank") <= k)
    gain = 1 / F.log2(F.col("rank") + 1.0)
    rel = qrels.select("qid", F.col("doc_id").alias("unit")).distinct()
    ideal = rel.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("unit"))).where(F.col("rank") <= k).groupBy("qid").agg(F.sum(gain).alias("idcg"))
    dcg = run.join(rel, ["qid", "unit"]).groupBy("qid", *by).agg(F.sum(gain).alias("dcg"))
    total = ideal.agg(F.count("*").alias("judged"))
    got = dcg.join(ideal, "qid").groupBy(*by).agg(F.sum(F.col("dcg") / F.col("idcg")).alias("s"))
    return scores.select(*by).distinct().join(got, by, "left").join(F.broadcast(total)).select(*by, F.round(F.coalesce(F.col("s") / F.nullif(F.col("judged"), F.lit(0)), F.lit(0.0)), 6).alias("ndcg"))
