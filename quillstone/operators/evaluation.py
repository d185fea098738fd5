"""Retrieval and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """run (qid, unit, rank), qrels (qid, doc_id, rel) -> p, r, ap, rr, ndcg at k for each judged query; a query without a run has zeros."""
    ideal = qrels.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")))
    gain = lambda rel, i: (F.pow(F.lit(2.0), rel) - 1) / F.log2(i + 1.0)
    want = ideal.groupBy("qid").agg(F.count("*").alias("n"), F.sum(F.when(F.col("i") <= k, gain(F.col("rel"), F.col("i"))).otherwise(0.0)).alias("idcg"))
    hits = run.where(F.col("rank") <= k).join(qrels, (run.qid == qrels.qid) & (run.unit == qrels.doc_id)).select(run.qid, "rank", "rel")
    order = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    got = hits.withColumn("seen", F.count("*").over(order)).groupBy("qid").agg(F.count("*").alias("h"), F.sum(F.col("seen") / F.col("rank")).alias("ap"), F.min("rank").alias("first"), F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return want.join(got, "qid", "left").select("qid", F.round(z(F.col("h") / k), 6).alias("p"), F.round(z(F.col("h") / F.col("n")), 6).alias("r"), F.round(z(F.col("ap") / F.col("n")), 6).alias("ap"), F.round(z(1 / F.col("first")), 6).alias("rr"), F.round(z(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"))


def running(df: DataFrame, keys: list[str], sums: list[str], bins: int = 64) -> DataFrame:
    """df with, for each column c of `sums`, upto_c: its sum over all rows up to this one in ascending order of the keys, which must tell rows apart.

    Rows are dealt to ranges of the whole key, so that no task orders more than about its share, however often a first key repeats.  The borders come from
    32 * bins rows of least hash; they decide on the balance and on no result.  Sums of whole ranges are at most bins + 1 rows."""
    drawn = df.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(32 * bins).select(F.struct(*keys).alias("k")).orderBy("k").collect()
    borders = [drawn[i].k for i in range(0, len(drawn), max(1, len(drawn) // bins))][1:bins]
    kinds = [df.schema[k].dataType for k in keys]
    marks = F.array(*[F.struct(*[F.lit(v).cast(t).alias(k) for v, t, k in zip(b, kinds, keys)]) for b in borders])
    place = F.size(F.filter(marks, lambda b: b <= F.struct(*keys))) if borders else F.lit(0)
    binned = df.withColumn("range_", place)
    whole = binned.groupBy("range_").agg(*[F.sum(c).alias(f"before_{c}") for c in sums])
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # over bins + 1 rows
    whole = whole.select("range_", *[F.coalesce(F.sum(f"before_{c}").over(earlier), F.lit(0)).alias(f"before_{c}") for c in sums])
    inside = Window.partitionBy("range_").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return binned.join(F.broadcast(whole), "range_").select(*df.columns, *[(F.col(f"before_{c}") + F.sum(c).over(inside)).alias(f"upto_{c}") for c in sums])


def risk_coverage(scored: DataFrame, key: str) -> DataFrame:
    """scored (key, score, y 0/1) -> key, coverage, risk: the share of rows as sure as this one or surer (ties by key), and of wrong ones among them."""
    rows = running(scored.select(key, (-F.col("score")).alias("unsure"), "y", F.lit(1).alias("one")), ["unsure", key], ["one", "y"])
    total = scored.agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(total)).select(key, F.round(F.col("upto_one") / F.col("n"), 6).alias("coverage"), F.round(1 - F.col("upto_y") / F.col("upto_one"), 6).alias("risk"))


def auroc(scored: DataFrame) -> DataFrame:
    """scored (score, y 0/1): rank sum with average ranks of ties, from counts by score."""
    by = scored.groupBy("score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    ranks = running(by, ["score"], ["n"]).withColumn("rank", F.col("upto_n") - F.col("n") + (F.col("n") + 1) / 2)
    a = ranks.agg(F.sum(F.col("pos") * F.col("rank")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return a.select(F.round((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0)), 6).alias("auroc"))
