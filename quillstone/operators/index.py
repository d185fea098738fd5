"""Positional inverted index as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import is_stop, s_stem, tokens


def analyze(df: DataFrame, key: str, text: str, stem: bool = False) -> DataFrame:
    """key, pos, term: positions count stop words, terms do not hold them."""
    out = df.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "term")).where(~is_stop(F.col("term")))
    return out.select(key, "pos", (s_stem(F.col("term")) if stem else F.col("term")).alias("term"))


@dataclass
class Index:
    """postings (unit, term, tf, positions), dictionary (term, df, cf), units (unit, len, lnc, max_tf, n_distinct), stats (n, avg_len, total)."""

    postings: DataFrame
    dictionary: DataFrame
    units: DataFrame
    stats: DataFrame


def build(df: DataFrame, key: str, text: str, stem: bool = False) -> Index:
    postings = analyze(df, key, text, stem).groupBy(F.col(key).alias("unit"), "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    weight = 1 + F.log10("tf")
    sums = postings.groupBy("unit").agg(F.sum("tf").alias("len"), F.sqrt(F.sum(weight * weight)).alias("lnc"), F.max("tf").alias("max_tf"), F.count("*").alias("n_distinct"))
    units = df.select(F.col(key).alias("unit")).join(sums, "unit", "left").select("unit", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("lnc", F.lit(1e-6)).alias("lnc"), F.coalesce("max_tf", F.lit(0)).alias("max_tf"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))
    return Index(postings, dictionary_of(postings), units, stats_of(units))


def dictionary_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def stats_of(units: DataFrame) -> DataFrame:
    return units.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), F.sum("len").alias("total"))


def bm25_idf(df, n):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def champions(index: Index, r: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """The r postings of greatest impact of each term: term, unit, rank."""
    tf = F.col("tf")
    joined = index.postings.join(index.units, "unit").join(F.broadcast(index.stats))
    impact = F.round(tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))), 6)
    ranked = joined.withColumn("impact", impact).withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "unit")))
    return ranked.where(F.col("rank") <= r).select("term", "unit", F.col("rank").cast("long").alias("rank"), "impact")
