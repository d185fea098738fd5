"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.durable import durable


def _print(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def connected(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (v, root): each vertex that has a link to another one, and the smallest vertex that it reaches.

    The number of rounds grows with the logarithm of the longest path; tables are written to the shared folder after each round."""
    edges = durable(links.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct())
    seen = _print(edges)
    while seen[0]:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = durable(small.where("a <> b").distinct())
        now = _print(edges)
        if now == seen:
            break
        seen = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("v"), "root")
    return durable(roots.union(edges.select("b", "b").distinct().toDF("v", "root").join(roots.select("v"), "v", "left_anti")))
