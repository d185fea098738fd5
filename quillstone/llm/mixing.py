"""Mixing sources to target weights by Pareto order sampling (operator 6).

Built-in expressions only.  A document's expected copies are its source's target over its source's size.  Whole copies are certain; for the rest,
a document's inclusion odds grow with its length (up to twice), times a factor for each source that makes the expected words of the random part
just what is left to take.  Documents are ranked by random odds over inclusion odds and taken in that order until the target is met.  A
source may hold any share of the rows: its order is cut into bins of rank, as many as its documents ask for, sums of bins give the bin in
which the target is met, and only the rows of that bin are ordered one by one.  What is held in one row is a few numbers for each source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.durable import durable

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Classes of length, with one inclusion probability each; documents of a bin of rank, about.
CLASSES, IN_BIN = 64, 1024


def odds_factor(classes, rest):
    """The factor c for which the sum over classes (g, w) of w c g / (1 + c g) is `rest`, by bisection of its logarithm.

    classes: an array of structs g (relative odds), w (words); the sum grows with c from 0 to all words."""
    taken = lambda c: F.aggregate(classes, F.lit(0.0), lambda a, x: a + x["w"] * (c * x["g"]) / (1 + c * x["g"]))

    def halve(a, _):
        mid = (a["low"] + a["high"]) / 2
        less = taken(F.exp(mid)) < rest
        return F.struct(F.when(less, mid).otherwise(a["low"]).alias("low"), F.when(less, a["high"]).otherwise(mid).alias("high"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.struct(F.lit(-40.0).alias("low"), F.lit(40.0).alias("high")), halve)
    return F.exp((ends["low"] + ends["high"]) / 2)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> and target: shares of `share` times all sizes by weight, none above `most` times its source's size; what a
    capped source leaves is shared anew by weight until none is above.

    A source's ratio of target to weight is the same for all that are not capped, and the capped ones are those of the smallest size over
    weight; so one ordering by that quotient finds the border.  There is a row for each source here, not for each document."""
    # two orderings of a table of sources: collected as one array, a source takes a few bytes
    one = sources.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), F.encode(F.coalesce("source", F.lit("")), "utf-8").alias("code"), "source", "source_size"))).alias("s"), F.sum("source_size").alias("all_size"))
    weighed = one.select("all_size", F.transform("s", lambda x, i: F.struct(x["source"].alias("source"), x["source_size"].alias("size"), F.element_at(F.array(*map(F.lit, weights)), F.pmod(i, F.lit(len(weights))) + 1).alias("weight"))).alias("s"))
    ordered = weighed.select("all_size", F.sort_array(F.transform("s", lambda x: F.struct((x["size"] / x["weight"]).alias("quotient"), x["weight"].alias("weight"), x["size"].alias("size"), x["source"].alias("source")))).alias("s"))
    # with the k smallest quotients capped, the others get `level` a weight
    start = F.struct(F.lit(0.0).alias("capped"), F.lit(0).alias("weight"), F.lit(False).alias("done"), F.lit(0.0).alias("level"))
    ordered = ordered.withColumn("total", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["weight"].cast("long")))

    def step(a, x):
        left = F.col("total") - a["weight"]
        level = (share * F.col("all_size") - a["capped"]) / left
        fits = a["done"] | (level <= most * x["quotient"])
        return F.struct(
            F.when(fits, a["capped"]).otherwise(a["capped"] + most * x["size"]).alias("capped"),
            F.when(fits, a["weight"]).otherwise(a["weight"] + x["weight"]).alias("weight"),
            fits.alias("done"),
            F.when(a["done"], a["level"]).when(fits, level).otherwise(F.lit(float("inf"))).alias("level"),
        )

    level = ordered.withColumn("level", F.aggregate("s", start, step)["level"])
    got = level.select("level", F.explode("s").alias("x"))
    return got.select("x.source", F.col("x.size").alias("source_size"), F.least(F.col("level") * F.col("x.weight"), F.lit(most) * F.col("x.size")).alias("target"))


def mix_sources(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, in_bin: int = IN_BIN, seed: int = 7) -> DataFrame:
    """All rows of df by key: `k` (df's key), h (a hash of key and text), size (words), source_size, target, copies.

    Null text has size 0; null is a source of its own, last in order.  Rows that repeat get the same copies each as the order falls, and count each.
    Rows of size 0 get no copy of the random part.  An empty table gives an empty result."""
    col = lambda c: F.col(f"`{c}`")
    docs = df.select(col(key).alias("k"), col(source).cast("string").alias("source"), F.xxhash64(col(key), col(text)).alias("h"), F.coalesce(F.regexp_count(col(text).cast("string"), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long").alias("size"))
    docs = durable(docs.withColumn("class", F.floor(CLASSES * F.col("size") / (F.col("size") + 200.0)).cast("int")))
    g = 1 + F.col("class") / float(CLASSES)
    lengths = docs.groupBy("source", "class").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum("w").alias("source_size"), F.sum("n").alias("n"), F.collect_list(F.struct(g.alias("g"), F.col("w").cast("double").alias("w"))).alias("classes"))
    plan = targets(sizes.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.join(sizes.drop("source_size"), F.col("source").eqNullSafe(F.col("s"))).drop("source")
    plan = durable(plan.withColumn("factor", odds_factor(F.col("classes"), F.col("rest"))).withColumn("bins", F.greatest(F.lit(256), F.ceil(F.col("n") / in_bin))).drop("classes", "n"))
    given = docs.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    u = (F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    given = given.withColumn("rank", F.when((F.col("part") > 0) & (F.col("size") > 0), u / (1 - u) / (F.col("factor") * g)))
    # bins follow the rank's share of (0, 1); a source's sums of them are a small table
    given = given.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("bins")).cast("long"))
    sums = given.where("rank is not null").groupBy("source", "bin", "rest").agg(F.sum("size").alias("in_bin"))
    before = F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    met = sums.withColumn("before", F.coalesce(before, F.lit(0))).where("before < rest and before + in_bin >= rest").select(F.col("source").alias("s"), F.col("bin").alias("at"), "before")
    given = durable(given.join(met, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    border = given.where("bin = at")
    running = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "h").rowsBetween(Window.unboundedPreceding, 0))
    # the document that crosses the target is taken if that brings the sum nearer
    border = border.withColumn("extra", (F.col("before") + running - F.col("size") / 2.0 <= F.col("rest")).cast("long"))
    others = given.where("bin is null or at is null or bin <> at").withColumn("extra", F.when(F.col("rank").isNull(), 0).when(F.col("at").isNull() | (F.col("bin") < F.col("at")), 1).otherwise(0).cast("long"))
    out = others.select("k", "h", "size", "source_size", "target", "whole", "extra").union(border.select("k", "h", "size", "source_size", "target", "whole", "extra"))
    return out.select("k", "h", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mix_sources(docs)
    return got.select(F.col("k").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("long").alias("copies"))
