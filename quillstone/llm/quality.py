"""Quality rules (operator 8): counting rules, and a hashed n-gram log-likelihood ratio between trusted documents and the raw corpus.

Built-in expressions only.  Counts are kept in a fixed number of buckets, so the model has a fixed size whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "[ \\t-\\r]+"
BUCKETS = 1 << 14
WINDOW = 8
#: Mean natural-log ratio below which a document is rejected.
THRESHOLD = -0.15
#: Documents that stand for good text: long enough, and none of the counting rules sees anything.
TRUSTED = "n_words >= 50 and n_symbols = 0 and n_dup_lines = 0 and n_repeat_words = 0"


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns in a struct `row`, with h (a hash of each word), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Null text has no words."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    out = df.select(row.alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    out = out.withColumn("words", F.when(_trimmed(F.col("t")) == "", F.array().cast("array<string>")).otherwise(F.split(_trimmed(F.col("t")), SPACE)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    out = out.select(
        "row",
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.col("n_words").cast("int")
    windows = F.when(n >= WINDOW, F.transform(F.slice("h", 1, n - WINDOW + 1), lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)])))
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines").withColumn("windows", windows)
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    out = out.withColumn("sorted", F.when(again, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("windows")
    other = lambda k, x: F.coalesce(F.get("sorted", k)["x"] == x, F.lit(False))
    marked = F.transform("sorted", lambda e, j: F.when(F.when(j > 0, other(j - 1, e["x"])).otherwise(False) | other(j + 1, e["x"]), e["i"]))
    out = out.withColumn("at", F.sort_array(F.filter(marked, lambda i: i.isNotNull()))).drop("sorted")
    size = F.transform("at", lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1) - i, F.lit(WINDOW))))
    return out.withColumn("n_repeat_words", F.coalesce(F.aggregate(size, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("at")


def _buckets(buckets: int) -> Column:
    """The bucket of each word and of each pair of neighbours."""
    one = F.transform("h", lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    pairs = F.transform(F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get("h", i), x), F.lit(buckets)).cast("int"))
    return F.concat(one, pairs)


def log_ratios(counted: DataFrame, trusted: str = TRUSTED, buckets: int = BUCKETS) -> DataFrame:
    """One row, `ratios`: log of each bucket's share in trusted documents over its share in all, one added to each count."""
    spark = counted.sparkSession
    grams = counted.select(F.expr(trusted).alias("good"), F.explode(_buckets(buckets)).alias("bucket"))
    seen = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if(F.coalesce("good", F.lit(False))).alias("target"))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(seen, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    table = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("r"), F.sum("target").alias("t"))
    share = lambda x, k, n: F.log((x[k] + 1) / (F.col(n) + buckets))
    return table.select(F.transform("c", lambda x: share(x, "target", "t") - share(x, "raw", "r")).alias("ratios"))


def quality_rules(df: DataFrame, text: str = "text", trusted: str = TRUSTED, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """All rows of df: its columns in a struct `row`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    score is the mean log ratio of a document's words and neighbour pairs, 0 without words.  `trusted` is SQL over the counts.  Empty and null
    texts fail the base rules.  Without any trusted document all ratios favour nothing, and only the base rules decide."""
    counted = with_counts(df, text)
    # a table of fixed size, folded into the plan as one literal
    ratios = F.from_json(F.lit(str(log_ratios(counted, trusted, buckets).first()["ratios"])), "array<double>")
    total = F.aggregate(_buckets(buckets), F.lit(0.0), lambda a, b: a + F.get(ratios, b))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = counted.withColumn("score", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(0.0)).withColumn("base_failed", failed)
    verdict = ~F.col("base_failed") & (F.col("score") >= threshold)
    # a filter on `kept` must not be pushed down: it would hold a second copy of every step it rests on. It stays above a generator.
    judged = F.struct("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", verdict.alias("kept"))
    return out.select(F.explode(F.array(judged)).alias("j")).select("j.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
