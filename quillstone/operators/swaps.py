"""Claims whose telling word is swapped for one as rare that their evidence does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import corruption as X
from quillstone.functions import text as T
from quillstone.operators.index import Index

#: Terms of one document frequency that are looked at, by hash, and the difference of idf that passes for equal.
TRIES, NEAR = 400, 0.25


def entity_swap(claims: DataFrame, index: Index, tries: int = TRIES) -> DataFrame:
    """claims (qid, claim, evidence) -> qid, claim, word, put, entity: the claim's word of highest idf that the evidence has, what stands for it, and the
    altered text.  Claims without such a word, or whose evidence has all terms tried, give no row.

    Terms are drawn by a hash: `tries` of each document frequency, so rare terms, of which there are most, do not all meet every claim."""
    idf = F.round(F.log10(F.col("n") / F.col("df")), 9)
    terms = index.dictionary.join(F.broadcast(index.stats.select("n"))).select("term", "df", idf.alias("idf"))
    has = claims.select("qid", F.explode(F.array_distinct(T.tokens(F.col("evidence")))).alias("term"))
    words = claims.select("qid", F.explode(F.array_distinct(F.regexp_extract_all("claim", F.lit("[A-Za-z][A-Za-z0-9-]{3,}"), F.lit(0)))).alias("word")).withColumn("term", F.lower("word"))
    words = words.where(~T.is_stop(F.col("term")) & ~F.col("term").isin(sorted(X.opposites())))
    telling = words.join(has, ["qid", "term"], "left_semi").join(terms, "term").groupBy("qid").agg(F.max(F.struct("idf", "word")).alias("m")).select("qid", F.col("m.idf").alias("target"), F.col("m.word").alias("word"))
    turn = F.row_number().over(Window.partitionBy("df").orderBy(F.md5(F.col("term").cast("binary")), "term"))
    pool = terms.where(F.col("term").rlike("^[a-z][a-z0-9]{3,}$") & ~T.is_stop(F.col("term"))).withColumn("turn", turn).where(F.col("turn") <= tries)
    band = F.floor(F.col("idf") / NEAR)
    near = telling.withColumn("band", F.explode(F.sequence(F.floor(F.col("target") / NEAR) - 1, F.floor(F.col("target") / NEAR) + 1)))
    pairs = near.join(pool.select(F.col("term"), "idf", band.alias("band")), "band").where((F.round(F.abs(F.col("idf") - F.col("target")), 9) < NEAR) & (F.col("term") != F.lower("word")))
    free = pairs.join(has, ["qid", "term"], "left_anti")
    order = F.struct(F.md5(F.concat_ws(":", F.col("qid").cast("string"), "term").cast("binary")).alias("h"), F.col("term"))
    picked = free.groupBy("qid", "word").agg(F.min(order).alias("m")).select("qid", "word", F.col("m.term").alias("put"))
    return claims.join(picked, "qid").select("qid", "claim", "word", "put", X.swap_word(F.col("claim"), F.col("word"), F.col("put")).alias("entity"))
