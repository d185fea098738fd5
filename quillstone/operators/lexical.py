"""Lexical scorers: query terms joined with postings, summed by (qid, unit). A batch of queries is broadcast only below Spark's own size limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.index import Index, analyze, bm25_idf, champions as champion_lists


def query_terms(queries: DataFrame, stem: bool = False) -> DataFrame:
    """qid, term, qtf."""
    return analyze(queries, "qid", "text", stem).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def _matches(index: Index, terms: DataFrame) -> DataFrame:
    return terms.join(index.dictionary, "term").join(index.postings.drop("positions"), "term").join(index.units, "unit").join(F.broadcast(index.stats))


def only(rows: DataFrame, within: DataFrame | None) -> DataFrame:
    """Rows of the candidates (qid, unit), or all."""
    return rows if within is None else rows.join(within, ["qid", "unit"], "left_semi")


def bm25(index: Index, terms: DataFrame, k1: float = 0.9, b: float = 0.4, min_idf: float = 0.0, within: DataFrame | None = None) -> DataFrame:
    """qid, unit, score; `within` (qid, unit) restricts to candidates."""
    m = _matches(index, terms)
    idf, tf = bm25_idf(F.col("df"), F.col("n")), F.col("tf")
    m = m.where(idf >= min_idf) if min_idf else m
    m = m.join(within, ["qid", "unit"], "left_semi") if within is not None else m
    part = F.col("qtf") * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return m.groupBy("qid", "unit").agg(F.round(F.sum(part), 6).alias("score"))


def cosine(index: Index, terms: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """lnc.ltc: query weights normalised over the terms that the dictionary has."""
    m = only(cosine_weights(index, terms).join(index.postings, "term"), within).join(index.units, "unit")
    return m.groupBy("qid", "unit").agg(F.round(F.sum(F.col("w") * (1 + F.log10("tf")) / F.col("lnc")), 6).alias("score"))


def cosine_weights(index: Index, terms: DataFrame) -> DataFrame:
    """qid, term, w: the query's side of the cosine."""
    q = terms.join(index.dictionary, "term").join(F.broadcast(index.stats)).select("qid", "term", ((1 + F.log10("qtf")) * F.log10(F.col("n") / F.col("df"))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("qid")))
    return q.withColumn("w", F.col("w") / F.when(norm == 0, 1.0).otherwise(norm))


def smart(index: Index, terms: DataFrame, scheme: str) -> DataFrame:
    """Any ddd.qqq of tf n/l/b/a, df n/t, norm n/c."""

    def weight(s: str, tf, top):
        w = {"n": tf.cast("double"), "l": 1 + F.log10(tf), "b": F.lit(1.0), "a": 0.5 + 0.5 * tf / top}[s[0]]
        return w * F.log10(F.col("n") / F.col("df")) if s[1] == "t" else w

    d, q = scheme.split(".")
    facts = index.dictionary.join(F.broadcast(index.stats))
    qw = terms.join(facts, "term").withColumn("top", F.max("qtf").over(Window.partitionBy("qid")))
    qw = qw.select("qid", "term", weight(q, F.col("qtf"), F.col("top")).alias("wq"))
    dw = index.postings.drop("positions").join(index.units, "unit").join(facts, "term").select("unit", "term", weight(d, F.col("tf"), F.col("max_tf")).alias("wd"))
    norm = lambda w, by: F.greatest(F.sqrt(F.sum(F.col(w) * F.col(w)).over(Window.partitionBy(by))), F.lit(1e-12))
    qw = qw.withColumn("wq", F.col("wq") / norm("wq", "qid")) if q[2] == "c" else qw
    dw = dw.withColumn("wd", F.col("wd") / norm("wd", "unit")) if d[2] == "c" else dw
    return qw.join(dw, "term").groupBy("qid", "unit").agg(F.round(F.sum(F.col("wq") * F.col("wd")), 6).alias("score"))


def jaccard(index: Index, terms: DataFrame) -> DataFrame:
    """Query terms that the corpus lacks count in the union."""
    m = terms.withColumn("nq", F.count("*").over(Window.partitionBy("qid"))).join(index.postings, "term").groupBy("qid", "unit", "nq").agg(F.count("*").alias("k"))
    return m.join(index.units, "unit").select("qid", "unit", F.round(F.col("k") / F.greatest(F.col("n_distinct") + F.col("nq") - F.col("k"), F.lit(1)), 6).alias("score"))


def many_terms(index: Index, terms: DataFrame, m: int) -> DataFrame:
    """Units with at least min(m, the query's best) distinct query terms."""
    hit = terms.join(index.postings, "term").groupBy("qid", "unit").agg(F.count("*").alias("k"))
    best = F.max("k").over(Window.partitionBy("qid"))
    return hit.withColumn("least", F.greatest(F.lit(1), F.least(F.lit(m), best))).where("k >= least").drop("least")


def zones(body: DataFrame, title: DataFrame, g: float = 0.2) -> DataFrame:
    """(1 - g) body + g title."""
    j = body.withColumnRenamed("score", "sb").join(title.withColumnRenamed("score", "st"), ["qid", "unit"], "full")
    return j.select("qid", "unit", F.round((1 - g) * F.coalesce("sb", F.lit(0.0)) + g * F.coalesce("st", F.lit(0.0)), 6).alias("score"))


def phrase_pairs(index: Index, queries: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """qid, unit, n: neighbouring query terms (different ones) that occur with the same gap."""
    w = Window.partitionBy("qid").orderBy("pos")
    pairs = analyze(queries, "qid", "text").withColumn("t2", F.lead("term").over(w)).withColumn("gap", F.lead("pos").over(w) - F.col("pos")).where("t2 is not null and term <> t2")
    first = only(pairs.join(index.postings.select("unit", "term", F.col("positions").alias("p1")), "term"), within)
    both = first.join(index.postings.select("unit", F.col("term").alias("t2"), F.col("positions").alias("p2")), ["unit", "t2"])
    near = F.arrays_overlap(F.transform("p1", lambda x: x + F.col("gap")), F.col("p2"))
    return both.where(near).groupBy("qid", "unit").agg(F.count("*").alias("n"))


def top(scores: DataFrame, k: int, key: str = "unit") -> DataFrame:
    """The k best of each query, ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def tiered(index: Index, terms: DataFrame, champions: int, least: int) -> DataFrame:
    """Tier 1: queries whose champions cover enough units are scored on those alone; tier 2: the others on all units."""
    few = bm25(index, terms, within=terms.join(champion_lists(index, champions), "term").select("qid", "unit").distinct())
    enough = few.groupBy("qid").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("qid")
    rest = bm25(index, terms.join(enough, "qid", "left_anti"))
    return few.join(enough, "qid", "left_semi").withColumn("tier", F.lit(1)).unionByName(rest.withColumn("tier", F.lit(2)))


def explain(body: Index, title: Index, terms: DataFrame, hits: DataFrame, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """One row for each hit and query term: its counts and its part of the body score; terms that a unit lacks have zeros."""
    tf = F.col("tf")
    rows = hits.select("qid", "unit").join(terms, "qid").join(body.units, "unit").join(F.broadcast(body.stats)).join(body.dictionary, "term", "left")
    rows = rows.join(body.postings.select("unit", "term", "tf"), ["unit", "term"], "left").join(title.postings.select("unit", "term", F.col("tf").alias("ttf")), ["unit", "term"], "left")
    part = F.col("qtf") * bm25_idf(F.col("df"), F.col("n")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    z = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("qid", "unit", "term", "qtf", z(F.col("df")).alias("df"), F.round(z(F.log10(F.col("n") / F.col("df"))), 3).alias("idf"), z(tf).alias("tf"), z(F.col("ttf")).alias("title_tf"), F.round(z(part), 6).alias("part"))


def min_cover(index: Index, terms: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """qid, unit, n, width: the shortest stretch of text with all n query terms that the unit holds; 0 for a single term.

    One pass over the hits in order of position; the state is the last place of each term, as many as a query has terms."""
    hit = only(terms.join(index.postings, "term"), within)
    slot = F.row_number().over(Window.partitionBy("qid", "unit").orderBy("term")) - 1
    flat = hit.withColumn("slot", slot).groupBy("qid", "unit").agg(F.count("*").alias("n"), F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("p"), F.col("slot").alias("s"))))).alias("h"))

    def step(state, h):
        last = F.transform(state["last"], lambda x, i: F.when(i == h["s"], h["p"]).otherwise(x))
        low = F.array_min(last)
        return F.struct(last.alias("last"), F.when(low >= 0, F.least(state["best"], h["p"] - low + 1)).otherwise(state["best"]).alias("best"))

    start = F.struct(F.array_repeat(F.lit(-1), F.col("n").cast("int")).alias("last"), F.lit(2147483647).alias("best"))
    width = F.aggregate(F.sort_array("h"), start, step, lambda state: state["best"])
    return flat.select("qid", "unit", "n", F.when(F.col("n") < 2, 0).otherwise(width).cast("long").alias("width"))
