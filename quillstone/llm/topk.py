"""Exact top-k inner products by norm-bucketed retrieval (operator 1).

Candidates are grouped by length into buckets of bounded size.  A query's k-th best score so far, over its length and the bucket's
greatest length, is the least cosine a candidate of the bucket must have.  Above 1 the whole bucket is passed over; a low one leaves the prefix of
long enough candidates (length pruning); a high one is used on the query's largest coordinates: a candidate's unit coordinate must lie in an
interval (coordinate pruning).  What remains is verified by its integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.durable import durable

#: Rows of a bucket and of a block of queries: both bounded, so a block may be broadcast (at 64 coordinates 4 MB).
BUCKET, BLOCK = 4096, 8192
#: Local cosine from which coordinates are pruned, and how many of them.
COSINE, FOCUS = 0.5, 3
#: Products are exact in doubles up to here; beyond, Python integers are used.
EXACT = 2.0**53


def integer_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """id long, v array<double> of floor(256 x), norm2: rows with an id and a vector without null or non-finite components."""
    bad = F.exists(F.col(f"`{vector}`"), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    exact = F.transform(F.col(f"`{vector}`"), lambda x: _floor(256 * x.cast("double")))
    out = df.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(f"`{key}`").cast("long").alias("id"), exact.alias("v"))
    return out.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def _floor(x):
    """floor in doubles: those of 2^52 and more are whole, and the built-in floor returns a long."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def _stack(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b."""
    width = max(a.shape[1], b.shape[1], 1)
    if width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        use = np.flatnonzero(scores >= edge)
        return use[np.lexsort((ids[use], -scores[use]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Bucket:
    """Candidates of similar length, longest first."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        norm = np.sqrt((m * m).sum(1))
        order = np.lexsort((ids, -norm))
        self.ids, self.m, self.norm = ids[order], m[order], norm[order]
        self.unit = None

    def survivors(self, q: np.ndarray, q_norm: float, floor: float) -> np.ndarray | slice:
        """Candidates whose product with q may reach `floor`."""
        if not np.isfinite(floor) or floor <= 0 or q_norm == 0:
            return slice(0, len(self.ids)) if floor <= 0 or not np.isfinite(floor) else slice(0, 0)
        slack = 1 - 1e-9
        long = int(np.searchsorted(-self.norm, -floor / q_norm * slack, "right"))
        if not long:
            return slice(0, 0)
        cosine = floor / (q_norm * self.norm[0]) * slack
        if cosine < COSINE:
            return slice(0, long)
        if self.unit is None:
            self.unit = self.m / np.maximum(self.norm, 1e-300)[:, None]
        keep = np.arange(long)
        for f in np.argsort(-np.abs(q))[:FOCUS]:
            x = q[f] / q_norm
            spread = np.sqrt(max(0.0, (1 - x * x) * (1 - cosine * cosine))) + 1e-9
            p = self.unit[keep, f]
            # the interval of p for which x p + sqrt((1 - x^2)(1 - p^2)) reaches the cosine
            low = -1.0 if -x >= cosine else x * cosine - spread
            high = 1.0 if x >= cosine else x * cosine + spread
            keep = keep[(p >= low) & (p <= high)]
        return keep


def _floors(ids: np.ndarray, m: np.ndarray, bucket: Bucket, k: int) -> np.ndarray:
    """A score that each query's k-th best reaches: from the bucket of the longest candidates."""
    out = np.full(len(ids), -np.inf)
    scores = _products(m, bucket.m)
    for i in range(len(ids)):
        s = scores[i][bucket.ids != ids[i]]
        if len(s) >= k:
            out[i] = np.partition(s, len(s) - k)[len(s) - k]
    return out


def top_k(df: DataFrame, every: int = 50, k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k best other rows for each row whose id is divisible by `every`: query_id, rank, vec_id, score.

    Null ids, null vectors and vectors with null or non-finite components take no part.  Shorter vectors count as ended by zeros.  Rows that repeat
    an id are candidates each, and one of them (the smallest vector) is the query; scores beyond 64 bits are held at the limits.  An empty
    table gives no rows."""
    spark = df.sparkSession
    vectors = durable(integer_vectors(df, vector, key))
    rows, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # borders of length from an approximate quantile sketch; equal lengths are split by a hash of the id
    many = max(1, -(-rows // BUCKET))
    borders = sorted(set(vectors.approxQuantile("norm2", [i / min(many, 200) for i in range(1, min(many, 200))], 0.001))) if many > 1 else []
    band = F.lit(0)
    for b in borders:
        band = band + (F.col("norm2") < b).cast("int")
    banded = vectors.withColumn("band", band)
    sizes = {r["band"]: r["count"] for r in banded.groupBy("band").count().collect()}
    parts = F.create_map([F.lit(x) for b, n in sizes.items() for x in (b, -(-n // BUCKET))])
    placed = banded.withColumn("part", F.pmod(F.xxhash64("id"), parts[F.col("band")]).cast("int"))

    def pack(table):
        ids = table.column("id").to_numpy()
        m = _stack(table.column("v").to_pylist(), width)
        return pa.table({"band": table.column("band")[:1], "part": table.column("part")[:1], "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary())})

    packed = durable(placed.groupBy("band", "part").applyInArrow(pack, "band int, part int, ids binary, m binary"))
    unpack = lambda i, m: (np.frombuffer(i, np.int64), np.frombuffer(m, np.float64).reshape(-1, width))
    first = packed.orderBy("band", "part").first()
    seed = spark.sparkContext.broadcast((first["ids"], first["m"]))
    asked = vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = durable(asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int")))
    found = None
    for block in range(blocks):
        got = asked.where(F.col("block") == block).select("id", "v").toArrow()
        if not len(got):
            continue
        shared = spark.sparkContext.broadcast((got.column("id").to_numpy(), _stack(got.column("v").to_pylist(), width)))

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            norm, floors = np.sqrt((m * m).sum(1)), None
            for batch in it:
                for i in range(len(batch)):
                    if floors is None:
                        floors = _floors(ids, m, Bucket(*unpack(*seed.value)), k)
                    bucket = Bucket(*unpack(batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
                    out = []
                    for j in range(len(ids)):
                        use = bucket.survivors(m[j], norm[j], floors[j])
                        s, who = _products(m[j : j + 1], bucket.m[use])[0], bucket.ids[use]
                        ok = who != ids[j]
                        if np.isfinite(floors[j]):
                            ok &= s >= floors[j]
                        s, who = s[ok], who[ok]
                        top = _best(s, who, k)
                        out += [(ids[j], x, y) for x, y in zip(who[top], s[top])]
                    cols = [np.array(c, np.int64) for c in zip(*out)] or [np.zeros(0, np.int64)] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

        part = packed.repartition(min(many + len(sizes), 100_000), "band", "part").mapInArrow(run, "query_id long, vec_id long, score long")
        found = part if found is None else found.union(part)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
