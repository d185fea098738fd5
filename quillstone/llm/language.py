"""Language identification (operator 3): averaged embeddings of hashed subwords and a linear softmax, trained by stochastic gradient descent in numpy.

Subwords are runs of 1 to 4 bytes of the lower-cased words with their borders.  The classifier is fitted on a bounded sample of labelled documents
(`per_label` a label, whole texts, as bucket counts of fixed size); every document is predicted from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.bytescan import LOWER, blocks

BUCKETS, DIM, SIZES = 1 << 12, 16, (2, 3, 4)
#: The sample that the classifier is fitted on: at most so many documents a label, and in all (means over hashes of ids).
PER_LABEL, MOST_ROWS = 600, 20_000
EPOCHS, RATE, SEED = 12, 4.0, 11
#: Share of held-back right predictions that may be rejected.
REJECT = 0.01


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The bucket of the gram of each size that starts at each byte; a text ends in spaces, so no gram reaches into another one."""
    low = LOWER[data]
    code = np.where((low < 0x61) & (low != 0x27) | (low > 0x7A) & (low < 0x80), np.uint8(0x20), low).astype(np.uint32)
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(code))
    h = np.zeros(len(code), np.uint32)
    for k in range(max(SIZES)):
        ahead = np.where(at + k < end, np.r_[code[k:], np.zeros(min(k, len(code)), np.uint32)], np.uint32(0x20))
        h = (h * np.uint32(0x01000193)) ^ ahead
        if k + 1 in SIZES:
            yield ((h * np.uint32(0x9E3779B1) + np.uint32(k)) >> np.uint32(20)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: shares of the buckets."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    for g in _grams(data, offsets):
        for d in np.flatnonzero(np.diff(offsets)):
            out[d] += np.bincount(g[offsets[d] : offsets[d + 1]], minlength=BUCKETS)
    return out / np.maximum(len(SIZES) * np.diff(offsets), 1)[:, None].astype(np.float32)


class Model:
    """Labels, folded scores of the buckets, temperature and rejection threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, labels: list[str]):
        rng = np.random.default_rng(SEED)
        self.labels, c = labels, len(labels)
        emb, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, c), np.float32), np.zeros(c, np.float32)
        rows = rng.permutation(len(x))
        back = rows[: len(x) // 5]  # for calibration
        fit = rows[len(x) // 5 :] if len(x) >= 10 else rows
        scale = np.float32(10)
        for epoch in range(EPOCHS):
            rate = np.float32(RATE * (1 - epoch / EPOCHS))
            for a in range(0, len(fit), 32):
                i = np.sort(fit[a : a + 32])
                hidden = scale * (x[i] @ emb)
                p = _softmax(hidden @ out + bias)
                p[np.arange(len(i)), y[i]] -= 1
                p /= len(i)
                back_h = p @ out.T
                out -= rate * 0.1 * hidden.T @ p
                bias -= rate * 0.1 * p.sum(0)
                emb -= rate * scale * (x[i].T @ back_h)
            fit = rng.permutation(fit)
        self.scores = (scale * emb @ out).astype(np.float32)
        self.bias = bias
        self.heat = 1.0
        self.floor = 0.0
        if len(back) and c > 1:
            logit = x[back] @ self.scores + bias
            heats = np.geomspace(0.1, 10, 41)
            loss = [-np.log(np.maximum(_softmax(logit / t)[np.arange(len(back)), y[back]], 1e-12)).mean() for t in heats]
            self.heat = float(heats[int(np.argmin(loss))])
            p = _softmax(logit / self.heat)
            right = p.max(1)[p.argmax(1) == y[back]]
            self.floor = float(np.quantile(right, REJECT)) if len(right) else 0.0

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total = np.zeros((n, len(self.labels)), np.float64)
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            for g in _grams(data, offsets):
                for k in range(len(self.labels)):
                    total[some, k] += np.add.reduceat(self.scores[:, k][g], offsets[some], dtype=np.float64)
            total[some] /= len(SIZES) * np.diff(offsets)[some, None]
        return _softmax((total + self.bias) / self.heat)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(labelled: DataFrame, per_label: int = PER_LABEL, most_rows: int = MOST_ROWS) -> Model | None:
    """labelled: k, t (not null), lang (not null). None if there is nothing to learn from."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    labels = sorted(counts)  # a row for each language
    per_label = min(per_label, most_rows / len(labels))
    place = F.pmod(F.xxhash64("k", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map([x for k in labels for x in (F.lit(k), F.lit(min(1.0, per_label / counts[k])))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, data, offsets in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([x.astype(np.float16).tobytes() for x in 1024 * features(data, offsets)], pa.binary())], ["k", "lang", "x"])

    got = labelled.where(place < share[F.col("lang")]).select(F.xxhash64("k").alias("k"), "t", "lang").mapInArrow(run, "k long, lang string, x binary").toArrow()
    got = got.sort_by([("k", "ascending"), ("lang", "ascending")])
    if not len(got):
        return None
    x = np.stack([np.frombuffer(v.as_buffer(), np.float16) for v in got.column("x")]).astype(np.float32) / 1024
    y = np.array([labels.index(v) for v in got.column("lang").to_pylist()])
    return Model(x, y, labels)


def identify(df: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of df: key, lang_pred, score, rejected.  `und` with score 0, not rejected, for texts that are null or have no letter
    (and for all, without a model); `rejected` where the calibrated score is below the threshold."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.labels, "und"], object)
        for batch in it:
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, offsets in blocks(batch.column(1)):
                p = model.predict(data, offsets)
                ok = letter[a:b]
                score = np.where(ok, p.max(1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names[np.where(ok, p.argmax(1), len(model.labels))], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(ok & (score < model.floor))], ["k", "lang_pred", "score", "rejected"])

    kind = df.schema[key].dataType.simpleString()
    t = F.col(f"`{text}`").cast("string")
    rows = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(t, F.lit("")).alias("t"), F.coalesce(t.rlike("\\p{L}"), F.lit(False)).alias("letter"))
    if model is None:
        out = rows.select("k", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"))
    else:
        out = rows.mapInArrow(run, f"k {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("k", key)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    labelled = docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("k"), F.col("text").alias("t"), "lang")
    got = identify(docs, train(labelled))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
