"""Language-model scoring by Katz backoff (operator 9): bigrams over unigrams, Good-Turing discounts, exactly normalised backoff weights.

P(w | p) = d(c) c / c(p) for a bigram seen c times, else alpha(p) P(w); P(w) = d(c) c / N for a word seen c times, else the mass that the
discounts leave, which is the one unknown word's.  alpha(p) = (1 - sum of the seen) / (1 - sum of P over the words seen after p), so the
probabilities after every context, and of all words, add up to 1.  Counts up to K have Good-Turing discounts; larger ones give up SPARE of their
mass, so that no context is without any.

Nothing of the model is broadcast but the words so frequent that they are few.  Training counts, discounts and scores are found where the
n-grams are: a table partitioned by word holds the bigrams of all blocks of documents (counts, and the occurrences to score), a second one,
partitioned by the word before, holds the backoff weights.  A row is one slice's share of a block, in packed columns; the number of slices follows the
number of tokens.  A token is evaluated where its bigram is, and where that is unseen goes on to the table of weights.  Sums go back to the blocks'
documents; terms that depend on the discounts of all bigrams are counted by class and weighed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.llm.bytescan import blocks, NOT_SPACE, Words, mix
from quillstone.llm.durable import durable, release

#: Counts up to here are discounted.
K = 5
#: Share of its mass that a bigram of a larger count gives up.
SPARE = 1e-3
#: Tokens of a slice, about, and documents of a block at most.
IN_SLICE, DOCUMENTS = 1_000_000, 16_000
#: The most frequent words, which rows name by two bytes; a table of fixed size.
CODES = 65_000
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BLOCK = 1 << 21
_ROW = "slice int, kind int, block long, a binary, b binary, c binary, d binary"


def _tokens(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of a batch: first and last row, tokens (words, and one end for each text), text of each token."""
    for a, b, data, offsets in ((lo + a, lo + b, *x) for lo in range(0, len(batch), DOCUMENTS) for a, b, *x in blocks(batch.column(1).slice(lo, DOCUMENTS), most)):
        words = Words(data, offsets, NOT_SPACE, True)
        n = b - a
        at = words.first[1:] + np.arange(n)  # of the ends
        out = np.full(len(words.doc) + n, END, np.uint64)
        keep = np.ones(len(out), bool)
        keep[at] = False
        out[keep] = words.hashes()
        yield a, b, out, np.repeat(np.arange(n), words.counts + 1)


def _unigrams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for a, b, tok, doc in _tokens(batch, BLOCK):
            w, c = np.unique(tok[~held[a:b][doc]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["w", "c"])


def discounts(n: list[int], k: int = K) -> np.ndarray:
    """d[r] for r = 0..k from the numbers n[r] of types seen r times (r = 1..k+1); no discount where Good-Turing has none to give."""
    d = np.ones(k + 1)
    if n[1] and all(n[1 : k + 2]):
        a = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if a < 1 else 1.0
            d[r] = x if 0 < x < 1 else 1.0
    if n[1] and d[1] == 1.0:  # too few counts: halve the singletons, so that some mass is left
        d[1] = 0.5
    return d


class Unigram:
    """Probability of a word from its training count."""

    def __init__(self, total: int, n: list[int]):
        self.total, self.d = total, discounts(n)
        self.left = sum((1 - self.d[r]) * r * n[r] for r in range(1, K + 1)) / total if total else 1.0
        self.scale = 1.0
        if total and self.left <= 0:
            self.left, self.scale = 1 / (total + 1), total / (total + 1)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= K, self.d[np.minimum(c, K)], 1.0)
        return np.where(c > 0, self.scale * d * c / max(1, self.total), self.left)


class Codes:
    """Packs word hashes: two bytes for a frequent word, else two bytes and, at the end, the hash."""

    def __init__(self, names: np.ndarray):
        self.names = np.unique(np.r_[names, START])

    def pack(self, x: np.ndarray) -> bytes:
        at = np.minimum(np.searchsorted(self.names, x), len(self.names) - 1)
        known = self.names[at] == x
        return np.where(known, at, 0xFFFF).astype(np.uint16).tobytes() + x[~known].tobytes()

    def unpack(self, raw: bytes, n: int) -> np.ndarray:
        at = np.frombuffer(raw, np.uint16, n)
        out = self.names[np.minimum(at, len(self.names) - 1)]
        out[at == 0xFFFF] = np.frombuffer(raw, np.uint64, offset=2 * n)
        return out


def _small(x: np.ndarray) -> bytes:
    """A table of counts, one column an item, in one byte each; columns with larger ones follow as (column, count, count, ..)."""
    big = np.flatnonzero((x > 254).any(0))
    y = x.copy()
    y[:, big] = 255
    return y.astype(np.uint8).tobytes() + np.vstack([big[None], x[:, big]]).astype(np.int64).tobytes()


def _counts(raw: bytes, kinds: int, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, kinds * n).reshape(kinds, n).astype(np.int64)
    rest = np.frombuffer(raw[kinds * n :], np.int64).reshape(kinds + 1, -1)
    out[:, rest[0]] = rest[1:]
    return out


def _bigrams(slices: int, hot: np.ndarray, codes):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, part, pack = 0, TaskContext.get().partitionId(), codes.value.pack
        for batch in it:
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, tok, doc in _tokens(batch, BLOCK):
                block = part << 32 | count
                count += 1
                before = np.r_[START, tok[:-1]]
                before[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])] = START
                by = np.where(np.isin(tok, hot), mix(tok ^ before), tok) if len(hot) else tok
                cut = (by % np.uint64(slices)).astype(np.int32)
                order = np.lexsort((before, tok, cut))
                edges = np.searchsorted(cut[order], np.arange(slices + 1))
                train = ~held[a:b]
                rows = []
                for at in np.flatnonzero(np.diff(edges)).tolist():
                    use = order[edges[at] : edges[at + 1]]
                    w, p, d = tok[use], before[use], doc[use]
                    new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (p[1:] != p[:-1])])
                    size = np.diff(np.r_[new, len(w)])
                    word = np.flatnonzero(np.r_[True, w[new][1:] != w[new][:-1]])
                    entries = np.diff(np.r_[word, len(new)])
                    rows.append((at, 0, block, np.r_[len(word), len(new), b - a].astype(np.int32).tobytes() + w[new][word].tobytes() + _small(entries[None]), pack(p[new]), _small(size[None]), (d << 1 | train[d]).astype(np.uint16).tobytes()))
                ids = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.bincount(doc, minlength=b - a))], ["k", "held", "n"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as w:
                    w.write_batch(ids)
                rows.append((int(block % slices), 4, block, sink.getvalue().to_pybytes(), b"", b"", b""))
                yield _batch(rows)

    return run


def _entries(r: dict, codes: Codes) -> tuple:
    """Of a packed row: words and words before of its bigrams, how often each occurs, the number of documents, document and training flag of each."""
    words, n, docs = np.frombuffer(r["a"], np.int32, 3).tolist()
    w = np.frombuffer(r["a"], np.uint64, words, 12)
    w = np.repeat(w, _counts(r["a"][12 + 8 * words :], 1, words)[0])
    return w, codes.unpack(r["b"], n), _counts(r["c"], 1, n)[0], docs, np.frombuffer(r["d"], np.uint16).astype(np.int32)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["slice", "kind", "block", "a", "b", "c", "d"])


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(x, return_inverse=True)
    return u, inverse


def _count(slices: int, unigram: Unigram, hot: dict[int, int], shared):
    """A slice of the bigram table -> sums for documents (0), shares for the table by word before (1), unseen bigrams (2), numbers of counts (3)."""

    def run(table):
        codes = shared.value
        rows = table.to_pylist()
        out = [(r["slice"], 4, r["block"], r["a"], b"", b"", b"") for r in rows if r["kind"] == 4]
        rows = [r for r in rows if r["kind"] == 0]
        if rows:
            w, p, size, docs, flag = zip(*(_entries(r, codes) for r in rows))
            ids = np.array([r["block"] for r in rows])
            del rows
            base = np.r_[0, np.cumsum(docs)].astype(np.int32)
            owner = np.concatenate([(f >> 1) + b for f, b in zip(flag, base)])
            train = np.concatenate(flag) & 1
            w, p, size = np.concatenate(w), np.concatenate(p), np.concatenate(size)
            entry = np.repeat(np.arange(len(w), dtype=np.int32), size)
            seen = np.bincount(entry, weights=train, minlength=len(w)).astype(np.int64)
            _, which = _groups(mix(w * np.uint64(0x9E3779B97F4A7C15) ^ p))
            big = np.bincount(which, weights=seen).astype(np.int64)
            words, word = _groups(w)
            own = np.bincount(word, weights=seen, minlength=len(words)).astype(np.int64)
            for i in np.flatnonzero(np.isin(words, np.fromiter(hot, np.uint64, len(hot)))) if hot else ():
                own[i] = hot[int(words[i])]
            # sums for the documents that have a token here
            c1, r = own[word][entry], big[which][entry]
            ends = (w != END)[entry]
            score = np.where(r > 0, np.log10(np.maximum(r, 1)), np.log10(unigram(own))[word][entry]) - np.where(ends & (c1 > 0), np.log10(np.maximum(c1, 1)), 0)
            has, at = np.unique(owner, return_inverse=True)
            sums = [np.bincount(at, weights=x, minlength=len(has)) for x in (np.log10(c1 + 1), score, c1 > 0, *[r == k for k in range(1, K + 1)], r > K)]
            for i, block in enumerate(ids):
                s = slice(*np.searchsorted(has, base[i : i + 2]))
                out.append((0, 0, int(block), (has[s] - base[i]).astype(np.uint16).tobytes(), sums[0][s].tobytes(), sums[1][s].tobytes(), _small(np.stack([x[s] for x in sums[2:]]).astype(np.int64))))
            # for the table by word before: distinct bigrams of the training texts
            first = np.zeros(len(big), np.int64)
            first[which] = np.arange(len(w))
            first = first[big > 0]
            c, q = big[big > 0], unigram(own)[word[first]]
            befores, at = _groups(p[first])
            share = [np.bincount(at, weights=x, minlength=len(befores)) for x in (q, *[c == k for k in range(1, K + 1)], np.where(c > K, c, 0))]
            part = (befores % np.uint64(slices)).astype(np.int32)
            for s in np.unique(part).tolist():
                m = part == s
                out.append((s, 1, 0, codes.pack(befores[m]), share[0][m].tobytes(), _small(np.stack([x[m] for x in share[1:]]).astype(np.int64)), b""))
            miss = np.flatnonzero(r == 0)
            if len(miss):
                source = np.searchsorted(base, owner[miss], "right") - 1
                context = p[entry[miss]]
                part = (context % np.uint64(slices)).astype(np.int32)
                for s in np.unique(part).tolist():
                    m = np.flatnonzero(part == s)
                    blocks_, k = np.unique(source[m], return_counts=True)
                    m = m[np.argsort(source[m], kind="stable")]
                    out.append((s, 2, 0, codes.pack(context[m]), ids[blocks_].tobytes(), k.astype(np.int32).tobytes(), (owner[miss][m] - base[source[m]]).astype(np.uint16).tobytes()))
            out.append((0, 3, 0, np.bincount(np.minimum(big, K + 2), minlength=K + 3).astype(np.int64).tobytes(), b"", b"", b""))
        return pa.Table.from_batches([_batch(out or [(0, 9, 0, b"", b"", b"", b"")])])

    return run


def _backoff(d: np.ndarray, shared):
    """The table by word before -> for each block, what its unseen bigrams add to documents: log alpha, and the context's count given back."""

    def run(table):
        codes = shared.value
        rows = table.to_pylist()
        part, miss = [r for r in rows if r["kind"] == 1], [r for r in rows if r["kind"] == 2]
        out = []
        if miss:
            none = np.zeros(0, np.uint64)
            words, at = _groups(np.concatenate([none, *[codes.unpack(r["a"], len(r["b"]) // 8) for r in part]]))
            q = np.bincount(at, weights=np.concatenate([np.zeros(0), *[np.frombuffer(r["b"]) for r in part]]), minlength=len(words))
            classes = np.concatenate([np.zeros((K + 1, 0), np.int64), *[_counts(r["c"], K + 1, len(r["b"]) // 8) for r in part]], 1)
            n = np.stack([np.bincount(at, weights=x, minlength=len(words)) for x in classes])
            r = np.arange(1, K + 1)
            total = (n[:K] * r[:, None]).sum(0) + n[K]
            kept = (n[:K] * (r * d[1:])[:, None]).sum(0) + (1 - SPARE) * n[K]
            alpha = alpha_of(total, kept, q)
            before = np.concatenate([none, *[codes.unpack(r["a"], len(r["d"]) // 2) for r in miss]])
            i = np.minimum(np.searchsorted(words, before), max(0, len(words) - 1))
            known = words[i] == before if len(words) else np.zeros(len(before), bool)
            gain = np.where(known, np.log10(alpha[i]) + np.log10(total[i]), 0.0) if len(words) else np.zeros(len(before))
            block = np.concatenate([np.repeat(np.frombuffer(r["b"], np.int64), np.frombuffer(r["c"], np.int32)) for r in miss])
            doc = np.concatenate([np.frombuffer(r["d"], np.uint16) for r in miss])
            order = np.lexsort((doc, block))
            edges = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]])
            for lo, hi in zip(edges, np.r_[edges[1:], len(order)]):
                u, inverse = np.unique(doc[order[lo:hi]], return_inverse=True)
                out.append((0, 5, int(block[order[lo]]), u.tobytes(), np.bincount(inverse, weights=gain[order[lo:hi]]).tobytes(), b"", b""))
        return pa.Table.from_batches([_batch(out or [(0, 9, 0, b"", b"", b"", b"")])])

    return run


def alpha_of(total: np.ndarray, kept: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Backoff weights from context counts, discounted counts (less than the counts) and the lower order's sum over seen words (less than 1)."""
    return (total - kept) / np.maximum(total, 1) / (1 - q)


def _finish(schema: pa.Schema, d: np.ndarray, total: int, kinds: int, texts: int):
    """The sums of one block's documents -> scores."""

    def run(table):
        rows = table.to_pylist()
        ids = [r for r in rows if r["kind"] == 4]
        if not ids:
            return schema.empty_table()
        got = pa.ipc.open_stream(ids[0]["a"]).read_all()
        n = len(got)
        counts, base, score = np.zeros((K + 2, n)), np.zeros(n), np.zeros(n)
        for r in rows:
            if r["kind"] in (0, 5):
                at = np.frombuffer(r["a"], np.uint16)
            if r["kind"] == 0:
                counts[:, at] += _counts(r["d"], K + 2, len(at))
                base[at] += np.frombuffer(r["b"])
                score[at] += np.frombuffer(r["c"])
            elif r["kind"] == 5:
                score[at] += np.frombuffer(r["b"])
        tokens = got.column("n").to_numpy()
        score += np.log10(np.r_[d[1:], 1 - SPARE]) @ counts[1:] - (np.log10(texts) if texts else 0)
        cols = [got.column("k"), got.column("held"), pa.array(tokens), pa.array(counts[0].astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(base - tokens * np.log10(total + kinds + 1)), pa.array(score)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def score_texts(df: DataFrame, held: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of df: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    `held` is SQL for rows that are not learned from; null counts as true.  Null and empty texts are one end token.  Without training texts every word is
    unseen: score 0, as all mass is the unknown word's.  Rows that repeat are scored, and learned from, each.  df must come from a scan, which gives
    the same partitions if a task is repeated."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), F.coalesce(F.expr(held), F.lit(True)).alias("held"))
    words = durable(rows.mapInArrow(_unigrams, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    stats = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), *[F.count_if(F.col("c") == r) for r in range(1, K + 2)], F.coalesce(F.max(F.when(F.col("w") == int(END.view(np.int64)), F.col("c"))), F.lit(0))).first()
    total, kinds, texts = stats[0], stats[1], stats[-1]
    tokens = rows.agg(F.coalesce(F.sum(F.coalesce(F.regexp_count("t", F.lit("[^ \\t-\\r]+")), F.lit(0)) + 1), F.lit(0))).first()[0] if total == 0 else None
    slices = max(64, -(-(tokens or total) // IN_SLICE))
    unigram = Unigram(total, [0, *stats[2:-1]])
    # words of more than a quarter of a slice: fewer than 4 * slices of them; their bigrams are dealt out by both words
    hot = {int(np.int64(r["w"]).view(np.uint64)): r["c"] for r in words.where(F.col("c") > max(1, total // (4 * slices))).collect()}
    names = words.orderBy(F.desc("c"), "w").limit(CODES).select("w").toArrow().column(0).to_numpy().view(np.uint64)
    codes = spark.sparkContext.broadcast(Codes(names))
    del words
    release(spark)
    pairs = rows.mapInArrow(_bigrams(slices, np.fromiter(hot, np.uint64, len(hot)), codes), _ROW)
    counted = durable(pairs.groupBy("slice").applyInArrow(_count(slices, unigram, hot, codes), _ROW))
    del pairs
    release(spark)
    n = sum((np.frombuffer(r["a"], np.int64) for r in counted.where("kind = 3").select("a").collect()), np.zeros(K + 3, np.int64))
    d = discounts([0, *n[1 : K + 2].tolist()])
    unseen = counted.where("kind in (1, 2)").groupBy("slice").applyInArrow(_backoff(d, codes), _ROW)
    out = pa.schema([("k", to_arrow_type(df.schema[key].dataType)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    kind = df.schema[key].dataType.simpleString()
    final = counted.where("kind in (0, 4)").union(unseen.where("kind = 5")).groupBy("block").applyInArrow(_finish(out, d, total, kinds, texts), f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return final.withColumnRenamed("k", key)


def op9_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, "crc32(cast(doc_id as string)) % 7 = 2")
