"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks (operator 10).

1. Anchors: winnowing picks, from every run of `window` words, the smallest hash of `gram` consecutive words.  Equal runs pick the same anchor
   at the same place, so a run can only repeat if its anchor occurs at least twice (counted in Spark over all texts).
2. Reference blocks: a text's runs with one repeated anchor form a stretch of up to 2 * window - gram words.  A block holds the words (64-bit
   hashes, one a word) of all stretches, from all documents, whose anchors fall into its share of the hash space; that is every place where a
   copy of such a run can stand.
3. Parsing: each stretch is factored greedily against its block: the next factor is the longest run of words from here that also stands elsewhere
   in the block (neighbours in the block's suffix order have it).  Factors of `window` words or more are duplicate spans.  A run of that length
   that crosses the border of two factors belongs to neither, so all runs across borders are looked up as well.

Words are compared one by one: the anchor only brings stretches together.  Everything is decided on the input as a whole: every copy of a
repeated passage goes, the first one included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.bytescan import mix, rolling, scan
from quillstone.llm.durable import row_key

WINDOW, GRAM = 35, 12
#: Reference blocks: so many for each shuffle partition (the session's number, which is set to suit the input; 96 at least).
BLOCKS, LEAST = 16, 96
#: Hashes of passages that a task has sent once; a full set is emptied, which only sends some again.
SENT = 200_000


def run_anchors(words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of `window` words inside one text: (start, word where its anchor starts, the anchor's hash); starts count over the block."""
    starts = np.flatnonzero(np.arange(len(h)) + window <= words.first[words.doc + 1]) if len(h) else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    grams, span = rolling(h, gram), window - gram + 1
    at = np.arange(len(grams), dtype=np.int64)
    # smallest gram of `span` consecutive ones, the leftmost on a tie, by doubling
    low, pos, have = grams, at, 1
    while have < span:
        shift = min(have, span - have)
        right = low[shift:] < low[: len(low) - shift]
        pos = np.where(right, pos[shift:], pos[: len(pos) - shift])
        low = np.where(right, low[shift:], low[: len(low) - shift])
        have += shift
    return starts, pos[starts], low[starts]


def _anchors(window: int, gram: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, words in scan(batch.column(1)):
                starts, pos, low = run_anchors(words, words.hashes(), window, gram)
                if len(starts):
                    first = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (words.doc[starts[1:]] != words.doc[starts[:-1]])])
                    yield pa.RecordBatch.from_arrays([pa.array(low[first].view(np.int64)), pa.array(uid[a + words.doc[starts[first]]])], ["anchor", "uid"])

    return run


def _gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, .. of stretches of the given sizes, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def _same_words(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of stretches that lie one after the other: for each the first one with the same words."""
    if not len(size):
        return np.zeros(0, np.int64)
    begin = np.cumsum(size) - size
    inner = np.arange(len(words), dtype=np.uint64) - np.repeat(begin, size).astype(np.uint64)
    key = np.add.reduceat(mix(words + inner * np.uint64(0x9E3779B97F4A7C15)), begin) + size.astype(np.uint64)
    _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    like = at[inverse]
    like = np.where(size[like] == size, like, np.arange(len(size)))
    equal = np.logical_and.reduceat(words == words[_gather(begin[like], size)], begin)  # a key alone proves nothing
    return np.where(equal, like, np.arange(len(size)))


def _stretches(text: str, window: int, gram: int, slices: int):
    """Texts with their repeated anchors -> for each block, the words of the stretches around them and where they stand."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in it:
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            values, offsets = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))]
            for a, b, words in scan(batch.column(1).field(text)):
                h = words.hashes()
                starts, pos, low = run_anchors(words, h, window, gram)
                known = np.unique(values[offsets[a] : offsets[b]])
                if not len(starts) or not len(known):
                    continue
                use = known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low
                starts, pos, low = starts[use], pos[use], low[use]
                if not len(starts):
                    continue
                edge = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (starts[1:] != starts[:-1] + 1) | (words.doc[starts[1:]] != words.doc[starts[:-1]])])
                first, low = starts[edge], low[edge]
                size = starts[np.r_[edge[1:], len(starts)] - 1] - first + window
                doc = words.doc[first]
                owner, place = uid[a + doc], (first - words.first[doc]).astype(np.int64)
                like = _same_words(h[_gather(first, size)], size)
                # stretches that repeat inside the batch are settled here; their words go to the block once a task, without a place
                twice = np.bincount(like, minlength=len(like))[like] > 1
                witness = []
                for i in np.unique(like[twice]).tolist():
                    print_ = hashlib.blake2b(h[first[i] : first[i] + size[i]].tobytes(), digest_size=16).digest()
                    if print_ not in sent:
                        sent.add(print_)
                        witness.append(i)
                if len(sent) > SENT:
                    sent.clear()
                once = np.flatnonzero(~twice)
                send = np.r_[once, np.array(witness, np.int64)]
                where = np.r_[place[once], np.full(len(witness), -1)]
                yield from _deal(0, h, first[send], size[send], owner[send], where, low[send], slices)
                yield from _deal(1, h, first[twice], size[twice], owner[twice], place[twice], mix(owner[twice].view(np.uint64)), slices)

    return run


def _deal(settled: int, h: np.ndarray, first: np.ndarray, size: np.ndarray, owner: np.ndarray, place: np.ndarray, by: np.ndarray, slices: int) -> Iterator[pa.RecordBatch]:
    """Packs stretches by block, one row for each block that gets any; settled ones without their words."""
    part = (by % np.uint64(slices)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(slices + 1))
    used = np.flatnonzero(np.diff(edges))
    if not len(used):
        return
    pack = lambda x, kind: pa.array([x[order[edges[s] : edges[s + 1]]].astype(kind).tobytes() for s in used], pa.binary())
    texts = [b"" if settled else h[_gather(first[o], size[o])].tobytes() for o in (order[edges[s] : edges[s + 1]] for s in used)]
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([settled] * len(used), pa.int32()), pa.array(texts, pa.binary()), pack(size, np.uint8), pack(owner, np.int64), pack(place, np.int32)], ["slice", "settled", "words", "size", "owner", "place"])


def factor_lengths(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each position of a block, the number of words from there that also stand at another position; `left` words are left in its stretch.

    Prefixes of 1, 2, 4, .. words are numbered in order; neighbours in the last order share the longest prefixes."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    ranks, step = [np.unique(words, return_inverse=True)[1].astype(np.int64)], 1
    at = np.arange(n)
    while step < left.max():
        r = ranks[-1]
        pair = r * (n + 1) + np.where(left > step, r[np.minimum(at + step, n - 1)] + 1, 0)
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    i, j = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = np.minimum(i + common, n - 1), np.minimum(j + common, n - 1)
        # a number stands for 2^k words where so many are left; where they are not, the prefix is shorter
        fits = (left[i] - common >= 1 << k) & (left[j] - common >= 1 << k) & (ranks[k][x] == ranks[k][y])
        common += np.where(fits, 1 << k, 0)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, i, common)
    np.maximum.at(out, j, common)
    return out


def parse(words: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors stretches that lie one after the other against each other; of each, the begin and end of its duplicate span (equal: none).

    All duplicate runs of a stretch hold its anchor, so they make one span."""
    begin = np.cumsum(size) - size
    left = np.repeat(begin + size, size) - np.arange(len(words))
    longest = factor_lengths(words, left)
    edge = np.zeros(len(words) + 1, np.int64)  # runs that start near a border
    low, high = np.full(len(size), np.iinfo(np.int64).max), np.zeros(len(size), np.int64)
    at, who = begin.copy(), np.arange(len(size))
    while len(at):  # the next factor of every stretch that is not at its end
        f = longest[at]
        hit = f >= window
        low[who[hit]] = np.minimum(low[who[hit]], at[hit])
        high[who[hit]] = np.maximum(high[who[hit]], at[hit] + f[hit])
        to = at + np.maximum(f, 1)
        np.add.at(edge, np.maximum(to - window + 1, begin[who]), 1)
        np.add.at(edge, to, -1)
        go = to < begin[who] + size[who]
        at, who = to[go], who[go]
    cross = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & (longest >= window))
    who = np.searchsorted(begin, cross, "right") - 1
    np.minimum.at(low, who, cross)
    np.maximum.at(high, who, cross + longest[cross])
    low = np.where(high > 0, low, begin)
    return low - begin, np.maximum(high, low) - begin


def _block(rows: list, window: int) -> pa.RecordBatch:
    """One reference block: the stretches of a slice from all texts -> duplicate spans of documents."""
    get = lambda rs, k, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(r[k], kind) for r in rs]])
    entries, direct = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
    words, size, owner, place = get(entries, 1, np.uint64), get(entries, 2, np.uint8).astype(np.int64), get(entries, 3, np.int64), get(entries, 4, np.int32).astype(np.int64)
    like = _same_words(words, size)
    own = np.unique(like)
    begin = np.cumsum(size) - size
    low, high = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    low[own], high[own] = parse(words[_gather(begin[own], size[own])], size[own], window)
    # stretches that stand twice are whole duplicates: a witness stands for two
    times = np.bincount(like, weights=np.where(place < 0, 2, 1), minlength=len(like))[like]
    low, high = np.where(times > 1, 0, low[like]), np.where(times > 1, size, high[like])
    use = (high > low) & (place >= 0)
    owner = np.r_[owner[use], get(direct, 3, np.int64)]
    span = np.r_[(place[use] + low[use]) * 64 + high[use] - low[use], get(direct, 4, np.int32).astype(np.int64) * 64 + get(direct, 2, np.uint8)]
    order = np.lexsort((span, owner))
    owner, span = owner[order], span[order]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(owner[first], pa.int64()), pa.ListArray.from_arrays(pa.array(np.r_[first, len(owner)].astype(np.int32)), pa.array(span, pa.int64()))], ["uid", "spans"])


def _blocks(window: int):
    """Rows sorted by block -> duplicate spans, block by block."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in it:
            for s, *row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(i).to_pylist() for i in range(2, 6))):
                if s != now:
                    if rows:
                        yield _block(rows, window)
                    now, rows = s, []
                rows.append(row)
        if rows:
            yield _block(rows, window)

    return run


def duplicate_spans(rows: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """rows: uid, row (a struct with the text) -> uid, spans array<long>: duplicate spans, as 64 * first word + number of words.

    The whole struct goes through the join with the anchors, so that Spark shuffles the rows once for this join and the caller's."""
    if 2 * window - gram > 63:
        raise ValueError("a stretch is at most 63 words")
    slices = BLOCKS * max(LEAST, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    anchors = rows.select("uid", F.coalesce(F.col(f"row.`{text}`"), F.lit("")).alias("t")).mapInArrow(_anchors(window, gram), "anchor long, uid long")
    repeated = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    known = anchors.distinct().join(repeated, "anchor", "left_semi").groupBy("uid").agg(F.collect_list("anchor").alias("anchors"))
    found = rows.join(known, "uid").select("uid", "row", "anchors").mapInArrow(_stretches(text, window, gram, slices), "slice int, settled int, words binary, size binary, owner binary, place binary")
    spans = found.repartition("slice").sortWithinPartitions("slice").mapInArrow(_blocks(window), "uid long, spans array<long>")
    return spans.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _cover(offsets: np.ndarray, values: np.ndarray, words, a: int, b: int) -> np.ndarray:
    """Which words of the block stand in a duplicate span."""
    doc = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
    span = values[offsets[a] : offsets[b]]
    at = words.first[doc] + (span >> 6)
    edge = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (span & 63), -1)
    return np.cumsum(edge)[: len(words.doc)] > 0


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().fill_null(0))
    return np.r_[0, np.cumsum(size)], column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _kept(data: np.ndarray, words, drop: np.ndarray, doc: int) -> bytes:
    """The kept words of one text, joined by single spaces."""
    lo, hi = words.first[doc], words.first[doc + 1]
    keep = ~drop[lo:hi]
    if not keep.any():
        return b""
    s, e = words.starts[lo:hi][keep], words.ends[lo:hi][keep]
    size = e - s + 1
    ends = np.cumsum(size)
    at = np.arange(ends[-1] - 1) + np.repeat(s - (ends - size), size)[:-1]
    out = data[np.minimum(at, len(data) - 1)]
    out[ends[:-1] - 1] = 0x20
    return out.tobytes()


def _trim(text: str, digest: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            offsets, values = _lists(batch.column(1))
            for a, b, words in scan(batch.column(0).field(text)):
                drop = _cover(offsets, values, words, a, b)
                sums = np.r_[0, np.cumsum(drop)]
                removed = sums[words.first[1:]] - sums[words.first[:-1]]
                kept = [_kept(words.data, words, drop, d) for d in range(b - a)]
                out = pa.array([hashlib.sha256(x).hexdigest() for x in kept]) if digest else pa.array([x.decode() for x in kept], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), out], ["row", "n_words", "n_removed", "kept"])

    return run


def substring_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """Returns all rows and columns of df in a struct `row`, with n_words, n_removed and `kept`: the text without any word in a duplicate span, its
    words joined by one space (its SHA-256 with `digest`).  Null and empty text: no words, empty `kept`.  Rows that repeat, with or without a key, are
    copies of each other, so all their runs of `window` words go.  The columns of df may have any name."""
    rows = df.select(F.expr(row_key(f"`{key}`", f"`{text}`")).alias("uid"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    places = duplicate_spans(rows, text, window, gram)
    schema = rows.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return rows.join(places, "uid", "left").select("row", "spans").mapInArrow(_trim(text, digest), schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = substring_dedup(docs, digest=True)
    return got.select("row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
