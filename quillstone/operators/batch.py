"""A batch of queries against whole texts in one pass: postings of the batch's terms packed by unit, and each query's best units found where the units are.

The batch is held by the driver and each task; units never are, and pairs of query and unit leave a task only if they may be among the best."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import STOP_WORDS
TOKEN = r"[0-9]+(?:\.[0-9]+)?|[a-z0-9]+"
#: Scores are ranked after rounding to six places, so whatever is so near the last place counted stays.
NEAR = 2e-6
#: Cells of queries by units at once, and pairs that wait until the best are picked; both for few sums of a pair, less for many.
CELLS, WAITING = 400_000, 1_000_000


def packed(texts: DataFrame, zones: list[str], terms: list[str]) -> DataFrame:
    """texts (unit, all different, and a text column for each zone) -> unit and for each zone a struct: facts of the whole text, postings of `terms`."""
    kind = "struct<len: long, lnc: double, max_tf: long, n_distinct: long, term: array<string>, tf: array<long>, positions: array<array<int>>>"
    schema = f"unit {texts.schema['unit'].dataType.simpleString()}, " + ", ".join(f"{z} {kind}" for z in zones)
    asked, stop = frozenset(terms), frozenset(STOP_WORDS)

    def facts(text, find):
        tokens = find(text.lower()) if text else []
        counts = Counter(tokens)
        for w in stop & counts.keys():
            del counts[w]
        if not counts:
            return {"len": 0, "lnc": 1e-6, "max_tf": 0, "n_distinct": 0, "term": [], "tf": [], "positions": []}
        by = Counter(counts.values())
        at = {w: [] for w in asked & counts.keys()}
        for i, w in enumerate(tokens):
            if w in at:
                at[w].append(i)
        lnc = math.sqrt(sum(n * (1 + math.log10(tf)) ** 2 for tf, n in by.items()))
        return {"len": sum(tf * n for tf, n in by.items()), "lnc": lnc, "max_tf": max(by), "n_distinct": len(counts), "term": list(at), "tf": [len(p) for p in at.values()], "positions": list(at.values())}

    def run(batches):
        find = re.compile(TOKEN).findall
        inner = pa.struct([("len", pa.int64()), ("lnc", pa.float64()), ("max_tf", pa.int64()), ("n_distinct", pa.int64()), ("term", pa.list_(pa.string())), ("tf", pa.list_(pa.int64())), ("positions", pa.list_(pa.list_(pa.int32())))])
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                cols = [pa.array([facts(x, find) for x in part.column(i + 1).to_pylist()], inner) for i in range(len(zones))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["unit", *zones])

    return texts.select("unit", *zones).mapInArrow(run, schema)


def as_index(pack: DataFrame, zone: str) -> tuple[DataFrame, DataFrame]:
    """Postings of the batch's terms and the facts of all units, as an index has them."""
    z = F.col(zone)
    postings = pack.select("unit", F.explode(F.arrays_zip(z["term"].alias("term"), z["tf"].alias("tf"), z["positions"].alias("positions"))).alias("p")).select("unit", "p.term", "p.tf", "p.positions")
    return postings, pack.select("unit", f"{zone}.len", f"{zone}.lnc", f"{zone}.max_tf", f"{zone}.n_distinct")


#: Candidates up to which a table of them goes to every task; more are joined by Spark's own choice.
FEW = 500_000


def few(pairs: DataFrame) -> DataFrame:
    """Stored candidates, marked for a broadcast if they are few."""
    return F.broadcast(pairs) if pairs.count() <= FEW else pairs


class _Best:
    """Pairs (query, unit) that may be among the k best by one of several scores; of equal scores the k smallest units."""

    def __init__(self, queries: int, scores: int, k: int):
        self.k, self.kept, self.waiting = k, [[] for _ in range(scores)], [0] * scores
        self.least = np.full((scores, queries), -np.inf)

    def put(self, s: int, q, unit, score) -> None:
        good = score >= self.least[s][q] - NEAR
        self.kept[s].append((q[good], unit[good], score[good]))
        self.waiting[s] += int(good.sum())
        if self.waiting[s] > max(20_000, WAITING // len(self.kept)):
            self.pick(s)

    def pick(self, s: int) -> tuple:
        q, unit, score = (np.concatenate(x) for x in zip(*self.kept[s])) if self.kept[s] else (np.empty(0, int),) * 3
        order = np.lexsort((unit, -score, q))
        q, unit, score = q[order], unit[order], score[order]
        n = np.arange(len(q))
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
        same = first | np.r_[True, score[1:] != score[:-1]] if len(q) else first
        rank, tie = n - np.maximum.accumulate(np.where(first, n, 0)), n - np.maximum.accumulate(np.where(same, n, 0))
        last = rank == self.k - 1
        self.least[s][q[last]] = score[last]
        good = (tie < self.k) & (score >= self.least[s][q] - NEAR)
        self.kept[s] = [(q[good], unit[good], score[good])]
        self.waiting[s] = 0
        return self.kept[s][0]


def _zone(column, places, starts, degree):
    """The postings of a chunk of units against the batch: for each meeting (query term of a query, unit) the cell, the query term's row, tf and unit."""
    terms, tf = column.field("term"), column.field("tf")
    counts = np.diff(terms.offsets.to_numpy())
    ids = np.array([places.get(t, -1) for t in terms.flatten().to_pylist()], np.int64)
    unit, tf = np.repeat(np.arange(len(counts)), counts), tf.flatten().to_numpy()
    good = ids >= 0
    ids, unit, tf = ids[good], unit[good], tf[good].astype(float)
    n = degree[ids]
    rep = np.repeat(np.arange(len(ids)), n)
    at = starts[ids][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
    return at, rep, unit, tf


def scores(pack: DataFrame, zones: dict[str, tuple[list, float]], k: int, combine, width: int, mixes: list) -> DataFrame:
    """pack: see packed; zones: for each zone rows (qid, term, weights ..) of the batch and the mean length; combine(weights, tf, len, lnc, mean) -> the
    `width` parts that a meeting of a query's term and a unit adds. Returns qid, unit and the sums of every zone (zone_0 ..) for the pairs that may be
    among the k best by one of the `mixes` (rows of factors of all sums), a few more than those."""
    qids = sorted({r[0] for rows, _ in zones.values() for r in rows})
    place = {q: i for i, q in enumerate(qids)}
    tables = {}
    for z, (rows, mean) in zones.items():
        rows = sorted(rows, key=lambda r: r[1])
        names = sorted({r[1] for r in rows})
        where = {t: i for i, t in enumerate(names)}
        ids = np.array([where[r[1]] for r in rows], np.int64)
        degree = np.bincount(ids, minlength=len(names))
        tables[z] = (where, np.cumsum(degree) - degree, degree, np.array([place[r[0]] for r in rows], np.int64), np.array([r[2:] for r in rows], float).reshape(len(rows), -1) if rows else np.empty((0, width)), mean)
    columns = [f"{z}_{i}" for z in zones for i in range(width)]
    matrix = np.array(mixes)
    cells, most = CELLS * 8 // max(8, len(columns)), WAITING * 4 // max(2, len(columns))

    def run(batches):
        if not qids:
            return
        best, step, seen, rows = _Best(len(qids), len(mixes), k), max(16, cells // len(qids)), 0, []
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = pa.ipc.open_stream(_copy(batch.slice(lo, step))).read_next_batch()
                ids = part.column(0).to_numpy()
                d, total, hit = len(ids), [], None
                for z, (where, starts, degree, q, weights, mean) in tables.items():
                    column = part.column(part.schema.names.index(z))
                    at, rep, unit, tf = _zone(column, where, starts, degree)
                    key = q[at] * d + unit[rep]
                    length, lnc = column.field("len").to_numpy(), column.field("lnc").to_numpy()
                    for c in combine(weights[at], tf[rep], length[unit[rep]], lnc[unit[rep]], mean):
                        total.append(np.bincount(key, c, minlength=len(qids) * d))
                    h = np.bincount(key, minlength=len(qids) * d) > 0
                    hit = h if hit is None else hit | h
                cell = np.nonzero(hit)[0]
                total = np.stack([t[cell] for t in total])
                q, unit = cell // d, ids[cell % d]
                keep = np.zeros(len(cell), bool)
                for s, mix in enumerate(matrix):
                    used = np.nonzero(mix)[0]
                    score = mix[used] @ total[used] if len(used) > 1 else total[used[0]] * mix[used[0]]
                    keep |= score >= best.least[s][q] - NEAR
                    best.put(s, q, unit, score)
                rows.append((q[keep], unit[keep], total[:, keep]))
                seen += int(keep.sum())
                if seen > most:
                    rows, seen = _only(rows, [best.pick(s) for s in range(len(mixes))]), 0
        if rows:
            rows = _only(rows, [best.pick(s) for s in range(len(mixes))])
            q, unit, total = rows[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(qids, np.int64)[q]), pa.array(unit), *[pa.array(t) for t in total]], ["qid", "unit", *columns])

    return pack.select("unit", *zones).mapInArrow(run, "qid long, unit long, " + ", ".join(f"{c} double" for c in columns))


def _copy(batch) -> pa.Buffer:
    """A slice as a batch of its own, offsets from 0."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue()


def _only(rows: list, picked: list) -> list:
    """Of the rows (query, unit, sums) those that some score still keeps."""
    q, unit, total = (np.concatenate(x, axis=-1) for x in zip(*rows))
    pq, pu = np.concatenate([p[0] for p in picked]), np.concatenate([p[1] for p in picked])
    good = np.isin(_ids(q, unit, pq, pu), _ids(pq, pu, pq, pu))
    return [(q[good], unit[good], total[:, good])]


def _ids(q, unit, pq, pu) -> np.ndarray:
    """One number for each (query, unit): the place of the unit among the picked ones, -1 where it is none."""
    names = np.unique(pu)
    if not len(names):
        return np.full(len(q), -1, np.int64)
    at = np.minimum(np.searchsorted(names, unit), len(names) - 1)
    return np.where(names[at] == unit, q * len(names) + at, -1)
