"""Near-duplicate detection by the chosen-path set similarity join (operator 7).

* Texts with the same shingle set are one class from the start; the rest works on class representatives.
* A tree puts representatives into nodes: a node picks one or two of the minwise functions (1.5 on average, more than 1/similarity, so that a
  linked pair stays together although its signatures may show a lower similarity than its sets) and sends each member to the child of each
  function's minwise token.  The first level goes by whole tokens and is one shuffle; a row carries a packed sketch of four bits a function,
  by which deeper levels branch where the row is.
* A task solves a node of up to HELD members (a few MB of sketches) by itself: up to LEAF members are compared exhaustively; larger nodes whose
  members differ branch again, each by its own decision; a node whose members are alike is compared whole, as branching would not part it.
  Nodes above HELD branch again in Spark, and what is still large after DEPTH levels meets in pairs of blocks, so no pair is lost there either.
* Independent trees are repeated: a pair whose signatures agree in 0.8 of places stays together with 0.88 a level, so all trees lose it in
  3e-6 of cases after one level, in 2e-4 after three.
* Round one verifies few pairs of each member (its first and best partner, and the centre of a large node of alike texts) on the full sets and
  finds components; round two brings the full sets of members that may have a partner in another component to their nodes, and compares all
  of them there.  No partner or candidate is capped: what round one leaves out joins texts that are in one component already, or it comes up in
  round two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.bytescan import mix, rolling, scan
from quillstone.llm.components import connected
from quillstone.llm.durable import durable

FUNCTIONS, TREES, LEAF, DEPTH = 64, 6, 256, 4
#: Members of a node that one task solves by itself: 8192 sketches are 0.3 MB.
HELD = 8192
#: Members of a large node that meet in one block pair, from either side.
SIDE = 1024
#: Pairs of one text that are verified in one place.
PAIRS = 2048
#: Bits of the filter of texts whose sets are wanted: 4 MB, whatever the input; a full filter only prunes less.
FILTER_BITS = 1 << 25
#: Four-bit sketch tokens out of FUNCTIONS that must agree: four standard deviations below what a pair of similarity 0.8 shows.
AGREE = 38
#: Tokens that agree with the commonest ones of a node, on average, where branching would hardly part it.
ALIKE = 32
_SEEDS = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_NEVER = np.uint64(0x2545F4914F6CDD1D)


def shingles(words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, offsets of the texts): texts with fewer words than `size`, but one at least, have one shingle of all words."""
    n = words.counts
    number = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    offsets = np.r_[0, np.cumsum(number)]
    out = np.empty(offsets[-1], np.uint64)
    long = np.repeat(n >= size, number)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], number) + np.repeat(words.first[:-1], number)
    if long.any():
        out[long] = rolling(h, size)[at[long]]
    for d in np.flatnonzero((n > 0) & (n < size)):
        out[offsets[d]] = rolling(h[words.first[d] : words.first[d + 1]], int(n[d]))[0] ^ np.uint64(n[d])
    return out, offsets


def _sign(size: int):
    """Texts -> uid, size and 128-bit hash of the shingle set, minwise signature."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, words in scan(batch.column(1), lower=True):
                sh, offsets = shingles(words, words.hashes(), size)
                some = np.flatnonzero(np.diff(offsets))
                n, one, two = (np.zeros(b - a, np.int64) for _ in range(3))
                for d in some:
                    u = np.unique(sh[offsets[d] : offsets[d + 1]])
                    n[d] = len(u)
                    one[d], two[d] = np.bitwise_xor.reduce(mix(u)).view(np.int64), np.sum(mix(u ^ _NEVER), dtype=np.uint64).view(np.int64)
                sig = np.empty((len(some), FUNCTIONS), np.uint32)
                for k, seed in enumerate(_SEEDS if len(some) else ()):
                    low = np.minimum.reduceat(sh * seed, offsets[some])
                    sig[:, k] = (mix(low ^ seed) >> np.uint64(32)).astype(np.uint32)
                packed = np.full(b - a, None, object)
                for i, d in enumerate(some):
                    packed[d] = sig[i].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(one), pa.array(two), pa.array(packed, pa.binary())], ["uid", "n", "one", "two", "sig"])

    return run


def _matrix(column, kind, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(-1, width)


def _sketches(rows: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, 32 * len(rows) + 1, 32, dtype=np.int32)), pa.py_buffer(rows.tobytes())])


def _choices(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The functions that nodes pick: (place in `node`, function), 1.5 of them on average."""
    pick = mix(node + _NEVER)
    first = pick % np.uint64(FUNCTIONS)
    second = (first + np.uint64(1) + (pick >> np.uint64(8)) % np.uint64(FUNCTIONS - 1)) % np.uint64(FUNCTIONS)
    also = np.flatnonzero((pick >> np.uint64(32)) % np.uint64(2) == 0)
    return np.r_[np.arange(len(node)), also], np.r_[first, second[also]]


def _child(node: np.ndarray, f: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(node * np.uint64(0x9E3779B97F4A7C15) + mix(f << np.uint64(32) | token.astype(np.uint64)))


def _roots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Representatives -> members of the children of all trees' roots."""
    for batch in it:
        if not len(batch):
            continue
        rep, n, comp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        sig = _matrix(batch.column(3), np.uint32, FUNCTIONS)
        low = (sig & np.uint32(15)).astype(np.uint8)
        sketch = low[:, ::2] | low[:, 1::2] << 4
        for tree in range(1, TREES + 1):
            root = np.array([tree], np.uint64)
            for f in _choices(root)[1]:
                node = _child(root, np.array([f]), sig[:, int(f)])
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(rep), pa.array(n), pa.array(comp), _sketches(sketch)], ["node", "rep", "n", "comp", "sketch"])


def _deeper(cols: list) -> list:
    """Members of nodes -> members of their children, by the sketches."""
    node, rep, n, comp, sketch = cols
    row, f = _choices(node.view(np.uint64))
    at = f.astype(np.int64)
    token = sketch[row, at >> 1] >> ((at & 1) << 2).astype(np.uint8) & np.uint8(15)
    return [_child(node.view(np.uint64)[row], f, token).view(np.int64), rep[row], n[row], comp[row], sketch[row]]


def _branch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if len(batch):
            cols = _deeper(_columns(batch))
            for c in range(0, len(cols[0]), 50_000):
                yield pa.RecordBatch.from_arrays([*(pa.array(x[c : c + 50_000]) for x in cols[:4]), _sketches(cols[4][c : c + 50_000])], ["node", "rep", "n", "comp", "sketch"])


def _columns(batch: pa.RecordBatch) -> list:
    return [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)), _matrix(batch.column(4), np.uint8, FUNCTIONS // 2)]


def _same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of packed sketches, row by row: the number of equal tokens."""
    d = x.view(np.uint64) ^ y.view(np.uint64)
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return FUNCTIONS - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)


def _compare(node, rep, n, comp, sketch, spanning: bool, percent: int):
    """All pairs inside nodes (rows sorted by node and n), by distance: (left row, right row, agreeing tokens) of those that may be linked;
    without `spanning`, the rows that are in such a pair of two components, twice."""
    left, right, agreed = [], [], []
    met = np.zeros(len(node), bool)
    lag, at = 1, np.arange(len(node) - 1)
    while len(at):
        at = at[at + lag < len(node)]
        at = at[node[at] == node[at + lag]]
        at = at[100 * n[at] >= percent * n[at + lag]]  # n ascends, so no later row fits either
        test = at[rep[at] != rep[at + lag]]
        if not spanning:
            test = test[comp[test] != comp[test + lag]]
        for c in range(0, len(test), 100_000):
            i = test[c : c + 100_000]
            same = _same(sketch[i], sketch[i + lag])
            ok = same >= AGREE
            if not spanning:
                met[i[ok]] = met[i[ok] + lag] = True
                continue
            left.append(i[ok])
            right.append(i[ok] + lag)
            agreed.append(same[ok])
        lag += 1
    if not spanning:
        return np.flatnonzero(met), np.flatnonzero(met), np.zeros(met.sum(), np.int64)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right, agreed = np.concatenate(left), np.concatenate(right), np.concatenate(agreed).astype(np.int64)
    if len(left):  # of each row, its first partner and its best one
        order = np.lexsort((left, right))
        firsts = order[np.r_[True, right[order][1:] != right[order][:-1]]]
        order = np.lexsort((left, -agreed, right))
        bests = order[np.r_[True, right[order][1:] != right[order][:-1]]]
        use = np.unique(np.r_[firsts, bests])
        left, right, agreed = left[use], right[use], agreed[use]
    return left, right, agreed


def _sorted(cols: list) -> list:
    order = np.lexsort((cols[1], cols[2], cols[0]))
    return [x[order] for x in cols]


def _agreement(sketch: np.ndarray) -> np.ndarray:
    """How many of a node's commonest tokens each member has."""
    out = np.zeros(len(sketch), np.int64)
    for f in range(FUNCTIONS):
        token = sketch[:, f >> 1] >> np.uint8((f & 1) << 2) & np.uint8(15)
        out += token == np.bincount(token, minlength=16).argmax()
    return out


def _spanning(cols: list, agreement: np.ndarray) -> Iterator[tuple]:
    """A large node of alike members, in round one: each with the member nearest to their centre, and all pairs of neighbours in size."""
    node, rep, n, comp, sketch = cols
    centre = int(np.argmax(agreement))
    same, other = _same(sketch, np.broadcast_to(sketch[centre], sketch.shape).copy()), rep != rep[centre]
    yield np.minimum(rep, rep[centre])[other], np.maximum(rep, rep[centre])[other], same[other], node[other]
    yield from _pairs([np.arange(len(node)) // LEAF, rep, n, comp, sketch], True, 0)


def _crossing(cols: list, percent: int) -> np.ndarray:
    """Of a large node: rows that may be linked with one of another component. Each row outside the largest component meets all others."""
    node, rep, n, comp, sketch = cols
    names, number = np.unique(comp, return_inverse=True)
    met, rest = np.zeros(len(node), bool), np.flatnonzero(number != np.bincount(number).argmax())
    for i in rest.tolist():
        lo, hi = np.searchsorted(n, [-(-percent * n[i] // 100), 100 * n[i] // percent + 1])  # n ascends
        ok = _same(sketch[lo:hi], np.broadcast_to(sketch[i], (hi - lo, sketch.shape[1])).copy()) >= AGREE
        ok &= comp[lo:hi] != comp[i]
        if ok.any():
            met[i] = True
            met[lo:hi] |= ok
    return np.flatnonzero(met)


def _pairs(cols: list, spanning: bool, percent: int) -> Iterator[tuple]:
    node, rep, n, comp, sketch = cols
    l, r, agreed = _compare(node, rep, n, comp, sketch, spanning, percent)
    if spanning:
        yield np.minimum(rep[l], rep[r]), np.maximum(rep[l], rep[r]), agreed, np.zeros(len(l), np.int64)
    else:  # members, not pairs: a row for each that has a partner in this node
        yield rep[l], comp[l], n[l], node[l]


def _solve(cols: list, spanning: bool, percent: int, depth: int) -> Iterator[tuple]:
    """Whole nodes, sorted by node and n -> (a, b, agreed, node), or (rep, comp, n, node) without `spanning`."""
    node = cols[0]
    edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    size = np.diff(np.r_[edges, len(node)])
    if not spanning and len(node):  # a node of one component has nothing to join
        mixed = np.minimum.reduceat(cols[3], edges) < np.maximum.reduceat(cols[3], edges)
        keep = np.repeat(mixed, size)
        cols, size = [x[keep] for x in cols], size[mixed]
        edges = np.r_[0, np.cumsum(size)][:-1]
    large = np.repeat(size > LEAF, size)
    yield from _pairs([x[~large] for x in cols], spanning, percent)
    for at, k in zip(edges[size > LEAF].tolist(), size[size > LEAF].tolist()):
        one = [x[at : at + k] for x in cols]
        agreement = _agreement(one[4])
        if depth < DEPTH and agreement.mean() < ALIKE:
            yield from _solve(_sorted(_deeper(one)), spanning, percent, depth + 1)
        elif spanning:
            yield from _spanning(one, agreement)
        else:
            met = _crossing(one, percent)
            yield one[1][met], one[3][met], one[2][met], one[0][met]


def _nodes(spanning: bool, percent: int, held: int | None):
    """Rows sorted by node -> what _solve finds in nodes of up to `held` members (any, if None), and the rows of larger nodes as they are."""

    def found(cols: list) -> Iterator[pa.RecordBatch]:
        for a, b, agreed, node in _solve(cols, spanning, percent, 1):
            if len(a):
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (a, b, agreed, node)), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())], ["a", "b", "agreed", "node", "n", "sketch"])

    def passed(cols: list) -> pa.RecordBatch:
        node, rep, n, comp, sketch = cols
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(comp), pa.array(np.full(len(rep), -1)), pa.array(node), pa.array(n), _sketches(sketch)], ["a", "b", "agreed", "node", "n", "sketch"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list | None = None  # rows of the last node so far
        passing = None  # the large node whose rows are passed on
        for batch in it:
            if not len(batch):
                continue
            cols = _columns(batch)
            if passing is not None:
                same = cols[0] == passing
                if same.any():
                    yield passed([x[same] for x in cols])
                cols = [x[~same] for x in cols]
                if not len(cols[0]):
                    continue
                passing = None
            if keep is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(keep, cols)]
            tail = cols[0] == cols[0][-1]
            done, keep = [x[~tail] for x in cols], [x[tail] for x in cols]
            if len(done[0]):  # a node that ended in this batch may be large as well
                yield from ended(done)
            if held and len(keep[0]) > held:
                yield passed(keep)
                passing, keep = keep[0][0], None
        if keep is not None:
            yield from found(keep)

    def ended(cols: list) -> Iterator[pa.RecordBatch]:
        node = cols[0]
        edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.r_[edges, len(node)])
        over = np.repeat(size > held, size) if held else np.zeros(len(node), bool)
        if over.any():
            yield passed([x[over] for x in cols])
        yield from found([x[~over] for x in cols])

    return run


_ROWS = "node long, rep long, n long, comp long, sketch binary"
_FOUND = "a long, b long, agreed long, node long, n long, sketch binary"


def search(reps: DataFrame, spanning: bool, percent: int) -> DataFrame:
    """Of representatives (rep, n, comp, sig): with `spanning`, pairs (a, b, agreed) that may be linked, few of each member; else the members (node, rep, comp)
    that may be linked with one of another component in the same node."""

    def level(rows: DataFrame, held: int | None) -> DataFrame:
        return rows.repartition("node").sortWithinPartitions("node", "n", "rep").mapInArrow(_nodes(spanning, percent, held), _FOUND)

    found, rows = [], reps.select("rep", "n", "comp", "sig").mapInArrow(_roots, _ROWS)
    for depth in range(DEPTH):
        now = durable(level(rows, HELD))
        found.append(now.where("agreed >= 0"))
        large = now.where("agreed < 0").select("node", F.col("a").alias("rep"), "n", F.col("b").alias("comp"), "sketch")
        if large.isEmpty():
            break
        rows = large.mapInArrow(_branch, _ROWS)
    else:
        found.append(durable(level(_dealt(large) if spanning else _crossed(large), None)).where("agreed >= 0"))
    out = reduce(DataFrame.union, found)
    if not spanning:
        return out.select("node", F.col("a").alias("rep"), F.col("b").alias("comp")).distinct()
    return out.groupBy("a", "b").agg(F.max("agreed").alias("agreed"))


def _dealt(members: DataFrame) -> DataFrame:
    """Members of large nodes, in blocks with the node's two pivots: few pairs, for round one only."""
    member = F.struct(F.expr("xxhash64(rep)").alias("h"), "rep", "n", "comp", "sketch")
    stats = durable(members.groupBy("node").agg(F.ceil(F.count("*") / SIDE).alias("blocks"), F.min(member).alias("low"), F.max(member).alias("high")))
    block = "xxhash64(node, cast({} as long))"  # the hash of an int would be another one
    salted = members.join(stats.select("node", "blocks"), "node").withColumn("node", F.expr(block.format("pmod(xxhash64(rep, node), blocks)")))
    spread = stats.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("node", "block", F.explode(F.array("low", "high")).alias("p"))
    pivots = spread.select(F.expr(block.format("block")).alias("node"), "p.rep", "p.n", "p.comp", "p.sketch")
    return salted.select("node", "rep", "n", "comp", "sketch").union(pivots)


def _crossed(members: DataFrame) -> DataFrame:
    """Members of large nodes, in pairs of blocks: any two members of different components meet in one.

    The node's largest component has blocks of its own, which meet those of the other members only; nodes of one component are left out."""
    count = members.groupBy("node", "comp").agg(F.count("*").alias("k")).groupBy("node").agg(F.sum("k").alias("all"), F.max(F.struct("k", "comp")).alias("top"))
    sides = count.where("`all` > top.k").select("node", F.col("top.comp").alias("main"), F.expr(f"ceil(top.k / {SIDE})").alias("mains"), F.expr(f"ceil((`all` - top.k) / {SIDE})").alias("others"))
    rows = members.join(durable(sides), "node").withColumn("own", F.expr("pmod(xxhash64(rep, node), if(comp = main, mains, others))"))
    outer = "transform(sequence(0L, others - 1), x -> xxhash64(node, 0L, own, x))"
    inner = "concat(transform(sequence(0L, mains - 1), x -> xxhash64(node, 0L, x, own)), transform(sequence(0L, others - 1), x -> xxhash64(node, 1L, least(x, own), greatest(x, own))))"
    return rows.select(F.explode(F.expr(f"if(comp = main, {outer}, {inner})")).alias("node"), "rep", "n", "comp", "sketch")


def _wanted(size: int, bits: np.ndarray):
    """The full shingle sets of the texts that the filter lets pass."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FILTER_BITS)
            hit = np.flatnonzero(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
            if not len(hit):
                continue
            batch = batch.take(pa.array(hit))
            for a, b, words in scan(batch.column(1), lower=True):
                sh, offsets = shingles(words, words.hashes(), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([np.unique(sh[offsets[d] : offsets[d + 1]]).tobytes() for d in range(b - a)], pa.binary())], ["uid", "set"])

    return run


def _bits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        at = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FILTER_BITS)
        yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["at", "bit"])


def _overlap(percent: int):
    """Rows sorted by hub and kind, a hub's own set first -> the pairs (a, hub) whose sets are similar enough."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, None
        for batch in it:
            out: tuple[list, list] = ([], [])
            for b, a, x in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                if a is None:
                    hub, held = b, x.copy()
                    continue
                if b != hub:
                    raise RuntimeError("a pair without its hub's set")
                if 100 * min(len(x), len(held)) < percent * max(len(x), len(held)):
                    continue
                both = np.concatenate([x, held])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(both) - common):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return run


def _sets(reps: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """rep, set: the full shingle sets of reps (a column `rep`), and of some others that a filter of fixed size lets pass."""
    got = reps.select("rep").mapInArrow(_bits, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[got.column("at").to_numpy()] = got.column("bit").to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(it):
        yield from _wanted(size, shared.value)(it)

    return texts.mapInArrow(run, "rep long, set binary")


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    The set of b, which may be in many pairs, goes once to each of its shares of PAIRS pairs."""
    sets = _sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), texts, size)
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).alias("shares"))
    hubs = shares.join(sets.withColumnRenamed("rep", "b"), "b").select("b", F.explode(F.expr("sequence(0L, shares - 1)")).alias("share"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("a"), "set")
    dealt = pairs.join(shares, "b").select("b", F.expr("pmod(xxhash64(a), shares)").alias("share"), F.lit(1).alias("kind"), "a")
    rows = hubs.union(dealt.join(sets.withColumnRenamed("rep", "a"), "a").select("b", "share", "kind", "a", "set"))
    return durable(rows.repartition("b", "share").sortWithinPartitions("b", "share", "kind").mapInArrow(_overlap(percent), "a long, b long"))


def _links(percent: int):
    """Rows sorted by node -> links between components inside nodes; pairs that a link has joined already are passed over."""

    def inside(reps: list, comps: list, sets: list) -> list:
        top: dict[int, int] = {}

        def root(c):
            while top.get(c, c) != c:
                c = top[c]
            return c

        if len(reps) < 2:
            return []
        arrays = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets]
        size = np.array([len(x) for x in arrays])
        names, number = np.unique(comps, return_inverse=True)
        flat, column = np.unique(np.concatenate(arrays), return_inverse=True)
        column = column.astype(np.int32)
        ends = np.r_[0, np.cumsum(size)]
        order = np.argsort(column, kind="stable")
        holder = np.repeat(np.arange(len(reps), dtype=np.int32), size)[order]  # postings: who has a shingle
        first = np.searchsorted(column[order], np.arange(len(flat) + 1))
        out = []
        for i in np.flatnonzero(number != np.bincount(number).argmax()).tolist():
            own = column[ends[i] : ends[i + 1]]
            lo, k = first[own], first[own + 1] - first[own]
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k)
            common = np.bincount(holder[at], minlength=len(reps))
            for j in np.flatnonzero(((100 + percent) * common >= percent * (size[i] + size)) & (number != number[i])).tolist():
                if root(comps[i]) != root(comps[j]):
                    out.append((reps[i], reps[j]))
                    top[root(comps[i])] = root(comps[j])
        return out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, group = None, ([], [], [])
        for batch in it:
            found = []
            nodes, reps, comps = (batch.column(i).to_pylist() for i in range(3))
            for x, *row in zip(nodes, reps, comps, batch.column(3)):
                if x != node:
                    found += inside(*group)
                    node, group = x, ([], [], [])
                for column, value in zip(group, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array([y[k] for y in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        found = inside(*group)
        yield pa.RecordBatch.from_arrays([pa.array([y[k] for y in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def verify_nodes(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """members (node, rep, comp) -> links (a, b) between components: each member's set goes to its nodes once, whatever the number of pairs there."""
    rows = members.join(_sets(members, texts, size), "rep").select("node", "rep", "comp", "set")
    return durable(rows.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(_links(percent), "a long, b long"))


def near_duplicates(texts: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """texts: uid long (not null), t string -> uid, n (size of the shingle set), component (smallest uid reachable), one row for each row.

    Texts without a word are linked with nothing; rows with one uid count as one document."""
    signed = durable(texts.mapInArrow(_sign(size), "uid long, n long, one long, two long, sig binary"))
    classes = signed.where("n > 0").groupBy("n", "one", "two").agg(F.min("uid").alias("rep"), F.min("sig").alias("sig"))
    classes = durable(classes)
    reps = classes.select("rep", "n", "sig")
    # rows that share a uid but not a text join their classes
    member = signed.where("n > 0").join(classes.select("n", "one", "two", "rep"), ["n", "one", "two"]).select("uid", "rep")
    pairs = search(reps.withColumn("comp", F.col("rep")), True, percent)
    both = pairs.union(pairs.select("b", "a", "agreed")).toDF("a", "b", "agreed")
    one = both.groupBy("a").agg(F.min("b").alias("lowest"), F.max(F.struct("agreed", "b")).alias("best"))
    one = one.select("a", F.explode(F.array("lowest", "best.b")).alias("b"))
    first = durable(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = verify(first, texts, size, percent)
    comp = connected(links)
    labelled = reps.join(comp.withColumnRenamed("v", "rep"), "rep", "left").select("rep", "n", F.coalesce("root", "rep").alias("comp"), "sig")
    links = links.union(verify_nodes(durable(search(durable(labelled), False, percent)), texts, size, percent))
    ties = member.where("uid <> rep").groupBy("uid").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    again = ties.where("low <> high").select(F.col("low").alias("a"), F.col("high").alias("b"))
    comp = connected(links.union(again))
    root = member.join(comp.withColumnRenamed("v", "rep"), "rep", "left").groupBy("uid").agg(F.min(F.coalesce("root", "rep")).alias("component"))
    return signed.select("uid", "n").join(root, "uid", "left").select("uid", "n", F.coalesce("component", "uid").alias("component"))


#: Stands in for a null id: above any real one, and the same for equal texts.
def surrogate(key: str, text: str) -> str:
    return f"coalesce(cast({key} as long), 4611686018427387904 + (xxhash64({text}) & 4611686018427387903))"


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.select(F.expr(surrogate("doc_id", "text")).alias("uid"), F.col("text").alias("t"))
    got = near_duplicates(texts, size=2)
    real = lambda c: F.expr(f"case when {c} < 4611686018427387904 then {c} end")
    return got.select(real("uid").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("uid") == F.col("component")).alias("kept"))
