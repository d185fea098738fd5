"""Every stage of the corpus pipeline, on all that its predecessor kept, against a brute-force version in plain Python."""

import collections
import hashlib
import math
import re

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id text lang source n_chars".split()


def words(text):
    return WORD.findall(text or "")


def spark_hash(*values):
    """Spark's xxhash64 of strings, longs, and (seeds) ints given as bytes; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            data = v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little")
            seed = xxhash.xxh64_intdigest(data, seed % (1 << 64))
    return seed - (1 << 64) if seed >> 63 else seed


def brute_quality(rows):
    counted = []
    for r in rows:
        t, w = r["text"] or "", words(r["text"])
        runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        h = [spark_hash(x) for x in w]
        grams = [x % 16384 for x in h] + [spark_hash(a, b) % 16384 for a, b in zip(h, h[1:])]
        good = len(w) >= 50 and not re.search(r"[#*$%&|<>]", t) and len(lines) == len(set(lines)) and not again
        counted.append((r, len(w), len(again), grams, good))
    raw, target = collections.Counter(), collections.Counter()
    for _, _, _, grams, good in counted:
        raw.update(grams)
        target.update(grams if good else ())
    n_raw, n_target = raw.total() + 16384, target.total() + 16384
    ratio = lambda g: math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw)
    out = []
    for r, n, again, grams, _ in counted:
        if n >= 20 and 100 * again <= 30 * n and sum(map(ratio, grams)) / len(grams) >= -0.15:
            out.append(tuple(r))
    return out


def brute_neardup(rows):
    sets = {}
    for r in rows:
        w = words(re.sub("[A-Z]+", lambda m: m.group().lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [tuple(r) for r in rows if find(r["doc_id"]) == r["doc_id"]]


def brute_substrings(rows):
    seen = collections.Counter(tuple(w[i : i + 35]) for w in (words(r["text"]) for r in rows) for i in range(len(w) - 34))
    out = []
    for r in rows:
        w = words(r["text"])
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        if gone:
            text = " ".join(x for j, x in enumerate(w) if j not in gone)
            r = dict(r.asDict(), text=text, n_chars=len(text))
        out.append(tuple(r[c] for c in COLUMNS))
    return out


def brute_mix(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(len(words(r["text"])) for r in by[s]) for s in by}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > 2 * size[s]}
        if not above:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 2.0 * size[s] for s in above}
        left -= sum(target[s] for s in above)
        free -= above
        if not free:
            break
    out = []
    for s in order:
        if not size[s]:
            continue
        whole, part = divmod(target[s] / size[s], 1)
        rest = target[s] - whole * size[s]
        found = []
        for r in by[s]:
            n = len(words(r["text"]))
            found.append((spark_hash(r["doc_id"], r["text"]), n, 1 + math.floor(64 * n / (n + 200)) / 64, r))
        low, high = -40.0, 40.0
        for _ in range(60):
            c = math.exp((low + high) / 2)
            less = sum(n * c * g / (1 + c * g) for _, n, g, _ in found) < rest
            low, high = ((low + high) / 2, high) if less else (low, (low + high) / 2)
        ranked = []
        for h, n, g, r in found:
            u = (spark_hash(h, (7).to_bytes(4, "little")) % (1 << 52) + 0.5) / (1 << 52)
            ranked.append((u / (1 - u) / (math.exp((low + high) / 2) * g), h, n, r))
        taken = 0
        for _, _, n, r in sorted(ranked, key=lambda x: x[:2]):
            extra = part > 0 and n > 0 and taken + n / 2 <= rest
            taken += n
            out += [tuple(r)] * (int(whole) + extra)
    return out


def brute_encode(rows):
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        out.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return out


BRUTE = [brute_quality, brute_neardup, brute_substrings, brute_mix, brute_encode]


@pytest.mark.parametrize("sf", ["0.001"])
def test_each_stage_against_brute_force(spark, tmp_path, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select(*COLUMNS)
    odd = [(10**9, None, None, None, None), (10**9 + 1, "", "en", "web", 0), (10**9 + 2, " \n\t", None, None, 3), (10**9 + 3, "x " * 50_000, "en", None, 100_000)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    for (name, stage), brute in zip(corpus_pipeline.STAGES, BRUTE):
        rows = docs.collect()
        got = stage(spark, docs, f"/root/testdata/sf{sf}")
        if stage is not corpus_pipeline.encode:
            assert got.columns == docs.columns, name
        got.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        names = COLUMNS if stage is not corpus_pipeline.encode else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        have, want = (collections.Counter(x) for x in ([tuple(r[c] for c in names) for r in docs.collect()], brute(rows)))
        assert have == want, (name, len(have - want), len(want - have))
        assert 0 < sum(have.values()), name


def test_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
