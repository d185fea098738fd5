"""The training-data operators on edge cases and against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillstone.llm import bpe, katz, language, licenses, mixing, neardup, quality, substrings, topk, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k string"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(30, 120))) for _ in range(40)]
    near = []
    for t in base[:10]:
        w = t.split()
        w[len(w) // 2] = "other"
        near.append(" ".join(w))
    shared = " ".join(r.choice(words) for _ in range(50))
    odd = [None, "", "   \n", "one", "two words", base[0], base[0], "x " * 3000, "é日 ### $$ %", base[1] + " " + shared, base[2] + "\n" + shared + " end"]
    return base + near + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "r", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, texts[3], None, None, None, None, None), rows[5]], SCHEMA)


def test_bpe_equals_the_library(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    codec, library = bpe.Codec(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    r = random.Random(1)
    cases = ["", " ", "a<|endoftext|> b", "\x1c a", "aaaa" * 300, "it's 'S", "日本語 x\n\n y", "\n", "a\n"]
    cases += ["".join(r.choice("abcdet \n\t'sé日1,.!$  ") for _ in range(r.randint(0, 50))) for _ in range(2000)]
    for t in cases:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids and codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert codec.digest(t)[:2] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_bpe_columns(spark, docs):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    got = bpe.bpe_decode(bpe.bpe_encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert all((r.text or "") == r.decoded for r in got) and len(got) == docs.count()


def test_substrings(spark, docs):
    rows = docs.collect()
    words = [WORD.findall(r.text or "") for r in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = collections.Counter()
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want[r.doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    got = substrings.substring_dedup(docs).collect()
    assert collections.Counter((r["row"].doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want


@pytest.mark.parametrize("alphabet", [1, 2, 5, 60])
def test_factors_of_a_block(alphabet):
    r = np.random.default_rng(alphabet)
    for _ in range(40):
        size = r.integers(4, 20, r.integers(1, 12))
        words = r.integers(0, alphabet, size.sum()).astype(np.uint64)
        parts = np.split(words, np.cumsum(size)[:-1])
        left = np.concatenate([np.arange(len(p), 0, -1) for p in parts])
        every = [tuple(p[i:].tolist()) for p in parts for i in range(len(p))]
        common = lambda x, y: next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        want = [max((common(x, y) for j, y in enumerate(every) if j != i), default=0) for i, x in enumerate(every)]
        assert substrings.factor_lengths(words, left).tolist() == want
        low, high = substrings.parse(words, size, 4)
        at = 0
        for p, a, b in zip(parts, low, high):
            runs = [i for i in range(len(p)) if want[at + i] >= 4]
            assert (a, b) == ((runs[0], max(i + want[at + i] for i in runs)) if runs else (a, a))
            at += len(p)


def test_equal_keys_do_not_make_equal_stretches(monkeypatch):
    monkeypatch.setattr(substrings, "mix", lambda h: h * np.uint64(0))  # every key collides
    words = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.uint64)
    assert substrings._same_words(words, np.array([3, 3, 3])).tolist() == [0, 1, 0]


def test_periodic_and_repeated_passages(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = ["x y " * 200, "x y " * 40, passage, "a " + passage + " b", passage[:150] + " and more", "z " * 34, "one " + "z " * 35]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = [t.split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    for r in substrings.substring_dedup(frame).collect():
        w = words[r["row"].doc_id]
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert r.n_removed == len(gone) and r.kept == " ".join(x for j, x in enumerate(w) if j not in gone)
    assert substrings.substring_dedup(frame.limit(0)).count() == 0


def test_near_duplicates(spark, docs):
    from pyspark.sql import functions as F

    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    sets = {}
    for r in own.collect():
        w = WORD.findall((r.text or "").lower())
        sets[r.doc_id] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = neardup.near_duplicates(own.select(F.col("doc_id").alias("uid"), F.col("text").alias("t")), 2).collect()
    assert {r.uid: r.component for r in got} == root and {r.uid: r.n for r in got} == {i: len(s) for i, s in sets.items()}


def _set(t):
    w = t.split()
    return set(zip(w, w[1:]))


def _roots(texts):
    """Components of the texts by all pairs of their sets, through a matrix of the shared pairs of words."""
    sets = [_set(t) for t in texts]
    column = {}
    has = np.zeros((len(sets), len(set().union(*sets))), np.float32)
    for i, x in enumerate(sets):
        has[i, [column.setdefault(g, len(column)) for g in x]] = 1
    common, size = has @ has.T, has.sum(1)
    linked = 180 * common >= 80 * (size[:, None] + size)
    root = np.arange(len(sets))
    while True:
        now = np.array([root[x].min() for x in linked])
        if (now == root).all():
            return root.tolist()
        root = now


def _components(spark, texts):
    from pyspark.sql import functions as F

    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "uid long, t string").repartition(4, F.col("uid")), 2).collect()
    return [r.component for r in sorted(got)]


@pytest.mark.parametrize("count", [300, 1000, 5000])
def test_near_copies_that_differ_at_the_end(spark, count):
    text = " ".join(f"w{i}" for i in range(100))
    assert set(_components(spark, [f"{text} id{i}" for i in range(count)])) == {0}


def test_copies_of_two_large_nodes_stay_apart(spark):
    one, two = (" ".join(f"{c}{i % 2 and i or c + str(i)}" for i in range(100)) for c in "ab")
    got = _components(spark, [f"{(one, two)[i % 2]} id{i}" for i in range(600)])
    assert set(got[::2]) == {0} and set(got[1::2]) == {1}


def test_hot_templated_source(spark):
    r = random.Random(11)
    body = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(600):
        own = list(body)
        for at in r.sample(range(0, 200, 2), 9):  # two of them have a similarity near 0.7
            own[at] = f"x{i}-{at}"
        other = list(own)
        for at in r.sample([at for at in range(0, 200, 2) if own[at] == body[at]], 10):
            other[at] = f"y{i}-{at}"
        texts += [" ".join(own), " ".join(other)]
    want = _roots(texts)
    linked = sum(want[i] == want[i + 1] for i in range(0, 1200, 2))
    assert linked == 600 and len(set(want)) > 500
    got = _components(spark, texts)
    assert sum(got[i] == got[i + 1] for i in range(0, 1200, 2)) == linked and got == want


def _targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by giving out shares again until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if got[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] for s in capped} | got
        capped |= over


def test_mix(spark, docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.copies <= 2 for r in got)
    assert sorted((r.k or -1, r.copies) for r in got) == sorted((r.k or -1, r.copies) for r in mixing.mix_sources(docs).collect())
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = _targets(sizes)
    own = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        if r.k is not None:
            assert r.source_size == sizes[own[r.k]] and abs(r.target - want[own[r.k]]) < 1e-6 * want[own[r.k]]


def test_taken_words_come_near_their_targets(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.randint(0, 400), f"s{i % 5}" if i % 11 else None) for i in range(6000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), in_bin=16).collect()
    want, taken, size = collections.Counter(), collections.Counter(), {}
    for x in got:
        key = rows[x.k][2]
        taken[key] += x.size * x.copies
        want[key], size[key] = x.target, x.source_size
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    assert all(abs(want[k] - v) < 1e-6 * v for k, v in _targets(sizes).items()) and size == dict(sizes)
    assert all(abs(taken[k] - want[k]) <= 401 for k in want)


def test_inclusion_probabilities_add_up_to_the_words_to_take(spark):
    from pyspark.sql import functions as F

    classes = [(1 + c / 64, 50.0 * (c + 1)) for c in range(64)]
    for rest in (1.0, 20_000.0, 103_000.0):
        frame = spark.createDataFrame([(classes, rest)], "classes array<struct<g double, w double>>, rest double")
        c = frame.select(mixing.odds_factor(F.col("classes"), F.col("rest"))).first()[0]
        assert abs(sum(w * c * g / (1 + c * g) for g, w in classes) - rest) < 1e-6 * rest


def test_quality(spark, docs):
    for r in quality.quality_rules(docs).collect():
        t = r["row"].text or ""
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        at = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(at))
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_language_of_held_out_documents(spark):
    got = language.op3_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(real, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) > 0.97 * len(rows)


def test_language_does_not_read_the_next_text():
    r = np.random.default_rng(1)
    x = r.random((8, language.BUCKETS)).astype(np.float32)
    model = language.Model(x / x.sum(1, keepdims=True), np.arange(8) % 2, ["a", "b"])
    for texts in (["le chat", "zzzz"], ["le chat", "qqqq", ""], ["le chat"]):
        raw = "".join(texts).encode()
        offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
        data = np.frombuffer(raw, np.uint8)
        alone = np.frombuffer(b"le chat", np.uint8), np.array([0, 7])
        assert (language.features(data, offsets)[0] == language.features(*alone)[0]).all()
        assert (model.predict(data, offsets)[0] == model.predict(*alone)[0]).all()


def test_language_without_letters(spark, docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, None).collect()}
    assert set(got.values()) == {("und", 0.0)}


def test_licenses(spark):
    df = spark.createDataFrame([(1, "All Rights-Reserved, x. CC by cc BY"), (2, None), (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (4, "granted free permission")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 6, "cc-by,reserved")
    assert got[3].labels == "mit" and got[3].n_base == 0 and got[2].labels == got[4].labels == ""


def test_a_file_with_all_licenses(spark):
    whole = " ".join(t for t, _ in licenses.TEMPLATES.values())
    apart = " and then some other words follow here ".join(t for t, _ in reversed(licenses.TEMPLATES.values()))
    df = spark.createDataFrame([(1, whole), (2, apart), (3, "no licence at all in here")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    every = sorted(licenses.TEMPLATES)
    for i in (1, 2):
        assert got[i].labels.split(",") == every and got[i].spans == [f"{k}:1.0000" for k in every]
    assert got[3].labels == ""


def test_urls(spark):
    cases = {1: "http://a.Example.com/en/7?x", 2: "https://com/en/", 3: None, 4: "nothing", 5: "x://xcom/en/", 6: "http://b.org?/es/", 7: "http://a.net/x.com/en/", 8: "http://é.net/de/" + "y" * 500}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(list(cases.items()), "page_id long, url string")).collect()}
    assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block")
    assert got[3] == got[4] == ("", "", None, "block") and [got[i][2] for i in (5, 6, 7)] == [None] * 3 and got[8][2] == "net/de/"


def _katz(rows, held):
    """Scores by one table of words and one of bigrams, and the sum of the probabilities after each context."""
    import math

    tokens = [[w.lower() for w in WORD.findall(t or "")] + ["</s>"] for _, t in rows]
    train = [x for x, h in zip(tokens, held) if not h]
    one, two, before = collections.Counter(), collections.Counter(), collections.Counter()
    for x in train:
        one.update(x)
        two.update(zip(["<s>", *x], x))
        before.update(["<s>", *x[:-1]])
    total = sum(one.values())
    n = lambda c: [sum(v == r for v in c.values()) for r in range(katz.K + 2)]
    uni, d = katz.Unigram(total, n(one)), katz.discounts(n(two))
    p1 = lambda w: float(uni(np.array([one[w]]))[0])
    cut = lambda c: c * (d[c] if c <= katz.K else 1 - katz.SPARE)
    after = collections.defaultdict(list)
    for (p, w), c in two.items():
        after[p].append(w)
    alpha = {p: (1 - sum(cut(two[p, w]) for w in ws) / before[p]) / (1 - sum(p1(w) for w in ws)) for p, ws in after.items()}

    def prob(p, w):
        if two[p, w]:
            return cut(two[p, w]) / before[p]
        return alpha.get(p, 1.0) * p1(w)

    scores = [sum(math.log10(prob(p, w)) for p, w in zip(["<s>", *x], x)) for x in tokens]
    base = [sum(math.log10((one[w] + 1) / (total + len(one) + 1)) for w in x) for x in tokens]
    sums = [sum(prob(p, w) for w in [*one, "an unknown word"]) for p in after]
    return total, [(len(x), sum(one[w] > 0 for w in x)) for x in tokens], base, scores, sums


@pytest.mark.parametrize("key", ["long", "string", "decimal(20,0)"])
def test_katz_against_one_table(spark, texts, key):
    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = list(enumerate(texts + [" ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 60))) for _ in range(120)]))
    frame = spark.createDataFrame(rows + [(3, rows[3][1])], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(key)).withColumn("k", F.lit("clash"))
    rows.append(rows[3])
    import zlib

    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    total, counts, base, scores, sums = _katz(rows, held)
    assert all(abs(x - 1) < 1e-9 for x in sums)
    got = katz.score_texts(frame, "crc32(cast(doc_id as string)) % 7 = 2").collect()
    want = sorted((i, h, a, b, total) for (i, _), h, (a, b) in zip(rows, held, counts))
    assert sorted((int(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens) for x in got) == want
    for i, s, t in zip([i for i, _ in rows], base, scores):
        mine = [x for x in got if int(x.doc_id) == i]
        assert all(abs(x.base_score - s) < 1e-6 and abs(x.score - t) < 1e-6 for x in mine)


def test_katz_takes_odd_rows(spark, docs):
    got = katz.score_texts(docs, "crc32(cast(doc_id as string)) % 7 = 2").collect()
    assert len(got) == docs.count() and all(r.score <= 0 and r.n_tokens >= 1 for r in got)
    assert katz.score_texts(docs.limit(0), "true").count() == 0
    assert {(r.score, r.n_known, r.train_tokens) for r in katz.score_texts(docs, "true").collect()} == {(0.0, 0, 0)}


def test_top_k(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(120)] + [(200, None), (250, [float("nan")] * 8), (120, [1.0, None] + [0.0] * 6), (121, []), (None, [1.0] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    m = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows[:120]} | {121: np.zeros(8, int)}
    for q in (0, 50, 100):
        want = sorted(((-int(m[q] @ m[j]), j) for j in m if j != q))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)] == want
    assert {x.query_id for x in got} == {0, 50, 100}
