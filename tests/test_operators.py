import math
import statistics

import duckdb
import pytest

from quillstone.functions import text as T
from quillstone.operators import boolean
from quillstone.plans import queries as plans
from quillstone.plans import audit, correction, ranking  # noqa: F401
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    return sorted([tuple(round(float(r[n]), 5) if isinstance(r[n], float) else str(r[n]) for n in names) for r in data], key=str)


@pytest.mark.parametrize("name", ["T9_sentences", "T10_numbers", "I1_postings", "L3_zones", "L10_smart_anc_ltc", "B5_phrase", "K7_rrf", "D4_cluster_search", "M1_M5_per_query", "C3_chunk_window", "L9_tiered_search", "L14_min_cover_window", "K13_rerank_append", "Q8_oracle_alpha", "R8_scope_gate", "P8_correct_token", "P9_correct_query", "X4_entity_swap", "X6_training_pairs", "R7_risk_coverage", "Q2_post_features", "Q10_tf_idf_grid", "R1_candidates", "V1_split_claims", "V2_normalize_claim", "V7_features", "V10_verdicts", "M7_paired_t", "M8_best_threshold", "M11_rationale", "V11_verify_by_retrieval"])
def test_against_oracle(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(plans.SQL[name])
    cols = [c[0] for c in want.description]
    assert rows(names, [r.asDict() for r in got.collect()]) == rows(names, [dict(zip(cols, r)) for r in want.fetchall()])


def test_lnc_ltc_equals_the_general_scheme(spark):
    from quillstone.operators import lexical

    i, t = plans._body(spark, SF), plans._terms(spark, SF)
    a = {(r.qid, r.unit): r.score for r in lexical.cosine(i, t).collect()}
    b = {(r.qid, r.unit): r.score for r in lexical.smart(i, t, "lnc.ltc").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 2e-6 for k in a)


def test_words_and_sentences(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.tokens(F.lit("IL-6 rose 1.5 fold, 3d"))) == ["il", "6", "rose", "1.5", "fold", "3", "d"]
    assert one(T.sentences(F.lit('Effects in organisms. The end. He said "stop." Then left.'))) == ["Effects in organisms. The end.", 'He said "stop.', "Then left."]
    assert sorted(one(T.numbers(F.lit("1,000 0.50 1,7 abc123")))) == ["0.5", "1000", "17", "23"]
    assert [one(T.s_stem(F.lit(w))) for w in ("studies", "classes", "mice", "virus", "cells")] == ["study", "classe", "mice", "virus", "cell"]


def test_boolean_grammar():
    word = lambda *w: boolean.Group([boolean.Alternative([boolean.Word(x) for x in w])])
    assert boolean.parse("a ) b") == boolean.parse("a") == boolean.parse('a ""') == word("a")
    assert boolean.parse("()").alternatives[0].wanted == [boolean.Group()]
    assert boolean.parse("NOT x") == boolean.Group([boolean.Alternative([], [boolean.Word("x")])])
    assert boolean.parse("a b OR (c") == boolean.Group([word("a", "b").alternatives[0], boolean.Alternative([word("c")])])
    assert boolean.parse('a AND NOT "x y"').alternatives[0].unwanted == [boolean.Phrase("x y")]
    with pytest.raises(ValueError):
        boolean.parse("a NOT")


def test_porter_and_edit_distance(spark):
    from quillstone.functions import stems

    words = dict(caresses="caress", ponies="poni", cats="cat", feed="feed", agreed="agre", plastered="plaster", motoring="motor", sing="sing", conflated="conflat", hopping="hop", falling="fall", filing="file", happy="happi", enjoy="enjoy", relational="relat", digitizer="digit", operator="oper", hopefulness="hope", electrical="electr", adoption="adopt", probate="probat", rate="rate", controll="control", dying="die", dies="die", geology="geolog")
    assert {w: stems.porter(w) for w in words} == words
    assert [stems.osa(a, b, 3) for a, b in (("ca", "abc"), ("ab", "ba"), ("", "abc"), ("same", "same"), ("a", "bcdefg"))] == [3, 1, 3, 0, 4]
    rows = spark.createDataFrame([("ab", "ba"), (None, "x")], "a string, b string").select(stems.edit_distance(F.col("a"), F.col("b"), 2).alias("d")).collect()
    assert [r.d for r in rows] == [1, None]


def test_chunk_spans():
    from quillstone.operators.chunking import spans

    assert spans([100, 80], 120, 1) == [{"start": 0, "end": 2}]
    assert spans([100, 100, 100], 120, 1) == [{"start": 0, "end": 2}, {"start": 1, "end": 3}]
    assert spans([500, 10], 120, 1) == [{"start": 0, "end": 2}]


def test_index_and_json_round_trip(spark, tmp_path):
    from quillstone.sources import store

    index = plans._body(spark, SF)
    store.save_index(index, f"{tmp_path}/i")
    again = store.load_index(spark, f"{tmp_path}/i")
    assert sorted(again.dictionary.collect()) == sorted(index.dictionary.collect()) and again.postings.count() == index.postings.count()
    (tmp_path / "c.jsonl").write_text('{"id": 1, "evidence": {"7": [{"label": "SUPPORT", "sentences": [1, 2]}]}}\n\n{"id": 2, "evidence": {}}\n')
    claims = store.read_jsonl(spark, f"{tmp_path}/c.jsonl", "id long, evidence map<string, array<struct<label: string, sentences: array<int>>>>")
    assert sorted((r.id, len(r.evidence)) for r in claims.collect()) == [(1, 1), (2, 0)]
    store.write_json(claims, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t1\n1\tb\t0\n")
    assert [tuple(r) for r in store.read_qrels(spark, f"{tmp_path}/q.tsv").collect()] == [("1", "a", 1)]


def test_claims_of_an_answer(spark):
    from quillstone.functions import claims

    cases = {
        "It rises by two. [1] The sources do not mention it at all. [2, 3] Source 1 states that cells grow fast in mice [1].": [("It rises by two.", False, [1]), ("The sources do not mention it at all.", True, [2, 3]), ("Cells grow fast in mice.", False, [1])],
        "[1] Cells grow fast here. [2; 3] Mice are small animals.": [("Cells grow fast here.", False, [1]), ("Mice are small animals.", False, [2, 3])],
        "Yes. [4] Cells grow in mice today.": [("Cells grow in mice today.", False, [4])],
        "": [],
        None: [],
    }
    rows = spark.createDataFrame([(a,) for a in cases], "a string").select("a", claims.split_claims(F.col("a")).alias("c")).collect()
    assert {r.a: [(c.text, c.meta, c.cites) for c in r.c] for r in rows} == cases


def test_altered_claims(spark):
    from quillstone.functions import corruption as X

    cases = {
        "Drug A does not reduce pain": ("Drug A reduces pain", "Drug A does not increase pain", False),
        "Drug is useful": ("Drug is not useful", None, False),
        "Aspirin reduces pain in 1998 by 12.5 percent": ("Aspirin does not reduce pain in 1998 by 12.5 percent", "Aspirin increases pain in 1998 by 12.5 percent", True),
        "reduces pain": (None, "increases pain", False),
        "It cannot do this": ("It can do this", None, False),
        "Higher dose of 1 mg": (None, "Lower dose of 1 mg", True),
        "": (None, None, False),
        None: (None, None, False),
    }
    c = F.col("c")
    for r in spark.createDataFrame([(x,) for x in cases], "c string").select("c", X.negate(c).alias("n"), X.flip_direction(c).alias("f"), X.swap_number(c).alias("s")).collect():
        assert (r.n, r.f) == cases[r.c][:2] and (r.s is not None) == cases[r.c][2] and (r.s is None or r.s != r.c)
        assert r.s is None or "1998" not in r.c or "1998" in r.s
    assert all(r.t != r.w for r in spark.createDataFrame([("water",), ("aabb",)], "w string").select("w", X.typo(F.col("w")).alias("t")).collect())


def test_cluster_pruning_finds_nine_of_ten(spark):
    from quillstone.plans import audit

    assert audit.m13b(spark, "/root/testdata/sf0.01").first().recall >= 0.9


def test_filter_without_units(spark):
    with pytest.raises(ValueError):
        boolean.filtered(plans._bm(spark, SF), "nosuchword", plans._body(spark, SF), plans._title(spark, SF))


def test_statistics(spark):
    from quillstone.operators import experiments

    a, b = [1.0, 2.0, 3.0, 4.0, 6.0], [1.5, 1.0, 2.0, 3.5, 4.0]
    frame = lambda v: spark.createDataFrame(list(enumerate(v)), "qid int, value double")
    got = experiments.paired_t(frame(a), frame(b)).first()
    d = [x - y for x, y in zip(a, b)]
    t = statistics.mean(d) / (statistics.stdev(d) / math.sqrt(5))
    angle = math.atan(t / 2)  # with four degrees of freedom the tail has a closed form
    assert abs(got.t - t) < 1e-5 and abs(got.p - (1 - math.sin(angle) * (1 + math.cos(angle) ** 2 / 2))) < 1e-5
    assert experiments.paired_t(frame(a), frame(a)).first().p == 1.0


def test_merge_by_key(spark, tmp_path):
    from quillstone.sources import store

    path = str(tmp_path / "x")
    store.merge_json(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long"), path, "k")
    store.merge_json(spark.createDataFrame([("b", 3), ("c", 4)], "k string, v long"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.json(path).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    store.save_vectors(spark.createDataFrame([(1, [0.5, 1.0])], "id long, v array<double>"), path + "v")
    assert store.load_vectors(spark, path + "v").first().v == [0.5, 1.0]


def test_query_correction(spark):
    from quillstone.operators import spelling

    words = spark.createDataFrame([("protein", 9), ("proteins", 3), ("cancer", 5), ("canter", 2), ("fonetik", 4), ("activates", 7)], "word string, cf long")
    typos = spark.createDataFrame([("protien",), ("canver",), ("phonetic",), ("fonatig",), ("deactivates",)], "typo string")
    near = spelling.candidates(typos, words)
    got = {r.typo: (r.word, r.distance, r.stage) for r in spelling.best(near, "typo").collect()}
    # a swap is one edit; a tie goes to the frequent word; the first letter counts in sounds; two edits in seven letters need the sound; a prefix is no error
    assert got == {"protien": ("protein", 1, 0), "canver": ("cancer", 1, 0), "fonatig": ("fonetik", 2, 1)}
    context = spark.createDataFrame([(1, "cell"), (2, "horse")], "qid long, term string")
    postings = spark.createDataFrame([(7, "cell"), (7, "cancer"), (8, "horse"), (8, "canter")], "unit long, term string")
    asked = spark.createDataFrame([(1, "canver"), (2, "canver"), (3, "canver")], "qid long, typo string")
    fixes = spelling.best(spelling.in_context(asked.join(near, "typo"), context, postings), "qid", "typo")
    queries = spark.createDataFrame([(1, "Canver, of-the CANVER cell"), (2, "canver horse"), (3, "canver"), (4, None), (5, "")], "qid long, text string")
    texts = {r.qid: (r.text, r.fixed) for r in spelling.rewrite(queries, fixes).collect()}
    assert texts == {1: ("cancer, of-the CANVER cell", 1), 2: ("canter horse", 1), 3: ("cancer", 1), 4: (None, 0), 5: ("", 0)}
    assert spelling.unknown_words(queries, context.select("term")).where("qid = 1").count() == 1


def test_running_sums_over_ranges(spark):
    from quillstone.operators import evaluation

    # a third of all rows share one score; some have none
    data = [(i, 0 if i % 3 == 0 else None if i % 50 == 1 else (i * 37) % 101, i % 7) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, score int, v long").repartition(5)
    got = {r.id: r.upto_v for r in evaluation.running(df, ["score", "id"], ["v"], bins=8).collect()}
    want, total = {}, 0
    for i, _, v in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        total += v
        want[i] = total
    assert got == want
    assert evaluation.running(df.where("id < 0"), ["score", "id"], ["v"]).count() == 0
    scored = df.where("score is not null").select("id", "score", (F.col("v") > 3).cast("int").alias("y"))
    rows_ = sorted(scored.collect(), key=lambda r: (-r.score, r.id))
    curve = {r.id: (r.coverage, r.risk) for r in evaluation.risk_coverage(scored, "id").collect()}
    hits = 0
    for n, r in enumerate(rows_, 1):
        hits += r.y
        assert curve[r.id] == pytest.approx((n / len(rows_), 1 - hits / n), abs=2e-6)


def test_swapped_and_corrupted_claims(spark):
    from quillstone.functions import corruption as X
    from quillstone.operators import index, swaps

    docs = spark.createDataFrame([(1, "insulin lowers glucose in mice"), (2, "leptin lowers weight in mice"), (3, "mice eat"), (4, "")], "doc_id long, body string")
    claims = spark.createDataFrame([(1, "Insulin works; insulin!", "insulin lowers glucose in mice"), (2, "nothing known", "mice"), (3, None, None)], "qid long, claim string, evidence string")
    got = {r.qid: (r.word, r.entity) for r in swaps.entity_swap(claims, index.build(docs, "doc_id", "body")).collect()}
    # of the words as rare as insulin only leptin and weight are not in the evidence; "insulin" is the greater of the two spellings
    assert list(got) == [1] and got[1] in {("insulin", "Insulin works; leptin!"), ("insulin", "Insulin works; weight!")}
    rows_ = spark.createDataFrame([(1, "plain words", "other words"), (2, "plain words", None), (3, "it is so", None)], "qid long, claim string, entity string")
    out = {r.qid: r.x for r in rows_.select("qid", X.corrupt(F.col("claim"), F.col("entity"), F.col("qid")).alias("x")).collect()}
    assert tuple(out[1]) == ("other words", "entity", "UNSUPPORTED") and out[2] is None and tuple(out[3]) == ("it is not so", "negation", "CONTRADICTED")


def test_injected_detection(spark):
    from quillstone.operators import experiments

    found = spark.createDataFrame([("negation", "VERIFIED", 0.9), ("negation", "CONTRADICTED", 0.8), ("entity", None, None), ("entity", "UNSUPPORTED", 0.2)], "kind string, status string, cosine double")
    assert {tuple(r) for r in experiments.injected_detection(found, 0.5).collect()} == {("negation", 2, 1, 0), ("entity", 2, 2, 2)}


def test_claims_at_borders_of_other_letters(spark, tmp_path):
    texts = ["Doíbo dogaco.", "Do it", "Do", "do_it", "is1 so", "İs it\nso", "Ist es", "¿Do it?", "Why? ", "\tdo", "", None, "Wasñ x\ny?"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in plans.QUERIES["T15_is_claim"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == set(con.execute(plans.SQL["T15_is_claim"]).fetchall())


def test_bigram_overlaps_keep_pairs_below_the_bound_out_of_shuffles(spark):
    from quillstone.operators import grams

    words, asked = ["abcde", "abcd", "aaaa", "zzz", "abab", "bcdea"], ["abcd", "aaa", "q"]
    got = {(r.typo, r.word): (r.k, r.n, r.m) for r in grams.overlaps(spark.createDataFrame([(w,) for w in words], "word string"), asked, 0.35).collect()}
    sets = {w: grams._bigrams(w) for w in words + asked}
    pairs = {(t, w): (len(sets[t] & sets[w]), len(sets[w]), len(sets[t])) for t in asked for w in words}
    assert got == {p: v for p, v in pairs.items() if v[0] / (v[1] + v[2] - v[0]) >= 0.35}
    assert not grams.overlaps(spark.createDataFrame([("abc",)], "word string"), [], 0.35).collect()
    plan = plans.QUERIES["P5_candidates"](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Join" not in plan and plan.count("Exchange") == 1  # the count of words; before, pairs were shuffled


def test_best_units_in_one_pass(spark, tmp_path):
    """The pool from packed postings equals the one from full scores, ties and copies included; documents that share an id go by the whole index."""
    from quillstone.operators import fusion, lexical

    words = ["alpha", "beta", "gamma", "delta", "the", "3.5", "x1"]
    texts = [" ".join(words[(i * j) % 7] for j in range(i % 9)) + "\n" + " ".join(words[(i + j * j) % 7] for j in range(i % 13)) for i in range(300)] + ["a\nalpha beta"] * 250 + [None, "", "İ\nALPHAK beta"]
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma 3.5 gamma"), (3, "the"), (4, "unknown delta"), (5, "beta x1 alpha delta")], "item_id long, text string")
    for name, ids in (("one", list(range(len(texts)))), ("two", [i // 2 for i in range(len(texts))])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
        queries.write.parquet(f"{d}/benchmark.parquet")
        assert plans._unique(spark, d) == (name == "one")
        got, want = plans._pool(spark, d), fusion.pool(plans._bm(spark, d), plans._cos(spark, d), 200)
        assert rows(got.columns, [r.asDict() for r in got.collect()]) == rows(got.columns, [r.asDict() for r in want.collect()])
        best = plans._top(spark, d, 5)
        assert rows(best.columns, [r.asDict() for r in best.collect()]) == rows(best.columns, [r.asDict() for r in lexical.top(plans._bm(spark, d), 5).collect()])
        for zone, whole in (("body", plans._body(spark, d)), ("title", plans._title(spark, d))):
            part = plans._asked(spark, d, zone)
            terms = plans._terms(spark, d).select("term").distinct()
            for f in ("postings", "dictionary"):
                assert sorted(map(repr, getattr(part, f).join(terms, "term", "left_semi").select(*sorted(getattr(whole, f).columns)).collect())) == sorted(map(repr, getattr(whole, f).join(terms, "term", "left_semi").select(*sorted(getattr(whole, f).columns)).collect()))
            assert rows(["unit", "len", "lnc", "max_tf", "n_distinct"], [r.asDict() for r in part.units.collect()]) == rows(["unit", "len", "lnc", "max_tf", "n_distinct"], [r.asDict() for r in whole.units.collect()])


@pytest.mark.parametrize("name", ["R6_confidence", "Q4_router"])
def test_models_are_fitted_on_stored_features(spark, name):
    """Before, each pass of a fit scored every document again."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and plan.count("Relation") <= 12


def test_features_of_candidates_only(spark):
    """Phrases, windows, coverage and cosines of candidate pairs equal those of all pairs; other pairs are not made."""
    from quillstone.operators import lexical
    from quillstone.sources import corpus

    t, q = plans._terms(spark, SF), corpus.queries(spark, SF)
    pairs = audit.r1(spark, SF).select("qid", "unit").where("unit % 2 = 0")
    some = plans._asked(spark, SF, "body", pairs), plans._asked(spark, SF, "title", pairs)
    whole = plans._body(spark, SF), plans._title(spark, SF)
    for f in (lambda b, c, *w: lexical.min_cover(b, t, *w), lambda b, c, *w: lexical.phrase_pairs(b, q, *w), lambda b, c, *w: plans._coverage(b, c, t, *w), lambda b, c, *w: lexical.cosine(b, t, *w)):
        got, want = f(*some, pairs), f(*whole).join(pairs, ["qid", "unit"], "left_semi")
        assert rows(got.columns, [r.asDict() for r in got.collect()]) == rows(got.columns, [r.asDict() for r in want.collect()])


def test_reranker_is_fitted_on_stored_features(spark):
    plan = plans.QUERIES["R4_rerank"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and plan.count("Relation") == 1


def test_bm25_grid_without_the_whole_index(spark, tmp_path):
    """The grid from packed postings equals its SQL: ties, copies, zones without a hit, a judged passage of stop words; before, all words of all documents went to disk. Documents that share an id go by the whole index."""
    from quillstone.sources import store

    words = ["alpha", "beta", "gamma", "delta", "the", "3.5", "x1"]
    texts = [" ".join(words[(i * j) % 7] for j in range(i % 9)) + "\n" + " ".join(words[(i + j * j) % 7] for j in range(i % 13)) for i in range(120)]
    texts += ["a\nalpha beta gamma delta x1"] * 30 + ["alpha beta gamma delta x1 alpha\n", "of the\nbeta gamma 3.5", None, "", "gamma 3.5\nother words here"]
    queries = [(1, "alpha beta gamma delta x1"), (2, "gamma 3.5"), (3, "the"), (4, "unknown delta"), (5, "beta x1")]
    cases = {"one": (range(len(texts)), texts, queries), "two": ([i // 2 for i in range(len(texts))], texts, queries), "untitled": (range(40), ["\n" + x for x in texts[110:150]], queries), "unmatched": (range(2), ["of the", "other\nwords"], queries)}
    for name, (ids, some, asked) in cases.items():
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(list(zip(ids, some)), "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        got, want = plans.QUERIES["Q9_bm25_grid"](spark, d), con.execute(plans.SQL["Q9_bm25_grid"])
        cols = [c[0] for c in want.description]
        want = [dict(zip(cols, r)) for r in want.fetchall()]
        assert len(want) == (0 if name == "unmatched" else 96)
        assert rows(cols, [r.asDict() for r in got.collect()]) == rows(cols, want), name
        assert any(f"{d}/" in str(f) for key in store._STORED for f in key) == (name == "two")
