"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from quillstone.llm.bpe import op2_bpe_codec
from quillstone.llm.katz import op9_katz_score
from quillstone.llm.language import op3_language_id
from quillstone.llm.licenses import op5_license_scan
from quillstone.llm.mixing import op6_source_mix
from quillstone.llm.neardup import op7_minhash_neardup
from quillstone.llm.quality import op8_quality_rules
from quillstone.llm.substrings import op10_substring_dedup
from quillstone.llm.topk import op1_topk_search
from quillstone.llm.urls import op4_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_topk_search, op2_bpe_codec, op3_language_id, op4_url_filter, op5_license_scan, op6_source_mix, op7_minhash_neardup, op8_quality_rules, op9_katz_score, op10_substring_dedup)
}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+')"
_LOWER_WORDS = _WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

SQL = {
    "op1_topk_search": """
        WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_url_filter": r"""
        WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path FROM a),
        r(verdict, h, p) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('block','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
        m AS (SELECT b.page_id, host, path, h || p AS rule, verdict, row_number() OVER (PARTITION BY b.page_id ORDER BY length(h || p) DESC NULLS LAST) AS n
              FROM b LEFT JOIN r ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM m WHERE n = 1""",
    "op7_minhash_neardup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s FROM w),
        x AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op10_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
        h AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS run FROM p),
        c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY run) > 1 AS dup FROM h),
        x AS (SELECT doc_id, w[j] AS word, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
        k AS (SELECT x.doc_id, x.word, x.j, max(CASE WHEN c.dup THEN 1 ELSE 0 END) OVER (PARTITION BY x.doc_id ORDER BY x.j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
              FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.j),
        g AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (gone = 0) AS kept FROM k GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)""",
}
