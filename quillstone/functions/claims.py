"""Claims of an answer and their wording, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import sentences, tokens

# Wording of a sentence about the sources, and what it must be about.
META = (
    r"(?i)\b(?:do|does|did) not (?:directly |explicitly |specifically |clearly )?(?:support|address|mention|discuss|provide|contradict|report|state|describe|include|cover)\b"
    r"|\bcannot be (?:supported|confirmed|determined|verified|contradicted)\b|\bno (?:direct |specific |explicit )?(?:information|evidence|mention|data)\b"
    r"|\b(?:insufficient|not enough) (?:evidence|information)\b"
)
META_SUBJECT = r"(?i)\b(?:sources?|claim|provided|passages?|documents?|context|it|they|this)\b"
# Wording that attributes a claim to a source.
ATTRIBUTION = (
    r"(?i)^[^.;:]{0,90}?\b(?:states?|stated|shows?|showed|indicates?|indicated|suggests?|suggested|reports?|reported|finds?|found|demonstrates?|demonstrated|notes?|noted|mentions?|mentioned"
    r"|confirms?|confirmed|reveals?|revealed|concludes?|concluded|supports? the claim|support the claim|agrees?|observes?|observed) that\s+"
)
CITATION = r"\[([0-9]+(?:\s*[,;]\s*[0-9]+)*)\]"


def is_meta(text: Column) -> Column:
    return text.rlike(META) & text.rlike(META_SUBJECT)


def normalized(text: Column) -> Column:
    """Without an attribution at the front, if four tokens or more are left; sentences about the sources stay as they are."""
    rest = F.btrim(F.regexp_replace(text, ATTRIBUTION, ""))
    cut = ~is_meta(text) & text.rlike(ATTRIBUTION) & (F.size(tokens(rest)) >= 4)
    return F.when(cut, F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))).otherwise(text)


def _cited(text: Column) -> Column:
    groups = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*[,;]\s*"), lambda x: F.btrim(x).cast("int"))))


def split_claims(answer: Column) -> Column:
    """array<struct<text, raw, meta, cites>>: the sentences of an answer with the sources they cite.

    Citations after a sentence's end belong to it, unless the answer starts with one: then they stand before their sentence.  A
    fragment of less than three tokens gives its citations to the claim before it, or, without one, to the next.  Null: no claims."""
    flat = F.btrim(F.replace(F.coalesce(answer, F.lit("")), F.lit("\n"), F.lit(" ")))
    leading = flat.rlike(r"^\[[0-9]+")
    moved = F.regexp_replace(flat, r"([.!?])((?:\s*\[[0-9]+(?:\s*[,;]\s*[0-9]+)*\])+)", "$2$1")
    parts = sentences(F.when(leading, flat).otherwise(moved))

    def part(s: Column) -> Column:
        bare = F.btrim(F.regexp_replace(s, CITATION, ""))
        bare = F.regexp_replace(F.regexp_replace(bare, r"\s{2,}", " "), r"\s+([.,;:])", "$1")
        return F.struct(bare.alias("raw"), _cited(s).alias("cites"), (F.size(tokens(bare)) < 3).alias("short"))

    none = F.array().cast("array<struct<raw: string, cites: array<int>>>")
    sorted_ = lambda x: F.array_sort(F.array_distinct(x))

    def step(state: Column, x: Column) -> Column:
        out, pending = state["out"], state["pending"]
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["raw"].alias("raw"), sorted_(F.concat(last["cites"], x["cites"])).alias("cites"))))
        back = x["short"] & (F.size(out) > 0) & (F.size(x["cites"]) > 0) & ~state["leading"]
        grown = F.concat(out, F.array(F.struct(x["raw"].alias("raw"), sorted_(F.concat(x["cites"], pending)).alias("cites"))))
        kept = F.when(back, pending).when(x["short"], F.concat(pending, x["cites"])).otherwise(F.array().cast("array<int>"))
        return F.struct(F.when(back, joined).when(x["short"], out).otherwise(grown).alias("out"), kept.alias("pending"), state["leading"].alias("leading"))

    start = F.struct(none.alias("out"), F.array().cast("array<int>").alias("pending"), leading.alias("leading"))
    found = F.aggregate(F.transform(parts, part), start, step, lambda s: s["out"])
    return F.transform(found, lambda c: F.struct(normalized(c["raw"]).alias("text"), c["raw"].alias("raw"), is_meta(c["raw"]).alias("meta"), c["cites"].alias("cites")))


def escape(text: Column) -> Column:
    out = text
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def highlight(text: Column, sentence: Column, words: Column) -> Column:
    """HTML: the sentence marked, and words of the lower-case set `words` bold."""
    safe = escape(text)
    marked = F.when(F.length(sentence) > 0, F.replace(safe, escape(sentence), F.concat(F.lit("<mark>"), escape(sentence), F.lit("</mark>")))).otherwise(safe)
    pieces = F.regexp_extract_all(marked, F.lit(r"</?mark>|&[#a-z0-9]+;|[A-Za-z][A-Za-z0-9\-]*|[^A-Za-z<&]+|[<&]"), F.lit(0))
    bold = F.transform(pieces, lambda p: F.when(F.array_contains(words, F.lower(p)), F.concat(F.lit("<b>"), p, F.lit("</b>"))).otherwise(p))
    return F.array_join(bold, "")
