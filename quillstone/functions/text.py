"""Text analysis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop list.
STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below
between both but by can could did do does doing down during each few for from further had has have
having he her here hers herself him himself his how i if in into is it its itself just me more most
my myself no nor not of off on once only or other our ours ourselves out over own same she should so
some such than that the their theirs them themselves then there these they this those through to too
under until up very was we were what when where which while who whom why will with would you your
yours yourself yourselves also may might must shall via et al within without upon among whether
""".split()
# Words that mark a negation.
NEGATIONS = """no not never none nor neither cannot without lack lacks lacking absence absent
fail fails failed unable doesn't don't didn't isn't aren't wasn't weren't won't wouldn't""".split()
# Abbreviations after which no sentence ends.
ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "vs.", "fig.", "figs.", "no.", "approx.", "ca.", "dr.", "mr.", "ms.", "inc.", "ltd.", "u.s.", "u.k.", "cf.", "resp.", "etc.")

# A text that starts with one of these is a question.
QUESTION_WORDS = "what why how when where which who whom whose is are does do can could should will would did was were".split()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; a decimal number is one token."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[0-9]+(?:\\.[0-9]+)?|[a-z0-9]+"), F.lit(0))


def is_stop(token: Column) -> Column:
    return token.isin(STOP_WORDS)


def s_stem(t: Column) -> Column:
    """Harman's plural stemmer: the first rule whose ending fits decides."""
    n = F.length(t)
    return (
        F.when((n > 3) & t.rlike("ies$") & ~t.rlike("[ea]ies$"), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & t.rlike("es$") & ~t.rlike("[aeo]es$"), F.substring(t, F.lit(1), n - 1))
        .when((n > 2) & t.rlike("s$") & ~t.rlike("[us]s$"), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def sentences(text: Column) -> Column:
    """White space collapsed, split after . ! ? before a capital, digit or opening mark; a listed abbreviation does not end one and comes out in lower case."""
    t = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    for i, a in enumerate(ABBREVIATIONS):
        t = F.regexp_replace(t, "(?i)" + a.replace(".", "\\."), chr(2) + chr(65 + i) + chr(3))
    parts = F.split(t, "(?<=[.!?])[\"')\\]]*\\s+(?=[A-Z0-9(\\[\"'])")

    def back(s: Column) -> Column:
        for i, a in enumerate(ABBREVIATIONS):
            s = F.replace(s, F.lit(chr(2) + chr(65 + i) + chr(3)), F.lit(a))
        return F.btrim(s)

    return F.filter(F.transform(parts, back), lambda s: s != "")


def numbers(text: Column) -> Column:
    """Distinct numerals: commas deleted, zeros after a decimal point dropped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?<![a-z])[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    plain = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.array_distinct(F.transform(plain, lambda x: F.when(x.contains("."), F.regexp_replace(x, "\\.?0+$", "")).otherwise(x)))


def has_negation(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z']+"), F.lit(0))
    return F.arrays_overlap(words, F.array(*map(F.lit, NEGATIONS))) | low.contains("n't")


def k_grams(word: Column, k: int = 2) -> Column:
    """The set of k-grams of a word between border marks."""
    w = F.concat(F.lit("$"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - k + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(k))))


def chain(stemmer: str = "s", stop_words: bool = False):
    """Analysis as a function of a column: stemmer s or none; stop words go unless kept. (The suffix stemmer runs on distinct words, see stems.)"""
    if stemmer not in ("s", "none"):
        raise ValueError(f"no column form of stemmer {stemmer!r}")

    def analyzed(text: Column) -> Column:
        out = tokens(text) if stop_words else F.filter(tokens(text), lambda t: ~is_stop(t))
        return F.transform(out, s_stem) if stemmer == "s" else out

    return analyzed


def is_claim(text: Column) -> Column:
    """Neither ends with a question mark nor starts like a question; null counts as empty.

    A question word ends before anything but an ASCII letter, digit or underscore, as in the SQL; Java's word border also counts other letters."""
    t = F.lower(F.translate(F.btrim(F.coalesce(text, F.lit(""))), "\u0130", "i"))  # Java lower-cases the dotted capital to two characters
    return ~t.endswith("?") & ~t.rlike("^(" + "|".join(QUESTION_WORDS) + ")(?![0-9a-z_])")


def source_entry(number: Column, title: Column, body: Column, most: int = 160) -> Column:
    """A numbered source: title, then the first words, with dots where words are left out."""
    words = F.split(F.btrim(F.regexp_replace(body, "\\s+", " ")), " ")
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), title, F.lit("\n"), F.array_join(F.slice(words, 1, most), " "), F.when(F.size(words) > most, " ...").otherwise(""))
