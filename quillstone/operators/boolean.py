"""Boolean queries: parsed on the driver by a stack of open groups, evaluated as one grouped count per group.

A group holds alternatives (parted by OR); an alternative holds wanted and unwanted operands (AND may be left out, NOT marks the next operand as
unwanted).  Operators are in capitals; `"..."` is a phrase of at least one character; other quotation marks are skipped; an unmatched `)` ends the
query; what is still open at the end is closed; a NOT without operand is an error.  An alternative without wanted operands stands for all units.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import STOP_WORDS
from quillstone.operators.index import Index


@dataclass(frozen=True)
class Word:
    text: str


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass
class Alternative:
    wanted: list = field(default_factory=list)
    unwanted: list = field(default_factory=list)


@dataclass
class Group:
    alternatives: list[Alternative] = field(default_factory=lambda: [Alternative()])


def parse(query: str) -> Group:
    open_groups, negated = [Group()], [False]

    def add(operand) -> None:
        last = open_groups[-1].alternatives[-1]
        (last.unwanted if negated[-1] else last.wanted).append(operand)
        negated[-1] = False

    def close() -> None:
        done = open_groups.pop()
        negated.pop()
        add(done)

    for m in re.finditer(r'"(?P<phrase>[^"]+)"|(?P<mark>[()])|(?P<word>[^\s()"]+)', query):
        mark, word = m["mark"], m["word"]
        if mark == "(":
            open_groups.append(Group())
            negated.append(False)
        elif m["phrase"]:
            add(Phrase(m["phrase"]))
        elif negated[-1]:  # whatever follows NOT is its operand
            add(Word(mark or word))
        elif mark == ")":
            if len(open_groups) == 1:
                break
            close()
        elif word == "OR":
            open_groups[-1].alternatives.append(Alternative())
        elif word == "NOT":
            negated[-1] = True
        elif word != "AND":
            add(Word(word))
    if any(negated):
        raise ValueError("NOT without an operand")
    while len(open_groups) > 1:
        close()
    return open_groups[0]


def term_units(word: str, body: Index, title: Index) -> DataFrame:
    """Units that hold the word as it stands, in either zone."""
    hit = F.col("term") == word.lower()
    return body.postings.where(hit).select("unit").union(title.postings.where(hit).select("unit")).distinct()


def _back(i: int):
    return lambda x: x - i


def phrase_units(text: str, body: Index) -> DataFrame:
    """Units whose body has the phrase's words at the same distances; stop words only keep gaps."""
    kept = [(i, w) for i, w in enumerate(re.findall(r"[0-9]+(?:\.[0-9]+)?|[a-z0-9]+", text.lower())) if w not in STOP_WORDS]
    if not kept:
        return body.units.select("unit").limit(0)
    places = None
    for i, w in kept:
        p = body.postings.where(F.col("term") == w).select("unit", F.transform("positions", _back(i)).alias("p"))
        places = p if places is None else places.join(p.withColumnRenamed("p", "p2"), "unit").select("unit", F.array_intersect("p", "p2").alias("p")).where(F.size("p") > 0)
    return places.select("unit").distinct()


def units_of(node, body: Index, title: Index) -> DataFrame:
    """The units of a parsed query: one aggregation for each alternative that combines operands."""
    if isinstance(node, Word):
        return term_units(node.text, body, title)
    if isinstance(node, Phrase):
        return phrase_units(node.text, body)
    found = [_alternative(x, body, title) for x in node.alternatives]
    return found[0] if len(found) == 1 else reduce(DataFrame.union, found).distinct()


def _alternative(a: Alternative, body: Index, title: Index) -> DataFrame:
    wanted, unwanted = ([units_of(x, body, title) for x in side] for side in (a.wanted, a.unwanted))
    if not wanted:
        wanted = [body.units.select("unit")]
    if len(wanted) == 1 and not unwanted:
        return wanted[0]
    marked = [x.select("unit", F.lit(1).alias("yes")) for x in wanted] + [x.select("unit", F.lit(-len(wanted)).alias("yes")) for x in unwanted]
    return reduce(DataFrame.union, marked).groupBy("unit").agg(F.sum("yes").alias("yes")).where(F.col("yes") == len(wanted)).select("unit")


def search(query: str, body: Index, title: Index) -> DataFrame:
    return units_of(parse(query), body, title)


def filtered(scores: DataFrame, query: str, body: Index, title: Index) -> DataFrame:
    """Scores of the units that a Boolean query allows; an error if it allows none."""
    allowed = search(query, body, title)
    if allowed.isEmpty():
        raise ValueError(f"no unit fits the filter {query!r}")
    return scores.join(allowed, "unit", "left_semi").select(*scores.columns)
