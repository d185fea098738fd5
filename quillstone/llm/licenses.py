"""License scans with a positional token index (operator 5).

The licence words' document frequencies over the whole corpus give their IDF.  Each template whose mandatory key phrase stands in the file is
looked up by all its words that the file holds; their postings give relative positions (place in the file minus place in the template), and
a template is aligned where several of them agree.  The share of the template's IDF found there is its score, and it counts only
if its mandatory key phrase stands in the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.bytescan import LOWER_ALNUM, Words, scan

#: Phrases that count at every place where their words stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Template label -> (a stretch of the licence's text, mandatory key phrase).
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    "apache": ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "cc-by": ("this work is licensed under a creative commons attribution international license", "creative commons attribution"),
    "reserved": ("copyright all rights reserved no part of this publication may be reproduced without permission", "all rights reserved"),
}
#: Share of a template's IDF that makes a label, widest shift between agreeing postings.
LEAST_SHARE, SHIFT = 0.6, 2


def _hash(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), LOWER_ALNUM, True).hashes()


class Index:
    """Phrases and templates as word hashes; a vocabulary of fixed size."""

    def __init__(self, phrases: dict, templates: dict):
        self.phrases = [(_hash(p), label) for p, label in phrases.items()]
        self.templates = [(label, _hash(t), _hash(k)) for label, (t, k) in templates.items()]
        self.vocab = np.unique(np.concatenate([p for p, _ in self.phrases] + [x for _, t, k in self.templates for x in (t, k)]))
        self.numbers = [np.searchsorted(self.vocab, words) for _, words, _ in self.templates]


def _known(index: Index, h: np.ndarray) -> np.ndarray:
    """Each word's number in the vocabulary, or -1."""
    at = np.minimum(np.searchsorted(index.vocab, h), len(index.vocab) - 1)
    return np.where(index.vocab[at] == h, at, -1)


def _stands(h: np.ndarray, at: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """The places where the phrase stands consecutively, out of those of its first word."""
    at = at[at + len(phrase) <= len(h)]
    for k in range(1, len(phrase)):
        at = at[h[at + k] == phrase[k]]
    return at


def _frequencies(index: Index):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(index.vocab), np.int64), 0
        for batch in it:
            for a, b, words in scan(batch.column(0), LOWER_ALNUM, True):
                n += b - a
                known = _known(index, words.hashes())
                at = np.flatnonzero(known >= 0)
                df += np.bincount(np.unique(words.doc[at] * len(df) + known[at]) % len(df), minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(len(df)), -1]), pa.array(np.r_[df, n])], ["word", "df"])

    return run


def _starts(numbers: np.ndarray, held: np.ndarray, at: np.ndarray, vocab: int) -> np.ndarray:
    """Where a template may begin in a file: two different words of it, at least, agree up to SHIFT."""
    found = [(at[held == w] - q, w) for q, w in enumerate(numbers)]
    start = np.concatenate([np.add.outer(x, np.arange(-SHIFT, SHIFT + 1)).ravel() for x, _ in found])
    word = np.repeat([w for _, w in found], [len(x) * (2 * SHIFT + 1) for x, _ in found])
    pairs = np.unique(start * vocab + word)
    start, hits = np.unique(pairs // vocab, return_counts=True)
    return start[hits > 1]


def _match(index: Index, idf: np.ndarray, h: np.ndarray, known: np.ndarray, at: np.ndarray) -> tuple[dict[str, float], int, int, int, set]:
    """Of one file, whose vocabulary words stand at `at`: template scores, base places, first and last place, base labels."""
    places, first, last, base = 0, None, None, set()
    for phrase, label in index.phrases:
        found = _stands(h, at[h[at] == phrase[0]], phrase)
        if len(found):
            places += len(found)
            base.add(label)
            first, last = min(found[0], first if first is not None else found[0]), max(found[-1], last or 0)
    scores: dict[str, float] = {}
    for (label, words, key), numbers in zip(index.templates, index.numbers):
        if not len(_stands(h, at[h[at] == key[0]], key)):
            continue
        weight = idf[numbers]
        for start in _starts(numbers, known[at], at, len(index.vocab)):
            if scores.get(label) == 1:
                break
            near = h[max(0, start - SHIFT) : max(0, start + len(words) + SHIFT)]
            share = float(weight[np.isin(words, near)].sum() / weight.sum())
            if share >= LEAST_SHARE and share > scores.get(label, 0):
                scores[label] = min(1.0, share)
    return scores, places, first, last, base


def scan_licenses(df: DataFrame, text: str = "text", key: str = "doc_id", phrases: dict = PHRASES, templates: dict = TEMPLATES) -> DataFrame:
    """One row for each row of df: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label and score of each template found).

    Null and empty texts have no words, no labels and score 0; repeated rows are judged each by itself; a file's score is 1 with a base
    label, else its best template's."""
    index = Index(phrases, templates)
    col = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    counts = {r["word"]: r["df"] for r in df.select(col).mapInArrow(_frequencies(index), "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()}
    n = counts.get(-1, 0)
    idf = np.array([np.log((n + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in range(len(index.vocab))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, words in scan(batch.column(1), LOWER_ALNUM, True):
                h = words.hashes()
                known = _known(index, h)
                at = np.flatnonzero(known >= 0)
                edges = np.searchsorted(at, words.first)
                out = []
                for d in range(b - a):
                    lo, hi = words.first[d], words.first[d + 1]
                    if edges[d + 1] == edges[d]:
                        out.append((0, None, None, "", "", 0.0, []))
                        continue
                    scores, places, first, last, base = _match(index, idf, h[lo:hi], known[lo:hi], at[edges[d] : edges[d + 1]] - lo)
                    out.append((places, first, last, ",".join(sorted(base)), ",".join(sorted(base | set(scores))), 1.0 if base else max(scores.values(), default=0.0), [f"{k}:{v:.4f}" for k, v in sorted(scores.items())]))
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts.astype(np.int64)), *[pa.array([int(x) if k == pa.int64() and x is not None else x for x in c], k) for c, k in zip(cols, kinds)]], ["k", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(f"`{key}`").alias("k"), col.alias("t")).mapInArrow(run, f"k {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>")
    return out.withColumnRenamed("k", key)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
