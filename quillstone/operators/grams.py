"""Words that share bigrams with the words of a batch: counts by matrix products, so that pairs below the bound are never rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words of a batch and of the table that meet at once: a product has at most so many cells on each side.
ASKED, TOLD = 2048, 2048


def _bigrams(word: str) -> set[str]:
    w = f"${word}$"
    return {w[i : i + 2] for i in range(len(w) - 1)}


def _matrix(words: list[str], places: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the known bigrams a word has, and how many of any kind."""
    sets = [_bigrams(w) for w in words]
    at = [(i, places[g]) for i, s in enumerate(sets) for g in s if g in places]
    out = np.zeros((len(words), len(places)), np.float32)
    if at:
        out[tuple(np.array(at).T)] = 1
    return out, np.array([len(s) for s in sets])


def overlaps(words: DataFrame, asked: list[str], least: float) -> DataFrame:
    """words (word, all different) against the words asked for -> typo, word, k, n, m: bigrams shared, of the word, of the typo; Jaccard `least` or more.

    Every word meets every one asked for; only the latter are held, by the driver and each task."""
    blocks = [asked[i : i + ASKED] for i in range(0, len(asked), ASKED)]

    def run(batches):
        places = [{g: i for i, g in enumerate(sorted(set().union(*map(_bigrams, b))))} for b in blocks]
        held = [(np.array(b, object), p, *_matrix(b, p)) for b, p in zip(blocks, places)]
        for batch in batches:
            for lo in range(0, batch.num_rows, TOLD):
                told = batch.column(0).slice(lo, TOLD).to_pylist()
                for typos, p, h, m in held:
                    g, n = _matrix(told, p)
                    k = g @ h.T
                    i, j = np.nonzero(k * (1 + least) >= least * (n[:, None] + m[None, :]).astype(np.float32) - 1e-3)
                    shared = k[i, j].astype(np.int64)
                    near = (shared > 0) & (shared / (n[i] + m[j] - shared) >= least)
                    i, j, shared = i[near], j[near], shared[near]
                    yield pa.RecordBatch.from_arrays([pa.array(typos[j], pa.string()), pa.array(np.array(told, object)[i], pa.string()), pa.array(shared), pa.array(n[i].astype(np.int64)), pa.array(m[j].astype(np.int64))], ["typo", "word", "k", "n", "m"])

    return words.select("word").mapInArrow(run, "typo string, word string, k long, n long, m long")
