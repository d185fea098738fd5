"""Window chunks of sentences; row-local, no shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def spans(words: list[int], most: int, overlap: int) -> list[dict]:
    """Runs of sentences of about `most` words; a short text is one run, a short tail joins the run before it."""
    n, left, i, out = len(words), sum(words), 0, []
    if left <= 1.5 * most:
        return [{"start": 0, "end": n}]
    upto = [0]
    for w in words:
        upto.append(upto[-1] + w)
    while True:
        j = i + 1
        while j < n and upto[j] - upto[i] < most:
            j += 1
        j = n if left - upto[j] < 0.3 * most else j
        out.append({"start": i, "end": j})
        if j == n:
            return out
        i = max(j - overlap, i + 1)


def window_spans(words: Column, most: int = 120, overlap: int = 1) -> Column:
    """words: array of word counts -> array of (start, end)."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def of(w: pd.Series) -> pd.Series:
        return w.map(lambda x: spans([int(k) for k in x], most, overlap))

    return of(words)
