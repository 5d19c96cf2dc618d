"""Periodic runs of words: stretches of at least three periods and 24 words that no neighbouring word extends.

Lags are diagonals of the table of all pairs of positions. For every word, in order, the nearest earlier occurrence of the words up
to it adds one to the match length of the diagonal it lies on; a diagonal that gets no such word ends, and is a run if it was long
enough. Single words occur too often for that, so a diagonal counts occurrences of grams: of 16 words for lags up to 16, of 32 for lags
up to 32, and so on. A run of smallest period q holds a gram of k >= q words q words back, and not nearer: two lags of which both fit
into a gram and its shift would make their greatest common divisor a period. So nearest occurrences lose no run, one lag a word and gram
length is active, and lags that are not smallest periods never are. Grams are equal when both halves are, so nothing rests on hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.columns import fresh, whole

LEAST_WORDS, LEAST_PERIODS, GRAM = 24, 3, 16


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number per word, equal for equal words."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def find_runs(numbers: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run, by start, then period."""
    found, size, grams = [], 1, numbers
    while len(grams) > size // 2:
        if size >= GRAM:
            found.append(_ended_diagonals(grams, size))
        if len(grams) <= size:
            break
        grams = _doubled(grams, size)
        if int(grams.max()) + 1 == len(grams):  # no gram occurs twice, so no longer one does
            break
        size *= 2
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _doubled(grams: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the grams of twice the size."""
    pairs = grams[:-size] * (int(grams.max()) + 1) + grams[size:]
    return np.unique(pairs, return_inverse=True)[1]


def _ended_diagonals(grams: np.ndarray, size: int) -> np.ndarray:
    """Runs whose period is at most ``size`` and, beyond the least size, more than half of it."""
    order = np.argsort(grams, kind="stable")
    again = grams[order[1:]] == grams[order[:-1]]
    at, lag = order[1:][again], (order[1:] - order[:-1])[again]
    near = (lag <= size) & (lag > (0 if size == GRAM else size // 2))
    at, lag = at[near], lag[near]
    by_place = np.argsort(at)
    at, lag = at[by_place], lag[by_place]
    starts = np.flatnonzero(np.diff(at, prepend=-2) * (np.diff(lag, prepend=0) == 0) != 1)
    counts = np.diff(starts, append=len(at))
    at, lag = at[starts], lag[starts]
    runs = np.stack([at - lag, lag + counts + size - 1, lag], axis=1)
    return runs[runs[:, 1] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * lag)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays: those in a run after its first period go."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps)[:-1] == 0


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
ARROW_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, text: str | Column = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period; by start, then period) and the ``collapsed`` text: the words that no
    run contains after its first period, joined by one space.

    Words are runs of characters other than ASCII white space, compared as they are. A null or wordless text has no runs and an empty
    collapsed text. Every row is judged by itself: repeated rows and keys, null keys and any other columns pass; columns named like the
    two new ones are replaced.
    """
    (raw,) = fresh(docs, ["_raw"])
    rows = docs.withColumn(raw, whole(F.col(text) if isinstance(text, str) else text).cast("binary"))
    others = [c for c in docs.columns if c.lower() not in (runs.lower(), collapsed.lower())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for body in batch.column(raw):
                words = body.as_py().split()
                here = find_runs(word_numbers(words)) if len(words) >= LEAST_WORDS else np.empty((0, 3), np.int64)
                if len(here):
                    stay = kept_words(len(words), here)
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in here.tolist()])
                texts.append(b" ".join(words))
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != raw]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, ARROW_RUNS), pa.array(texts, pa.binary()).cast(pa.string())],
                                             [*others, runs, collapsed])

    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType())])
    return rows.select(*others, raw).mapInArrow(work, schema)
