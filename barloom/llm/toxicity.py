"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, word pairs and pairs one word apart, each of value 1. Training goes
through a bounded sample of labelled rows one by one; every coordinate has its own rate, and L1 keeps most weights at exactly 0,
so the model is a short list, at most as long as the hash range, that every task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from barloom.llm.columns import fresh, whole

BITS = 20
EDGES = b".,;:!?\"'()[]{}<>*_#$%&|-"
PAIR, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Distinct hashed coordinates. A-Z count as a-z and punctuation around words is left out."""
    words = [w.strip(EDGES) for w in text.lower().split()]
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    turned = (h << np.uint64(21)) | (h >> np.uint64(43))
    every = np.concatenate([h, (h[:-1] * PAIR) ^ turned[1:], (h[:-2] * SKIP) ^ turned[2:]])
    every = (every ^ (every >> np.uint64(29))) * PAIR
    return np.unique((every >> np.uint64(64 - bits)).astype(np.int64))


@dataclass(frozen=True)
class Ftrl:
    """Settings of the fit. ``positive`` weighs rows of label 1; ``most_rows`` bounds the labelled sample, taken in the order of a
    digest of the key."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.5
    passes: int = 6
    positive: float = 6.0
    most_rows: int = 20_000
    seed: int = 0


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, settings: Ftrl, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) after ``passes`` orders of the rows. The bias has no penalty."""
    z, n = np.zeros(2**bits), np.zeros(2**bits)
    bias, bias_n = 0.0, 0.0
    rng = np.random.default_rng(settings.seed)
    for _ in range(settings.passes):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) > settings.l1, (np.sign(zi) * settings.l1 - zi) / ((settings.beta + np.sqrt(ni)) / settings.alpha + settings.l2), 0.0)
            g = (_sigmoid(bias + w.sum()) - labels[i]) * (settings.positive if labels[i] else 1.0)
            n[at] = ni + g * g
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / settings.alpha * w
            bias_n += g * g
            bias -= settings.alpha * g / (settings.beta + np.sqrt(bias_n))
    used = np.flatnonzero(np.abs(z) > settings.l1)
    zi, ni = z[used], n[used]
    return used, (np.sign(zi) * settings.l1 - zi) / ((settings.beta + np.sqrt(ni)) / settings.alpha + settings.l2), bias


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit(labelled: DataFrame, settings: Ftrl = Ftrl(), text: str = "text", label: str = "label", key: str = "doc_id", bits: int = BITS) -> pd.DataFrame:
    """Weights (coordinate, weight), the bias at -1, from rows with a 0/1 label. Null labels are left out, null texts are empty.

    At most ``settings.most_rows`` rows, those with the least digests of their keys, go to the one task that trains.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select(
        F.md5(F.concat_ws("|", F.lit(settings.seed), F.col(key).cast("string"))).alias("order"), whole(F.col(text)).cast("binary").alias("text"),
        F.col(label).cast("double").alias("label"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t.as_py(), bits).astype(np.int32) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), found], ["order", "label", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for batch in batches:
            xs += [x.values.to_numpy().astype(np.int64) for x in batch.column("x")]
            ys += batch.column("label").to_pylist()
        at, weights, bias = fit_rows(xs, np.array(ys), settings, bits)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([bias, *weights], pa.float64())], ["coordinate", "weight"])

    last = rows.select("order").orderBy("order").limit(settings.most_rows).agg(F.max("order")).first()[0]
    sample = rows.filter(F.col("order") <= F.lit(last)) if last is not None else rows.limit(0)
    sample = sample.mapInArrow(digest, "order string, label double, x array<int>").repartition(1).sortWithinPartitions("order", "label")
    return sample.mapInArrow(train, "coordinate long, weight double").toPandas()


def score(docs: DataFrame, model: pd.DataFrame, text: str = "text", into: str = "score", bits: int = BITS) -> DataFrame:
    """``docs`` with the probability of label 1 from each whole text; a null text scores as an empty one."""
    dense = np.zeros(2**bits)
    known = model["coordinate"].to_numpy() >= 0
    dense[model["coordinate"].to_numpy()[known]] = model["weight"].to_numpy()[known]
    at = np.flatnonzero(dense).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((at, dense[at], float(model["weight"].to_numpy()[~known].sum())))
    docs = docs.drop(into) if into != text else docs
    (raw,) = fresh(docs, ["_raw"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights, bias = shared.value
        dense = np.zeros(2**bits)
        dense[at] = weights
        for batch in batches:
            found = np.array([dense[features(t.as_py(), bits)].sum() for t in batch.column(raw)]) + bias
            keep = [i for i, name in enumerate(batch.schema.names) if name != raw]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(_sigmoid(found), pa.float64())],
                                             [*[batch.schema.names[i] for i in keep], into])

    rows = docs.withColumn(raw, whole(F.col(text)).cast("binary"))
    return rows.mapInArrow(apply, T.StructType([*docs.schema, T.StructField(into, T.DoubleType())]))
