"""Document quality by attention over passages (multiple-instance learning).

A text is a bag of passages of ``passage_words`` words. A passage is encoded by the mean embedding of its words and word shapes and by
counts of its characters and repeats, through one hidden layer. Gated attention (a tanh layer times a sigmoid layer) weighs the passages
of a document, and the weighted passage is scored. Only documents have labels; the weights of passages are learned from those.

One task trains on a bounded sample of labelled rows, and the model has a fixed size, so every task can hold it.
"""

from __future__ import annotations

import pickle
import re
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

LETTERS = bytes(97 if 97 <= c < 123 or c >= 128 else 65 if 65 <= c < 91 else 57 if 48 <= c < 58 else c for c in range(256))
SAME = re.compile(rb"(.)\1+")
COUNTS = 6  # bytes, lower-case letters, capitals, digits, other characters, 1 a word
STATS = 11


@dataclass(frozen=True)
class Attention:
    """Settings of the fit. ``most_rows`` bounds the labelled sample, taken in the order of a digest of the key."""

    passage_words: int = 48
    bits: int = 15
    width: int = 16
    hidden: int = 24
    gates: int = 12
    most_rows: int = 6_000
    passes: int = 4
    batch: int = 32
    rate: float = 0.01
    seed: int = 0


class Words:
    """Numbers of words and a row of facts for each: two embedding places and the counts. Forgotten when it has grown too long."""

    def __init__(self, bits: int, most: int = 200_000) -> None:
        self.bits, self.most = bits, most
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.shapes: dict[bytes, tuple[int, ...]] = {}
        self.facts = np.empty((0, 2 + COUNTS), np.int32)

    def table(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of every word, facts by number)."""
        if len(self.numbers) > self.most:
            self.clear()
        new = sorted(set(words).difference(self.numbers))
        if new:
            size = len(self.numbers)
            self.numbers.update(zip(new, range(size, size + len(new)), strict=True))
            facts = np.empty((len(new), 2 + COUNTS), np.int32)
            facts[:, 0] = [xxh64_intdigest(w.lower()) >> (64 - self.bits) for w in new]
            facts[:, 1:] = [self.shapes.get(s) or self._shape(s) for s in [w.translate(LETTERS) for w in new]]
            self.facts = np.concatenate([self.facts, facts])
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)), self.facts

    def _shape(self, shape: bytes) -> tuple[int, ...]:
        lower, upper, digits = shape.count(b"a"), shape.count(b"A"), shape.count(b"9")
        place = xxh64_intdigest(SAME.sub(rb"\1", shape), 1) >> (64 - self.bits)
        self.shapes[shape] = place, len(shape), lower, upper, digits, len(shape) - lower - upper - digits, 1
        return self.shapes[shape]


@dataclass
class Bags:
    """Passages of several documents: embedding places and their passage starts, counts, and the first passage of each document.
    Passages of a document follow one another."""

    places: np.ndarray
    starts: np.ndarray
    stats: np.ndarray
    docs: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts, append=len(self.places))

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs)), np.diff(self.docs, append=len(self.starts)))


def bags(texts: list[bytes], known: Words, passage_words: int) -> Bags:
    """Passages of the texts; a text without words is one passage with a single empty word."""
    split = [t.split() or [b""] for t in texts]
    lengths = np.array([len(w) for w in split])
    numbers, facts = known.table([w for words in split for w in words])
    doc = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first = place % passage_words == 0
    starts = np.flatnonzero(first)
    passage = np.cumsum(first) - 1
    rows = facts[numbers]
    sums = np.add.reduceat(rows[:, 2:].astype(np.float64), starts)
    follows = np.append(False, (numbers[1:] == numbers[:-1]) & (doc[1:] == doc[:-1]))
    distinct = np.bincount(np.unique(passage * (len(known.numbers) + 1) + numbers) // (len(known.numbers) + 1), minlength=len(starts))
    size, chars = sums[:, 5], np.maximum(sums[:, 0], 1)
    stats = np.stack([
        sums[:, 0] / size / 10, sums[:, 1] / chars, sums[:, 2] / chars, sums[:, 3] / chars, sums[:, 4] / chars, 1 - distinct / size,
        np.add.reduceat(follows.astype(np.float64), starts) / size, np.add.reduceat(_seen_runs(numbers, doc), starts) / size,
        size / passage_words, np.log1p(lengths)[doc[starts]] / 10, place[starts] == 0], axis=1).astype(np.float32)
    return Bags(rows[:, :2].ravel(), starts * 2, stats, np.searchsorted(doc[starts], np.arange(len(texts))))


def together(each: list[Bags]) -> Bags:
    """The documents of several bags as one."""
    shift = lambda sizes: np.cumsum([0, *sizes[:-1]])
    words, passages = shift([len(x.places) for x in each]), shift([len(x.starts) for x in each])
    return Bags(np.concatenate([x.places for x in each]), np.concatenate([x.starts + w for x, w in zip(each, words, strict=True)]),
                np.concatenate([x.stats for x in each]), np.concatenate([x.docs + p for x, p in zip(each, passages, strict=True)]))


def _seen_runs(numbers: np.ndarray, doc: np.ndarray, k: int = 4) -> np.ndarray:
    """1.0 where the k words from here on stood earlier in the document."""
    n = len(numbers) - k + 1
    out = np.zeros(len(numbers))
    if n > 0:
        run = doc[:n].astype(np.uint64)
        for i in range(k):
            run = (run ^ (run >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + numbers[i:i + n].astype(np.uint64)
        out[:n] = 1.0
        out[np.unique(run, return_index=True)[1]] = 0.0
        out[:n][doc[:n] != doc[k - 1:]] = 0.0
    return out


class Model:
    """Encoder, gated attention and score."""

    def __init__(self, settings: Attention) -> None:
        rng = np.random.default_rng(settings.seed)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        d, h, g = settings.width, settings.hidden, settings.gates
        self.settings = settings
        self.embed = (rng.standard_normal((2**settings.bits, d)) * 0.1).astype(np.float32)
        self.parts = {"W": normal(d + STATS, h), "b": np.zeros(h, np.float32), "V": normal(h, g), "U": normal(h, g), "w": normal(g),
                      "c": normal(h), "c0": np.zeros(1, np.float32)}

    def forward(self, x: Bags) -> dict[str, np.ndarray]:
        p = self.parts
        mean = np.add.reduceat(self.embed[x.places], x.starts) / x.sizes[:, None]
        at = np.concatenate([mean, x.stats], axis=1)
        h = np.tanh(at @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        doc = x.doc_of
        a = np.exp(e - np.maximum.reduceat(e, x.docs)[doc])
        a /= np.add.reduceat(a, x.docs)[doc]
        z = np.add.reduceat(a[:, None] * h, x.docs)
        return {"x": at, "h": h, "t": t, "s": s, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["c0"])}

    def gradients(self, x: Bags, f: dict[str, np.ndarray], labels: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Of the mean log loss: for the dense parts, and (places, rows) for the embedding."""
        p, h, t, s, a, doc = self.parts, f["h"], f["t"], f["s"], f["a"], x.doc_of
        dy = ((f["score"] - labels) / len(labels)).astype(np.float32)
        dz = (dy[:, None] * p["c"])[doc]
        da = (dz * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, x.docs)[doc])
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        dense = {"W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ dy, "c0": dy.sum(keepdims=True)}
        mean = (dh @ p["W"].T)[:, :self.settings.width] / x.sizes[:, None]
        order = np.argsort(x.places, kind="stable")
        sorted_places = x.places[order]
        first = np.flatnonzero(np.diff(sorted_places, prepend=-1))
        return dense, sorted_places[first], np.add.reduceat(np.repeat(mean, x.sizes, axis=0)[order], first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def fit_rows(texts: list[bytes], labels: np.ndarray, settings: Attention = Attention()) -> Model:
    """Adam for the dense parts, per-coordinate rates for the embedding, over ``passes`` orders of the documents."""
    model, known = Model(settings), Words(settings.bits)
    each = [bags([t], known, settings.passage_words) for t in texts]
    rng = np.random.default_rng(settings.seed + 1)
    m, v = ({k: np.zeros_like(x) for k, x in model.parts.items()} for _ in range(2))
    seen = np.full(2**settings.bits, 1e-6, np.float32)
    step, steps = 0, settings.passes * -(-len(texts) // settings.batch)
    for _ in range(settings.passes):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), settings.batch):
            rows = order[i:i + settings.batch]
            x = together([each[r] for r in rows])
            dense, places, grads = model.gradients(x, model.forward(x), labels[rows])
            rate = settings.rate * (1 - step / steps)
            step += 1
            for name, g in dense.items():
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.01 * (g * g - v[name])
                model.parts[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)
            seen[places] += (grads * grads).mean(1)
            model.embed[places] -= rate * grads / np.sqrt(seen[places])[:, None]
    return model


def fit(labelled: DataFrame, docs: DataFrame, settings: Attention = Attention(), text: str = "text", label: str = "label", key: str = "doc_id") -> Model:
    """The model from 0/1 ``label`` rows by ``key`` and the texts of ``docs``. Null labels and keys without a document are left out.

    At most ``settings.most_rows`` labels, those with the least digests of their keys, are joined to their texts and go to the one task
    that trains. Without any label every score is what the untrained model says.
    """
    order = F.md5(F.concat_ws("|", F.lit(settings.seed), F.col(key).cast("string")))
    marks = labelled.filter(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("double").alias("y"), order.alias("o"))
    marks = marks.join(docs.select(F.col(key).alias("k")).distinct(), "k", "left_semi").orderBy("o", "y").limit(settings.most_rows)
    rows = docs.select(F.col(key).alias("k"), whole(F.col(text)).cast("binary").alias("t")).join(F.broadcast(marks), "k").select("o", "y", "t")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column("t").to_pylist()
            labels += batch.column("y").to_pylist()
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit_rows(texts, np.array(labels), settings))]})

    found: pd.DataFrame = rows.repartition(1).sortWithinPartitions("o", "y", "t").mapInArrow(train, "model binary").toPandas()
    return pickle.loads(found["model"].iloc[0]) if len(found) else Model(settings)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score", chunk_words: int = 100_000) -> DataFrame:
    """``docs`` with the probability of label 1 (``into``), ``n_passages``, and the first word and weight of the passage that has most
    attention (``top_word``, ``top_weight``); columns of these names are replaced. A null text counts as an empty one."""
    news = [into, "n_passages", "top_word", "top_weight"]
    others = [c for c in docs.columns if c.lower() not in {n.lower() for n in news}]
    (raw,) = fresh(docs, ["_raw"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Words(model.settings.bits)
        for batch in batches:
            texts = batch.column(raw).to_pylist()
            ends = np.cumsum([len(t) // 6 + 1 for t in texts]) // chunk_words
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
            found = [_judge(model, texts[a:b], known) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != raw]
            new = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 4
            types = [pa.float64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(new, types, strict=True)]], [*others, *news])

    kinds = [T.DoubleType(), T.LongType(), T.LongType(), T.DoubleType()]
    schema = T.StructType([*[docs.schema[c] for c in others], *[T.StructField(n, k) for n, k in zip(news, kinds, strict=True)]])
    return docs.withColumn(raw, whole(F.col(text)).cast("binary")).select(*others, raw).mapInArrow(apply, schema)


def _judge(model: Model, texts: list[bytes], known: Words) -> tuple[np.ndarray, ...]:
    x = bags(texts, known, model.settings.passage_words)
    f = model.forward(x)
    n = np.diff(x.docs, append=len(x.starts))
    top = np.maximum.reduceat(f["a"], x.docs)
    place = np.arange(len(x.starts)) - x.docs[x.doc_of]
    at = np.minimum.reduceat(np.where(f["a"] == top[x.doc_of], place, len(place)), x.docs)
    return f["score"], n, at * model.settings.passage_words, top
