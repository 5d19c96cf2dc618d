"""Mergeable sketches of fixed size that tasks fill and one small shuffle joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2**16
EVERY = 2**64 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number's own bits."""
    h = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@dataclass
class Distinct:
    """The distinct values whose hashes are least: all of them up to ``capacity``, beyond it a uniform sample of the distinct values.

    Merging is union and cut, so any order of merges gives one result. A rank among u distinct values is off by u * sqrt(q (1 - q) /
    capacity) in standard deviation, at most 0.002 u at 65,536; up to the capacity it is exact.
    """

    capacity: int = CAPACITY
    limit: int = EVERY
    values: np.ndarray = field(default_factory=lambda: np.empty(0))

    def add(self, values: np.ndarray, limit: int = EVERY) -> None:
        new = np.unique(values[~np.isnan(values)] + 0.0)
        self.limit = min(self.limit, limit)
        every = np.unique(np.concatenate([self.values, new]))
        h = _mix(every)
        if len(every) > self.capacity:
            self.limit = min(self.limit, int(np.partition(h, self.capacity)[self.capacity]))
        self.values = every if self.limit == EVERY else every[h < np.uint64(self.limit)]

    @property
    def count(self) -> float:
        """Number of distinct values, estimated beyond the capacity."""
        return len(self.values) / (self.limit / 2**64) if self.limit != EVERY else len(self.values)

    def boundaries(self, num_bins: int) -> np.ndarray:
        """Midpoints of few distinct values, else values at equal steps through them; small steps above a single one."""
        x, u = self.values, len(self.values)
        steps = np.arange(1, num_bins)
        if u == 1:
            return x[0] + max(abs(x[0]) * 1e-5, 1e-7) * steps
        if u < num_bins:
            return (x[:-1] + x[1:]) / 2
        return x[np.unique(np.floor(steps / num_bins * (u - 1)).astype(np.int64))]


PARTS = "name string, cut decimal(20,0), body binary"


def distinct_sketches(df: DataFrame, columns: dict[str, Column], capacity: int = CAPACITY) -> DataFrame:
    """(name, bounded) sketches of the distinct values of each column: (name, cut, body). One pass; a task ships one sketch a column."""
    names = list(columns)
    rows = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Distinct(capacity) for _ in names]
        for batch in batches:
            for sketch, column in zip(held, batch.columns, strict=True):
                sketch.add(column.drop_null().to_numpy(zero_copy_only=False))
        yield packed(dict(zip(names, held, strict=True)))

    return merged(rows.mapInArrow(fill, PARTS), capacity)


def packed(held: dict[str, Distinct]) -> pa.RecordBatch:
    from decimal import Decimal

    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.string()), pa.array([Decimal(s.limit) for s in held.values()], pa.decimal128(20, 0)),
         pa.array([s.values.tobytes() for s in held.values()], pa.binary())], ["name", "cut", "body"])


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, int]]:
    for name, cut, body in zip(batch.column("name").to_pylist(), batch.column("cut").to_pylist(), batch.column("body"), strict=True):
        yield name, np.frombuffer(body.as_py(), np.float64), int(cut)


def merged(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One sketch per name."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Distinct] = {}
        for batch in batches:
            for name, values, limit in unpacked(batch):
                held.setdefault(name, Distinct(capacity)).add(values, limit)
        yield packed(held)

    return parts.repartition("name").mapInArrow(join, PARTS)


def boundaries(sketches: DataFrame, num_bins: int, capacity: int = CAPACITY) -> DataFrame:
    """(feature, bounds) of each sketch; a column without values has none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bounds = [], []
            for name, values, limit in unpacked(batch):
                if len(values):
                    names.append(name)
                    bounds.append(Distinct(capacity, limit, values).boundaries(num_bins).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bounds, pa.list_(pa.float64()))], ["feature", "bounds"])

    return sketches.mapInArrow(cut, "feature string, bounds array<double>")


def sketch_boundaries(df: DataFrame, features: Sequence[str], num_bins: int = 256, capacity: int = CAPACITY) -> DataFrame:
    """Bin boundaries per feature from one pass and sketches of fixed size; exact up to ``capacity`` distinct values of a feature."""
    return boundaries(distinct_sketches(df, {f: F.col(f) for f in features}, capacity), num_bins, capacity)
