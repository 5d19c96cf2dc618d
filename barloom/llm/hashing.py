"""Word and run hashes of whole texts inside tasks, and a bit table that thins a table before a join."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

MARKS = 2**24
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
HALF = np.uint64(32)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text; A-Z count as a-z. bytes.split() cuts at ASCII white space only."""
    words = text.lower().split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` neighbours; the whole sequence is one run if it is shorter; none if it is empty."""
    k = min(k, len(hashes))
    if not k:
        return hashes
    n = len(hashes) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ (out >> HALF)) * MULTIPLIER + hashes[i:i + n]
    out = (out ^ (out >> HALF)) * SPREAD
    return out ^ (out >> HALF)


def mark_of(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * MULTIPLIER) >> np.uint64(40)).astype(np.int64)


def marks(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size that holds every id, and by chance some others: what it lets through is joined exactly later."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MARKS, bool)
        for batch in batches:
            bits[mark_of(batch.column(0).to_numpy(zero_copy_only=False))] = True
        packed = np.packbits(bits).reshape(-1, 2**15)
        for i, row in enumerate(packed):
            if row.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "bits": [zlib.compress(row.tobytes(), 1)]})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits"), strict=True):
                more = np.frombuffer(zlib.decompress(bits.as_py()), np.uint8)
                found[part] = found[part] | more if part in found else more
        for part, bits in found.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": [zlib.compress(bits.tobytes(), 1)]})

    out = np.zeros(MARKS // 8, np.uint8).reshape(-1, 2**15)
    schema = "part int, bits binary"
    for row in ids.mapInArrow(mark, schema).repartition("part").mapInArrow(join, schema).collect():
        out[row.part] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return np.unpackbits(out.ravel()).astype(bool)


def marked(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key may be in ``ids`` (one column); an exact join comes later, over fewer rows."""
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(marks(ids)))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            batch = batch.filter(batch.column(key).is_valid())
            yield batch.filter(pa.array(bits[mark_of(batch.column(key).to_numpy(zero_copy_only=False))]))

    return df.mapInArrow(thin, df.schema)
