"""Token ids as length-delimited binary records, with a separate offset index.

A shard is a file of records in ascending document order. A record is: length of the payload (8 bytes, little-endian), masked
checksum of those 8 bytes (4), payload, masked checksum of the payload (4). The payload is the document's key (8 bytes) and its ids,
2 bytes each if the vocabulary allows, else 4. Checksums are CRC-32 as in zlib, rotated right by 15 bits plus 0xa282ead8, so that a
checksum of data that holds checksums stays meaningful. The index is a Parquet table with a row per record: shuffled reads seek by
it, and only the files it names count, so files that a lost or repeated task left behind are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.llm.cells import cell_of, cell_starts
from barloom.llm.columns import whole

MASK_ADD = 0xA282EAD8  # fixed value of the masking rule
NO_KEY = -(2**63)
HELD = 2**23
WORDS_KEPT = 1_000_000
_ENCODERS: dict[str, WordIds] = {}


class WordIds(dict):
    """Ids of words as bytes, filled in as words come. Its tokenizer drops white space and looks at nothing beyond a word, so a
    text's ids are those of its words. Emptied when it holds WORDS_KEPT words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 2**16 else np.dtype("<u4")

    def __missing__(self, word: bytes) -> bytes:
        stem = word[:-1]
        if word[-1:] in (b",", b".") and stem[-1:].isalnum():
            ids = self[stem] + self[word[-1:]]
        else:
            ids = np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind).tobytes()
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """The tokenizer lower-cases; only the strings of its special tokens are read before that, so a text that may have one is left as it is."""
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


def encoder(path: str) -> WordIds:
    """One per worker process, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return (((crc >> 15 | crc << 17) + MASK_ADD) & 0xFFFFFFFF).to_bytes(4, "little")


def framed(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked(length), payload, masked(payload)))


def unframed(record: bytes) -> bytes:
    """The payload of one record; an error if it or its length is damaged."""
    length, payload = record[:8], record[12:-4]
    if masked(length) != record[8:12] or int.from_bytes(length, "little") != len(payload) or masked(payload) != record[-4:]:
        raise ValueError("damaged record")
    return payload


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, docs_per_shard: int = 2048, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Encodes every whole text, writes the records below ``folder`` and returns the index, also stored there.

    The index has shard, file, place (record number in the shard), doc_id, offset, length, n_tokens. ``end_id`` is put behind each
    document. Null texts are empty; rows with a null key come first; rows with equal keys stand in the order of their texts. The
    folder must be one that all executors share (any URI that pyarrow opens). An empty table gives an empty index.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole(F.col(text)).cast("binary").alias("text"))
    starts, _ = cell_starts(slim.select("doc_id"), "doc_id", docs_per_shard)
    shard = cell_of(F.col("doc_id"), starts) if starts else F.lit(-1)
    rows = slim.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "doc_id", "text")
    schema = "shard int, file string, place long, doc_id long, offset long, length long, n_tokens long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], ids.kind).tobytes()
        files, base = FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        now, name, out, place, offset = None, "", None, 0, 0
        try:
            for batch in batches:
                index: list[tuple] = []
                for at, doc, raw in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    if out is None or at != now:
                        if out is not None:
                            out.close()
                        now, name, place, offset = at, f"shard-{at + 1:08d}-{uuid4().hex}.rec", 0, 0
                        out = files.open_output_stream(f"{base}/{name}")
                    tokens = ids.encode(raw.as_py()) + end
                    record = framed((NO_KEY if doc is None else doc).to_bytes(8, "little", signed=True) + tokens)
                    out.write(record)
                    index.append((at, name, place, doc, offset, len(record), len(tokens) // ids.kind.itemsize))
                    place, offset = place + 1, offset + len(record)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True) if index else [[]] * 7,
                                                  (pa.int32(), pa.string(), *[pa.int64()] * 5), strict=True)], [x.split()[0] for x in schema.split(", ")])
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(write, schema).write.parquet(f"{folder}/index")
    return spark.read.schema(schema).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """(shard, place, doc_id, n_tokens, ids) of the records that ``index`` names, from the files; ``ids`` are little-endian 32-bit
    integers. Pass any part of an index, in any order."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(tokenizer).kind
        files, base = FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            rows, held = ([], [], [], [], []), 0
            where = zip(*[batch.column(c).to_pylist() for c in ("shard", "file", "place", "offset", "length")], strict=True)
            for shard, file, place, offset, length in where:
                if file != name:
                    name, source = file, files.open_input_file(f"{base}/{file}")
                payload = unframed(source.read_at(length, offset))
                key = int.from_bytes(payload[:8], "little", signed=True)
                ids = np.frombuffer(payload, kind, offset=8).astype("<u4")
                for column, value in zip(rows, (shard, place, None if key == NO_KEY else key, len(ids), ids.tobytes()), strict=True):
                    column.append(value)
                held += ids.nbytes
                if held > HELD:
                    yield _batch(rows)
                    rows, held = ([], [], [], [], []), 0
            yield _batch(rows)

    by_file = index.select("shard", "file", "place", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return by_file.mapInArrow(read, "shard int, place long, doc_id long, n_tokens long, ids binary")


def _batch(rows: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["shard", "place", "doc_id", "n_tokens", "ids"])


def with_start(records: DataFrame) -> DataFrame:
    """``records`` with ``start``: the ids of all records before. Sums within shards, and one row per shard for the rest."""
    totals = records.groupBy("shard").agg(F.sum("n_tokens").alias("_in_shard"))
    before = totals.select("shard", (F.sum("_in_shard").over(W.orderBy("shard")) - F.col("_in_shard")).alias("_before"))
    inside = F.sum("n_tokens").over(W.partitionBy("shard").orderBy("place")) - F.col("n_tokens")
    return records.withColumn("_inside", inside).join(before, "shard").withColumn("start", F.col("_before") + F.col("_inside")).drop("_before", "_inside")
