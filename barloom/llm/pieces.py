"""SentencePiece vocabularies as a lattice of scored pieces: the best segmentation, found in parallel for giant documents.

A text is written with "\\u2581" for each space and one in front, and its segmentation is the one whose piece scores add up to most;
characters without a piece become byte pieces. No piece reaches over certain places (before a space, around a line feed), so text
between such places is solved once per distinct word.

A giant document is cut into chunks of equal length, wherever that falls. For each chunk a matrix holds the best score for every
pair of boundary states: how many characters a piece from the left reaches into the chunk, and how far its own last piece reaches
beyond it. Matrices multiply in the (max, +) sense, which is associative, so they are combined over a tree; going down the tree
fixes the states at all boundaries; then each chunk traces its own pieces back by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.columns import fresh, stored, whole

SPACE = "▁"
CHUNK = 65_536
FANIN = 64
WORDS_KEPT = 200_000
LONGEST_KEPT = 256
SOLVED_KEPT = 20_000
UNKNOWN_COST = 10.0
NEVER = -np.inf
_LATTICES: dict[str, Lattice] = {}


class Lattice:
    """The pieces of a model file, with caches of solved words."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        self.longest = max(map(len, self.pieces))
        self.starts: dict[str, tuple[int, float] | None] = dict.fromkeys(p[:n] for p in self.pieces for n in range(1, len(p)))
        self.starts |= self.pieces
        self.pairs = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_COST
        self.bytes_ = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.texts = [b""] * size
        for piece, (i, _) in self.pieces.items():
            self.texts[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.bytes_.items():
            self.texts[i] = bytes([value])
        space_ends = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        lines_alone = not any("\n" in p and len(p) > 1 for p in self.pieces)
        stop = f"{SPACE}\n" if lines_alone else SPACE
        self.words = re.compile(f"{SPACE}*[^{stop}]+|{SPACE}+" + "|\n" * lines_alone if space_ends else "(?s).+")
        self.solved: dict[str, tuple[float, np.ndarray]] = {}
        self.ids: dict[str, bytes] = _Ids(self)

    def forward(self, text: str, start: int, stop: int) -> tuple[list[float], list[tuple[int, tuple[int, ...]]]]:
        """Best scores at every place reached from ``start`` by pieces that begin before ``stop``, and how each place was reached.
        Of equally good ways the one with the longest last piece stays."""
        n, starts = len(text), self.starts
        best, back = [NEVER] * (n + 1), [(-1, ())] * (n + 1)
        best[start] = 0.0
        for at in range(start, stop):
            score = best[at]
            if score == NEVER:
                continue
            if not starts.get(text[at]) and score + self.unknown > best[at + 1]:
                raw = text[at].encode("utf-8", "surrogatepass")
                ids = tuple(self.bytes_.get(b, self.unknown_id) for b in raw) if self.bytes_ else (self.unknown_id,)
                best[at + 1], back[at + 1] = score + self.unknown, (at, ids)
            for end in range(at + 1, n + 1):
                found = starts.get(text[at:end], ())
                if found:
                    if score + found[1] > best[end]:
                        best[end], back[end] = score + found[1], (at, (found[0],))
                elif found is not None:
                    break
        return best, back

    def traced(self, back: list[tuple[int, tuple[int, ...]]], end: int, start: int) -> list[int]:
        parts = []
        while end > start:
            end, ids = back[end]
            parts.append(ids)
        return [i for ids in reversed(parts) for i in ids]

    def solve(self, word: str) -> tuple[float, list[int]]:
        if word not in self.solved:
            best, back = self.forward(word, 0, len(word))
            if len(self.solved) >= SOLVED_KEPT:
                self.solved.clear()
            self.solved[word] = best[-1], self.traced(back, len(word), 0)
        return self.solved[word]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join(map(self.ids.__getitem__, self.words.findall(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of pieces, without the space in front."""
        return b"".join(map(self.texts.__getitem__, ids.tolist()))[1:]

    def parts(self, text: str, size: int) -> tuple[int, int, list[str]]:
        """The first and last place within ``size`` characters of a chunk that no piece reaches over, and the words between; -1 if none."""
        places = [m.start() for m in self.words.finditer(text) if 0 < m.start() <= size]
        if size == len(text) and size not in places:
            places.append(size)
        if not places:
            return -1, -1, []
        return places[0], places[-1], self.words.findall(text[places[0]:places[-1]])

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Best score of the chunk ``text[:size]`` for each way in (row) and out (column); text beyond is what its last piece may reach."""
        n = self.longest
        out = np.full((n, n), NEVER)
        first, last, words = self.parts(text, size)
        whole_ = first < 0
        tail = None
        if not whole_:
            inner = sum(self.solve(w)[0] for w in words)
            ends = np.array(self.forward(text[last:], 0, size - last)[0] if last < size else [0.0])
            tail = inner + ends[size - last:size - last + n]
        for way in range(min(n, (size if whole_ else first) + 1)):
            if whole_:
                row = self.forward(text, way, size)[0][size:size + n]
            else:
                row = (self.forward(text[:first], way, first)[0][first] if way < first else 0.0) + tail
            out[way, :len(row)] = row
        for way in range(size + 1, n if whole_ else 0):  # a piece that spans the whole chunk
            out[way, way - size] = 0.0
        return out

    def trace(self, text: str, size: int, way: int, out: int) -> bytes:
        """Ids of the chunk's pieces between two boundary states."""
        first, last, words = self.parts(text, size)
        if first < 0:
            ids = self.traced(self.forward(text, way, size)[1], size + out, way)
        else:
            ids = self.traced(self.forward(text[:first], way, first)[1], first, way)
            ids += [i for w in words for i in self.solve(w)[1]]
            ids += self.traced(self.forward(text[last:], 0, size - last)[1], size - last + out, 0)
        return np.array(ids, "<i4").tobytes()


class _Ids(dict):
    def __init__(self, lattice: Lattice):
        self.lattice = lattice

    def __missing__(self, word: str) -> bytes:
        pairs = self.lattice.pairs
        cuts = [0, *[i for i in range(1, len(word)) if word[i - 1:i + 1] not in pairs], len(word)]  # no piece reaches over these places
        if len(cuts) > 2:
            ids = b"".join([self[word[lo:hi]] for lo, hi in pairwise(cuts)])
        else:
            ids = np.array(self.lattice.traced(self.lattice.forward(word, 0, len(word))[1], len(word), 0), "<i4").tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids


def lattice(path: str) -> Lattice:
    """One per worker process, kept between its tasks."""
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def written(text: bytes) -> str:
    """The text as pieces spell it; empty for an empty text."""
    return SPACE + text.decode("utf-8", "replace").replace(" ", SPACE) if text else ""


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def path_through(matrices: list[np.ndarray], way: int, out: int) -> list[int]:
    """States at all boundaries of the best path from ``way`` to ``out``, both included."""
    score, come = matrices[0][way], []
    for m in matrices[1:]:
        sums = score[:, None] + m
        come.append(sums.argmax(axis=0))
        score = sums.max(axis=0)
    states = [out]
    for c in reversed(come):
        states.append(int(c[states[-1]]))
    return [way, *reversed(states)]


def _pack(ids: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _encode_short(rows: DataFrame, model: str, raw: str, into: str) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model)
        for batch in batches:
            step = max(1, len(batch) * 2**22 // max(1, batch.nbytes))
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                ids = _pack([own.encode(written(t.as_py())) for t in part.column(raw)])
                keep = [i for i, name in enumerate(part.schema.names) if name != raw]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], ids], [*[part.schema.names[i] for i in keep], into])

    schema = T.StructType([*[f for f in rows.schema if f.name != raw], T.StructField(into, T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(encode, schema)


def _chunks(giants: DataFrame, model: str, row: str, raw: str, chunk: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = lattice(model).longest - 1
        for batch in batches:
            for key, data in zip(batch.column(row), batch.column(raw), strict=True):
                text = written(data.as_py())
                last = (len(text) - 1) // chunk
                for i in range(last + 1):
                    end = min((i + 1) * chunk, len(text))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()]), pa.array([i], pa.int64()), pa.array([last], pa.int64()), pa.array([end - i * chunk], pa.int32()),
                         pa.array([text[i * chunk:end + reach].encode("utf-8", "surrogatepass")])], ["row", "i", "last", "size", "text"])

    return giants.select(row, raw).mapInArrow(cut, "row string, i long, last long, size int, text binary")


def _matrices(chunks: DataFrame, model: str) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model)
        for batch in batches:
            made = [own.matrix(t.as_py().decode("utf-8", "surrogatepass"), n).tobytes()
                    for t, n in zip(batch.column("text"), batch.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "i", "last")], pa.array(made, pa.binary())], ["row", "i", "last", "m"])

    return chunks.select("row", "i", "last", "size", "text").mapInArrow(build, "row string, i long, last long, m binary")


def boundary_states(matrices: DataFrame, n: int, fanin: int = FANIN) -> DataFrame:
    """(row, i, way, out) of every chunk on the best path of its document, from (row, i, last, m).

    Up the tree: ``fanin`` neighbours are multiplied into one, until each document has one node. Down the tree: each node hands its
    two states to its children. A task holds ``fanin`` matrices of one document at a time.
    """
    def multiply(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        product = None
        for m in rows["m"]:
            m = np.frombuffer(m).reshape(n, n)
            product = m if product is None else times(product, m)
        return pd.DataFrame({"row": rows["row"].iloc[:1], "i": rows["i"].iloc[:1] // fanin, "last": rows["last"].iloc[:1] // fanin, "m": [product.tobytes()]})

    def hand_down(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        states = path_through([np.frombuffer(m).reshape(n, n) for m in rows["m"]], int(rows["way"].iloc[0]), int(rows["out"].iloc[0]))
        return pd.DataFrame({"row": rows["row"], "i": rows["i"], "way": states[:-1], "out": states[1:]})

    levels, last = [matrices], matrices.agg(F.max("last")).first()[0] or 0
    while last:
        levels.append(stored(levels[-1].groupBy("row", F.expr(f"i div {fanin}")).applyInPandas(multiply, "row string, i long, last long, m binary")))
        last //= fanin
    states = levels.pop().select("row", "i", F.lit(0).alias("way"), F.lit(0).alias("out"))
    while levels:
        parents = states.withColumnRenamed("i", "parent")
        children = levels.pop().withColumn("parent", F.expr(f"i div {fanin}")).join(parents, ["row", "parent"])
        states = children.groupBy("row", "parent").applyInPandas(hand_down, "row string, i long, way int, out int")
    return states


def _traced(chunks: DataFrame, states: DataFrame, model: str, into: str) -> DataFrame:
    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model)
        for batch in batches:
            found = [own.trace(t.as_py().decode("utf-8", "surrogatepass"), *w)
                     for t, *w in zip(batch.column("text"), *[batch.column(c).to_pylist() for c in ("size", "way", "out")], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("i"), _pack(found)], ["row", "i", "ids"])

    parts = chunks.join(states, ["row", "i"]).mapInArrow(trace, "row string, i long, ids array<int>")
    return parts.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias(into))


def encode_pieces(docs: DataFrame, model: str, text: str = "text", into: str = "ids", chunk: int = CHUNK, fanin: int = FANIN) -> DataFrame:
    """``docs`` with the piece ids of each whole text; a column already called ``into`` is replaced.

    Null and empty texts have no pieces. Repeated rows are encoded each. Where segmentations of a giant document score the same, the
    one returned may depend on ``chunk``; the score never does.
    """
    docs = docs.drop(into) if into != text else docs
    raw, row = fresh(docs, ["_raw", "_row"])
    rows = docs.withColumn(raw, whole(F.col(text)).cast("binary"))
    long_ = F.length(F.coalesce(F.col(text), F.lit(""))) >= chunk
    short = _encode_short(rows.filter(~long_), model, raw, into)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(row, pa.array([uuid4().hex for _ in range(len(batch))], pa.string()))

    giants = rows.filter(long_)
    giants = stored(giants.mapInArrow(named, T.StructType([*giants.schema, T.StructField(row, T.StringType())])))
    chunks = stored(_chunks(giants, model, row, raw, chunk).repartition("row", "i"))
    states = boundary_states(stored(_matrices(chunks, model)), lattice(model).longest, fanin)
    ids = _traced(chunks, states, model, into)
    return short.unionByName(giants.drop(raw).join(ids.withColumnRenamed("row", row), row).drop(row))


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give an empty text. Exact for texts that don't hold U+2581 themselves."""
    encoded = encoded.drop(into)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model)
        for batch in batches:
            column = batch.column(ids)
            texts = [own.decode(i.values.to_numpy()) if i.is_valid else b"" for i in column]
            yield batch.append_column(into, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()))

    return encoded.mapInArrow(decode, T.StructType([*encoded.schema, T.StructField(into, T.StringType())]))
