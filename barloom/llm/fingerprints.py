"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of the hash range is kept.

A hash is kept or not whatever else a document holds, so the sketch of a union is the union of sketches, and the share of a small
document's sample found in a large one's estimates containment without bias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.cells import with_next
from barloom.llm.columns import let, shingles, whole, words

K = 5
SCALE = 16


def sketch(text: Column, k: int = K, scale: int = SCALE) -> Column:
    """Sorted distinct kept hashes; the least hash alone where none is kept; empty for a text without words."""
    floor = -(2**63) + 2**64 // scale

    def kept(hashes: Column) -> Column:
        low = F.filter(hashes, lambda x: x < F.lit(floor))
        least = F.array_compact(F.array(F.array_min(hashes)))
        return F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).otherwise(least)

    word_hashes = F.transform(words(F.lower(text)), lambda x: F.xxhash64(x))
    return let(let(word_hashes, lambda h: shingles(h, k)), kept)


def _sample(x: Column, scale: int) -> Column:
    return F.filter(x, lambda h: h < F.lit(-(2**63) + 2**64 // scale))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Share of the smaller sample that the other holds. Without samples on one side: 1 if the sketches are equal, else 0."""
    small = F.least(F.size(_sample(a, scale)), F.size(_sample(b, scale)))
    return (F.when(a == b, F.lit(1.0)).when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0)))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(1.0))


def as_text(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), " ")


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, scale: int = SCALE, into: str = "fingerprint") -> DataFrame:
    """``docs`` with the sketch of each whole text: sorted hashes of its lower-case ``k``-word shingles. A null text counts as
    empty and has an empty sketch; a column that is already called ``into`` is replaced."""
    return docs.withColumn(into, sketch(F.col(text), k, scale))


def merged(sketches: DataFrame, by: str, column: str = "fingerprint") -> DataFrame:
    """The sketch of all documents of a group together: the union of their hashes, gathered without any group's texts."""
    hashes = sketches.select(by, F.explode(column).alias("_hash")).distinct()
    return hashes.groupBy(by).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, scale: int = SCALE) -> DataFrame:
    """Every document beside its next one by ``key`` and beside an edited text: its last half replaced by the next one's start.

    Columns: key, text, sketch, next_sketch, edited, edited_sketch. Null texts are empty; repeated keys follow one another by text.
    """
    base = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text")).withColumn("sketch", sketch(F.col("text"), k, scale))
    half = F.floor(F.length("text") / 2).cast("int")
    pairs = with_next(base, "key", ["text", "sketch"], ties=["text"])
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    pairs = pairs.withColumn("edited", edited).drop("next_text")
    return pairs.withColumn("edited_sketch", sketch(F.col("edited"), k, scale)).withColumnRenamed("key", key)
