"""Set similarity join of documents on word n-grams: rare-first prefixes, length, positional and suffix filters, one check per pair.

Any order of n-grams gives right prefixes; this one is by a table of 2^20 hashed counts over all documents, then by hash, so that
what is common stands last. Documents with equal sets are one node. Inside a group of documents that share a prefix n-gram, each is
compared with the group's most central member first; only those that don't link to it are compared with the rest of the group.
Members that do link to it are connected already, so no link between components is lost and a large group of near copies takes work
in proportion to its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.llm.columns import fresh, stored, whole
from barloom.llm.components import components
from barloom.llm.hashing import marked, run_hashes, word_hashes

BUCKETS = 2**20
BLOCK = 2**12
CLASSES = 64


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(run_hashes(word_hashes(text), k))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), whole(F.col(text)).cast("binary").alias("text"))


def shingle_counts(texts: DataFrame, k: int) -> np.ndarray:
    """Occurrences of all shingles, added up by their low 20 bits: a table of fixed size, whatever the corpus."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held = np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for text in batch.column("text"):
                waiting.append((run_hashes(word_hashes(text.as_py()), k) & np.uint64(BUCKETS - 1)).astype(np.int32))
                held += len(waiting[-1])
                if held >= BUCKETS:
                    total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                    waiting, held = [], 0
        if held:
            total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
        for block, counts in enumerate(total.reshape(-1, BLOCK)):
            if counts.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": [zlib.compress(counts.tobytes(), 1)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                more = np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
                sums[block] = sums[block] + more if block in sums else more
        for block, counts in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": [counts.tobytes()]})

    schema = "block int, counts binary"
    table = np.zeros(BUCKETS, np.int64)
    for row in texts.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():
        table[row.block * BLOCK:(row.block + 1) * BLOCK] = np.frombuffer(row.counts, np.int64)
    return table


def prefixes(texts: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """(doc_id, n, fp, prefix, classes): the size and a digest of each set, its rarest n-grams as far as a link can need them, rarest
    first, and how many of its n-grams fall into each of 64 classes."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), k)
                n = len(found)
                cut = n - (percent * n + 99) // 100 + 1 if n else 0
                common = table[(found & np.uint64(BUCKETS - 1)).astype(np.int64)]
                if cut < n:
                    near = np.flatnonzero(common <= np.partition(common, cut)[cut])
                    first = near[np.lexsort((found[near], common[near]))][:cut]
                else:
                    first = np.lexsort((found, common))
                rows[0].append(n)
                rows[1].append(blake2b(found.tobytes(), digest_size=16).hexdigest())
                rows[2].append(found[first].view(np.int64))
                rows[3].append(np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=CLASSES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.list_(pa.int64())),
                 pa.array(rows[3], pa.list_(pa.int32()))], ["doc_id", "n", "fp", "prefix", "classes"])

    return texts.mapInArrow(build, "doc_id long, n long, fp string, prefix array<long>, classes array<int>")


def sets_of(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, grams) of at least the documents in ``ids``: whole sets, for the exact check."""
    texts = marked(texts, "doc_id", ids)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array([shingle_set(t.as_py(), k).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), grams], ["doc_id", "grams"])

    return texts.mapInArrow(build, "doc_id long, grams array<long>")


def _linked(both: Column, na: Column, nb: Column, percent: int) -> Column:
    """100 both >= percent (na + nb - both)."""
    return (100 + percent) * both >= percent * (na + nb)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional filters of two rows of one n-gram: at most this n-gram, the shared ones before it and all after it can be
    in both sets."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    before = F.least(F.col(f"{a}.before"), F.col(f"{b}.before"))
    after = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")) - 1
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & _linked(1 + before + after, na, nb, percent)


def _verified(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Class counts bound the overlap first; then whole sets are compared, once per pair."""
    def side(table: DataFrame, end: str) -> DataFrame:
        return table.select(*[F.col(c).alias(end if c == "doc_id" else f"{c}_{end}") for c in table.columns])

    pairs = pairs.join(side(sizes, "a"), "a").join(side(sizes, "b"), "b")
    most = F.aggregate(F.zip_with("classes_a", "classes_b", lambda x, y: F.least(x, y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    pairs = stored(pairs.filter(_linked(most, F.col("n_a"), F.col("n_b"), percent)).select("a", "b").distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    grams = sets_of(texts, ends, k).join(ends, "doc_id", "left_semi")
    full = pairs.join(side(grams, "a"), "a").join(side(grams, "b"), "b")
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    return full.filter(_linked(both, F.size("grams_a"), F.size("grams_b"), percent)).select("a", "b")


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) per row of ``docs``.

    Documents link when the Jaccard similarity of their sets of distinct ``k``-word shingles (A-Z as a-z) is ``percent`` / 100 or
    more; component_id is the smallest key reachable by links, the own one included. A null or wordless text has an empty set and
    links with nothing; a row with a null key takes the component of an equal set and otherwise has none (null). Rows that repeat a
    key are documents of their own that name their component alike. Sets are compared by 64-bit n-gram hashes.
    """
    texts = _texts(docs, key, text)
    sets = stored(prefixes(texts, shingle_counts(texts, k), k, percent))
    reps = sets.filter(F.col("n") > 0).groupBy("fp").agg(F.min("doc_id").alias("rep"))
    first = reps.filter(F.col("rep").isNotNull()).withColumnRenamed("rep", "doc_id")
    nodes = sets.join(first, ["fp", "doc_id"], "left_semi").select("doc_id", "n", "prefix", "classes")
    sizes = nodes.select("doc_id", "n", "classes")
    grams = nodes.select(F.col("doc_id").alias("rep"), "n", F.posexplode("prefix").alias("pos", "gram"))
    known = grams.groupBy("gram").agg(F.count("*").alias("df")).filter(F.col("df") > 1).select("gram")
    held = grams.join(known, "gram").withColumn("before", (F.row_number().over(W.partitionBy("rep").orderBy("pos")) - 1).cast("bigint"))
    # The most central member has the fewest n-grams of its own in front of this one.
    held = stored(held.withColumn("own", F.col("pos") - F.col("before")))
    middle = held.groupBy("gram").agg(F.min(F.struct("own", F.col("rep").alias("middle"))).alias("m")).select("gram", "m.middle")
    members = stored(held.join(middle, "gram"))
    heads, spokes = members.filter("rep = middle"), members.filter("rep <> middle")

    near = heads.alias("x").join(spokes.alias("y"), F.col("x.gram") == F.col("y.gram")).filter(_may_link("x", "y", percent))
    pairs = near.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    links = stored(_verified(pairs, sizes, texts, k, percent))
    joined = components(links)

    label = joined.select(F.col("node").alias("rep"), F.col("component"))
    spokes = spokes.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    centre = label.select(F.col("rep").alias("middle"), F.col("component").alias("centre"))
    spokes = stored(spokes.join(centre, "middle", "left").withColumn("apart", F.col("component") != F.coalesce("centre", "middle")))
    once = (F.col("x.component") != F.col("y.component")) & (~F.col("y.apart") | (F.col("x.rep") < F.col("y.rep")))
    rest = spokes.filter("apart").alias("x").join(spokes.alias("y"), (F.col("x.gram") == F.col("y.gram")) & once)
    more = rest.filter(_may_link("x", "y", percent))
    more = more.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    links = links.unionByName(_verified(more, sizes, texts, k, percent))
    found = components(links).withColumnsRenamed({"node": "rep", "component": "_component"})
    named = sets.join(reps, "fp", "left").join(found, "rep", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("_component", "rep"))
    return named.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_per_group(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest key of their group, and all rows without words or without a group.

    Of rows that repeat a kept key with equal sets one stays, whichever comes first by text.
    """
    gone, again, rank = fresh(docs, ["_gone", "_again", "_rank"])
    groups = stored(jaccard_groups(docs, k, percent, key, text).filter("n_shingles > 0"))
    others = groups.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias(gone)).distinct()
    twice = groups.groupBy(key).count().filter("count > 1").select(F.col(key).alias(again))
    kept = docs.join(others, F.col(key).cast("bigint") == F.col(gone), "left_anti")
    same = F.col(key).cast("bigint") == F.col(again)
    repeated = kept.join(twice, same, "left_semi").withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(text)))
    return kept.join(twice, same, "left_anti").unionByName(repeated.filter(F.col(rank) == 1).drop(rank))
