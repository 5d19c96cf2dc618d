"""Mixing sources to target weights, by whole documents.

Sizes are words. Targets share all words by weight; no source is used more than ``most`` times over, and what a capped source
leaves goes to the others by weight. A source is used in whole passes, and of one more pass as many blocks as its target still
needs: the documents of a source lie in blocks by a hash of their key, so blocks are a random order of the source, and of the last
block as many documents as come nearest to the target. A tree then splits the block quotas of all sources over the output shards:
each node draws the left half's blocks from its own without replacement, so every shard gets a random, disjoint share of exact size.
Each shard shuffles its documents by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.llm.columns import fresh, stored, words

DOCS_PER_BLOCK = 256
MOST_BLOCKS = 4096


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source.cast("string")))


def unit(*parts: Column) -> Column:
    """A number in [0, 2^60) drawn from a digest of ``parts``: alike in every run and on every engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(sk, source_size, n_docs) with a weight: 1, 2, 3 and again, by code point of the source, null last. One row per source."""
    order = W.orderBy(F.col("sk").startswith("~"), F.col("sk"))
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.row_number().over(order) - 1) % len(cycle) + 1))


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """``sources`` (sk, source_size, weight) with their targets. Filled in the order in which sources reach their cap, the level is
    what is left over by the weight that is left; the first source that stays below its cap fixes it. Sources without words or
    weight get nothing."""
    live = (F.col("source_size") > 0) & (F.col("weight") > 0)
    cap = F.col("source_size") * most
    order = W.orderBy(F.when(live, cap / F.col("weight")), "sk")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    capped = F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = sources.withColumn("all", F.sum("source_size").over(W.partitionBy(F.lit(0)))).filter(live)
    level = level.select("sk", cap.alias("cap"), "weight", "all", capped.alias("capped"), F.sum("weight").over(after).alias("left"))
    fixed = (F.col("all") - F.col("capped")) * F.col("weight") <= F.col("cap") * F.col("left")
    first = F.min(F.when(fixed, F.struct("capped", "left"))).over(W.partitionBy(F.lit(0)))
    level = level.withColumn("first", first)
    share = (F.col("all") - F.col("first.capped")) * F.col("weight") / F.col("first.left")
    full = F.col("cap").cast("double")
    level = level.select("sk", F.when(F.col("first").isNull() | (F.col("capped") < F.col("first.capped")), full).otherwise(F.least(share, full)).alias("target"))
    return sources.join(level, "sk", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))


def block_of(u: Column, n_blocks: Column) -> Column:
    """The block, out of ``n_blocks``, in which a document with draw ``u`` lies."""
    return F.shiftright(F.shiftright(u, 20) * n_blocks, 40)


def cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with the part of the last pass that is taken: all blocks before ``cut``, and of block ``cut`` the documents of at
    least (hi_size, hi_u) or at most (lo_size, lo_u). First the largest that fit, then the smallest as far as they come nearest."""
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    sources = sources.withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    sources = sources.withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n_docs") / DOCS_PER_BLOCK))).cast("bigint"))
    placed = sized.join(sources.select("sk", "n_blocks", "rest"), "sk").withColumn("block", block_of(F.col("u"), F.col("n_blocks")))
    totals = placed.groupBy("sk", "block").agg(F.sum("size").alias("block_size"), F.max("rest").alias("rest"))
    upto = F.sum("block_size").over(W.partitionBy("sk").orderBy("block"))
    last = (totals.withColumn("upto", upto).filter(F.col("upto") > F.col("rest")).groupBy("sk")
            .agg(F.min(F.struct("block", (F.col("rest") - F.col("upto") + F.col("block_size")).alias("part"))).alias("c"))
            .select("sk", F.col("c.block").alias("cut"), F.col("c.part").alias("part")))
    inside = placed.join(last.withColumnRenamed("cut", "block"), ["sk", "block"]).select("sk", "size", "u", "part")
    own = W.partitionBy("sk")
    inside = inside.withColumn("large", F.sum("size").over(own.orderBy(F.desc("size"), F.desc("u"))) <= F.col("part"))
    filled = F.coalesce(F.sum(F.when(F.col("large"), F.col("size"))).over(own), F.lit(0))
    below = F.sum("size").over(own.orderBy("size", "u")) - F.col("size") / 2
    inside = inside.withColumn("small", ~F.col("large") & (below <= F.col("part") - filled))
    ends = inside.groupBy("sk").agg(F.min(F.when(F.col("large"), F.struct("size", "u"))).alias("hi"), F.max(F.when(F.col("small"), F.struct("size", "u"))).alias("lo"))
    return sources.join(last.select("sk", "cut"), "sk", "left").join(ends, "sk", "left")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(sk, shard, n): the quotas (sk, n) of all sources dealt to shards. Every node of a binary tree over the shards draws, from the
    blocks it holds, those of its left half without replacement (multivariate hypergeometric); the right half keeps the others."""
    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = map(int, key)
        rows = rows.sort_values("sk")
        held = rows["n"].to_numpy(np.int64)
        middle = (lo + hi) // 2
        total = int(held.sum())
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(held, total * (middle - lo) // (hi - lo), method="marginals")
        halves = [rows.assign(lo=lo, hi=middle, n=draw), rows.assign(lo=middle, hi=hi, n=held - draw)]
        return pd.concat(halves)[["sk", "n", "lo", "hi"]]

    nodes = quotas.select("sk", F.col("n").cast("bigint").alias("n"), F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    for _ in range(max(0, shards - 1).bit_length()):
        wide = nodes.filter("hi - lo > 1").groupBy("lo", "hi").applyInPandas(split, "sk string, n bigint, lo int, hi int")
        nodes = wide.unionByName(nodes.filter("hi - lo = 1"))
    return nodes.select("sk", F.col("lo").alias("shard"), "n")


def mix_plan(sized: DataFrame, weights: DataFrame | None = None, most: int = 3, shards: int | None = None, words_per_shard: int = 20_000_000,
             seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The decisions for ``sized`` (source, size, u): a table per source and one per block with the shard of each of its passes.

    ``weights`` (source, weight) may leave sources out (weight 0); without it weights are 1, 2, 3 in turn.
    """
    sized = sized.select(_key(F.col("source")).alias("sk"), "size", "u")
    sources = sized.groupBy("sk").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    if weights is None:
        sources = cycled_weights(sources)
    else:
        own = weights.groupBy(_key(F.col("source")).alias("sk")).agg(F.max("weight").alias("weight"))
        sources = sources.join(own, "sk", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    sources = stored(cuts(sized, targets(sources, most)))
    if shards is None:
        shards = max(1, -(-int(sources.agg(F.sum("target")).first()[0] or 0) // words_per_shard))
    last = F.when(F.col("hi").isNotNull() | F.col("lo").isNotNull(), F.col("cut") + 1).otherwise(F.coalesce("cut", F.lit(0)))
    n = F.col("passes") * F.col("n_blocks") + F.when(F.col("rest") > 0, last).otherwise(0)
    units = sources.select("sk", "n_blocks", n.cast("bigint").alias("n")).filter("n > 0")
    ends = split_quotas(units, shards, seed).withColumn("upto", F.sum("n").over(W.partitionBy("sk").orderBy("shard")))
    every = units.select("sk", "n_blocks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("unit"))
    drawn = every.withColumn("rank", F.row_number().over(W.partitionBy("sk").orderBy(unit(F.lit(seed), F.col("sk"), F.col("unit")), "unit")))
    dealt = drawn.join(ends, "sk").filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - ends["n"]))
    blocks = dealt.groupBy("sk", (F.col("unit") % F.col("n_blocks")).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct(F.floor(F.col("unit") / F.col("n_blocks")).alias("pass"), "shard"))).alias("dealt"))
    return sources, blocks.select("sk", "block", F.transform("dealt", lambda x: x["shard"]).alias("shards"))


def with_shards(docs: DataFrame, source: str, size: Column, u: Column, plan: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with source_size, target and the shards that take a copy, under names that clash with no column."""
    sources, blocks = plan
    names = dict(zip(("sk", "size", "u", "block", "source_size", "target", "shards"), fresh(docs, ["_sk", "_size", "_u", "_block", "source_size", "target", "shards"]), strict=True))
    rows = docs.withColumns({names["sk"]: _key(F.col(source)), names["size"]: size, names["u"]: u}).alias("d")
    rows = rows.join(sources.alias("s"), F.col(f"d.{names['sk']}") == F.col("s.sk"), "left")
    mine = F.struct(F.col(f"d.{names['size']}").alias("size"), F.col(f"d.{names['u']}").alias("u"))
    block = block_of(F.col(f"d.{names['u']}"), F.col("s.n_blocks"))
    edge = F.coalesce(mine >= F.col("s.hi"), F.lit(False)) | F.coalesce(mine <= F.col("s.lo"), F.lit(False))
    extra = F.coalesce((F.col("s.rest") > 0) & ((block < F.col("s.cut")) | ((block == F.col("s.cut")) & edge)), F.lit(False))
    copies = fresh(docs, ["_copies"])[0]
    rows = rows.select("d.*", block.alias(names["block"]), F.col("s.source_size").alias(names["source_size"]), F.col("s.target").alias(names["target"]),
                       (F.col("s.passes") + extra.cast("int")).cast("int").alias(copies)).alias("d")
    rows = rows.join(blocks.alias("b"), (F.col(f"d.{names['sk']}") == F.col("b.sk")) & (F.col(f"d.{names['block']}") == F.col("b.block")), "left")
    shards = F.when(F.col(f"d.{copies}") > 0, F.slice("b.shards", F.lit(1), F.col(f"d.{copies}"))).otherwise(F.array().cast("array<int>"))
    return rows.select("d.*", shards.alias(names["shards"])).drop(copies), names


def _facts(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("bigint").alias("size"), unit(F.lit(seed), F.col(key)).alias("u"))


def mix_report(docs: DataFrame, weights: DataFrame | None = None, most: int = 3, shards: int | None = None, seed: int = 0, key: str = "doc_id",
               text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shards) of every row of ``docs``.

    A null text has size 0; a null source is a source of its own; rows that repeat a key are taken alike. Draws depend on the key
    and the seed only, so reruns agree.
    """
    facts = stored(_facts(docs, key, text, source, seed))
    rows, names = with_shards(facts, "source", F.col("size"), F.col("u"), mix_plan(facts, weights, most, shards, seed=seed))
    return rows.select("doc_id", "source", "size", F.col(names["source_size"]).alias("source_size"), F.col(names["target"]).alias("target"),
                       (F.col("size") * F.size(names["shards"])).alias("taken"), F.col(names["shards"]).alias("shards"))


def mix(docs: DataFrame, weights: DataFrame | None = None, most: int = 3, shards: int | None = None, seed: int = 0, key: str = "doc_id",
        text: str = "text", source: str = "source", shard: str | None = None) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy taken, each shard in a random order of its own in one partition.

    Documents that the mix leaves out have no row. ``shard`` names a column for the shard.
    """
    facts = stored(_facts(docs, key, text, source, seed))
    plan = mix_plan(facts, weights, most, shards, seed=seed)
    rows, names = with_shards(docs, source, F.size(words(F.col(text))).cast("bigint"), unit(F.lit(seed), F.col(key)), plan)
    to, place = fresh(rows, ["_to", "_place"])
    rows = rows.select(*docs.columns, F.posexplode(names["shards"]).alias(place, to))
    rows = rows.withColumn(place, unit(F.lit(seed + 1), F.col(key), F.col(place)))
    count = max(1, int(plan[1].agg(F.max(F.array_max("shards"))).first()[0] or 0) + 1)
    rows = rows.repartitionByRange(count, to).sortWithinPartitions(to, place)
    return rows.select(*[c for c in docs.columns if c != shard], *([F.col(to).alias(shard)] if shard else []))
