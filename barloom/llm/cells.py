"""Neighbours in a global order without a global sort: rows are dealt to runs of neighbouring keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.llm.columns import fresh, let

MOST_CELLS = 10_000


def cell_starts(df: DataFrame, key: str, rows_per_cell: int) -> tuple[list[int], bool]:
    """Keys that begin runs of about ``rows_per_cell`` rows, and whether null keys occur. At most MOST_CELLS keys reach the driver."""
    n, known, low = df.agg(F.count("*"), F.count(key), F.min(key)).first()
    if not known:
        return [], n > 0
    cells = max(1, min(MOST_CELLS, math.ceil(known / rows_per_cell)))
    cuts = df.agg(F.percentile_approx(key, [i / cells for i in range(cells)], 10 * cells + 1000)).first()[0]
    return sorted({low, *cuts}), n > known


def longs(values: Sequence[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def cell_of(key: Column, starts: list[int]) -> Column:
    """Index of the run that holds ``key``, found in two steps over the sorted ``starts``; -1 for null."""
    step = max(1, math.isqrt(len(starts)))
    every, coarse = longs(starts), longs(starts[::step])

    def inside(row: Column) -> Column:
        return row * step + F.size(F.filter(F.slice(every, row * step + 1, step), lambda s: s <= key)) - 1

    return F.when(key.isNull(), F.lit(-1)).otherwise(let(F.size(F.filter(coarse, lambda s: s <= key)) - 1, inside))


def with_next(df: DataFrame, key: str, columns: list[str], ties: list[str], rows_per_cell: int = 512) -> DataFrame:
    """Each row with ``columns`` of the row after it by ascending ``key``, as ``next_*``; the first follows the last.

    The first rows of a run are also sent to the run before it, so that no sort spans two runs. Null keys come first; rows with
    equal keys stand in the order of ``ties``.
    """
    starts, nulls = cell_starts(df, key, rows_per_cell)
    cells = [-1] * nulls + list(range(len(starts)))
    if not cells:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    cell, to = fresh(df, ["_cell", "_to"])
    dealt = df.withColumn(cell, cell_of(F.col(key), starts) if starts else F.lit(-1))
    at_start = F.when(F.col(cell) >= 0, F.col(key) == F.element_at(longs(starts), F.col(cell) + 1)) if starts else F.lit(None)
    is_first = F.col(cell) == cells[0]
    own = F.struct(F.col(cell).alias("c"), F.lit(0).alias("k"))
    copy = F.struct(F.when(is_first, F.lit(cells[-1])).otherwise(F.col(cell) - 1).alias("c"),
                    F.when(is_first, F.lit(2)).otherwise(F.lit(1)).alias("k"))
    places = F.when(F.coalesce(at_start, F.lit(True)), F.array(own, copy)).otherwise(F.array(own))
    order = [F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ties]]
    run = W.partitionBy(f"{to}.c").orderBy(f"{to}.k", *order)
    following = (dealt.withColumn(to, F.explode(places)).drop(cell)
                 .withColumns({f"next_{c}": F.lead(c).over(run) for c in columns}))
    return following.filter(F.col(f"{to}.k") == 0).drop(to)
