"""Ordered work inside a key when one key may hold a large part of all rows.

Every helper first checks how long the longest group is (one partially aggregated
count).  Groups that fit in a task use a plain window, one shuffle.  Otherwise the
group is split: along time into blocks of exactly ``rows`` positions with copied
edge rows, or along its order into as many intervals of that order as tasks need,
and the pieces are tied together by a small table of per-piece totals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import rows_per_task, written


@dataclass(frozen=True)
class Line:
    """What a time expression may use: an ordered window, the row's position, and the columns that the window is partitioned by."""

    w: WindowSpec
    pos: Column
    by: tuple[str, ...] = ()

    def last(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), 0)

    def between(self, lo: int, hi: int) -> WindowSpec:
        return self.w.rowsBetween(lo, hi)


Stage = dict[str, Callable[[Line], Column]]


_SEEN: dict[tuple, int] = {}


def longest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the longest group.

    Remembered per optimized plan of the key columns: steps that only add columns share
    it, so a chain of operators counts once.  The number only picks between two equally
    exact plans, so an outdated one costs time, never correctness.
    """
    keys = df.select(*by) if by else df.select(F.lit(1).alias("one"))
    mark = (df.sparkSession.sparkContext.applicationId, tuple(by), keys._jdf.queryExecution().optimizedPlan().semanticHash())
    if mark not in _SEEN:
        top = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if len(_SEEN) > 10_000:
            _SEEN.clear()
        _SEEN[mark] = int(top or 0)
    return _SEEN[mark]


def fits(df: DataFrame, by: Sequence[str], rows: int | None = None, longest: int | None = None) -> bool:
    """Whether every group fits in one task.  ``longest`` is an upper bound the caller
    already knows; without it one count job is run."""
    bound = longest_group(df, by) if longest is None else longest
    return bound <= (rows or rows_per_task(df.sparkSession))


def attach(df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a per-key table back to the rows; null keys match each other.

    Null-safe equality also keeps the optimizer from inferring filters between two branches
    of one table, which fails to bind when a key is computed from another column.
    """
    right = side.select(*[F.col(c).alias(f"__k_{c}") if c in on else F.col(c) for c in side.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in on])
    return df.join(right, cond, how).drop(*[f"__k_{c}" for c in on])


def group_stats(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Add group aggregates to every row: partial aggregation plus a join back."""
    stats = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    if by:
        return attach(df, stats, by)
    whole = stats.select(F.struct(*aggs)).scalar()  # one row of totals
    return df.withColumn("_all", whole).withColumns({n: F.col(f"_all.{n}") for n in aggs}).drop("_all")


def _offsets(cells: DataFrame, by: Sequence[str], order: Sequence[str], n: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))


def positions(
    df: DataFrame, by: Sequence[str], time: str, out: str = "pos", rows: int | None = None, longest: int | None = None,
) -> DataFrame:
    """0-based position of each row in its key, in time order."""
    return ordered(df, by, [time], out, rows=rows, longest=longest).withColumn(out, F.col(out) - 1)


def along_time(
    df: DataFrame, *stages: Stage, by: Sequence[str] = ("symbol",), time: str = "date",
    back: int = 0, ahead: int = 0, rows: int | None = None, drop: Sequence[str] = (), longest: int | None = None,
) -> DataFrame:
    """Evaluate bounded row frames per key.

    ``back`` and ``ahead`` are how far the stages look in total.  A key longer than
    ``rows`` is cut into blocks of ``rows`` positions; each block also receives the
    ``back`` rows before and the ``ahead`` rows after it, so frames stay exact.
    """
    rows = rows or rows_per_task(df.sparkSession)
    rows = max(rows, back, ahead, 1)
    if fits(df, by, rows, longest):
        w = Window.partitionBy(*by).orderBy(time)
        return _apply(df, stages, Line(w, F.row_number().over(w) - 1, tuple(by))).drop(*drop)
    placed = positions(df, by, time, "__at", rows, longest)
    own = F.floor(F.col("__at") / rows)
    into = F.col("__at") % rows
    homes = F.array_compact(F.array(
        own, F.when(into >= rows - back, own + 1), F.when(into < ahead, own - 1)))
    blocks = placed.withColumn("__home", own).withColumn("__blk", F.explode(homes))
    line = Line(Window.partitionBy(*by, "__blk").orderBy("__at"), F.col("__at"), (*by, "__blk"))
    done = _apply(blocks, stages, line).filter(F.col("__blk") == F.col("__home"))
    return done.drop("__at", "__home", "__blk", *drop)


def frame_blocks(df: DataFrame, back: int, by: Sequence[str] = ("symbol",), time: str = "date", rows: int = 2048) -> DataFrame:
    """Blocks of ``rows`` neighbouring rows of a key, each with the ``back`` rows before it, for functions of whole blocks.

    One row per block: by..., ``__blk``, and ``__rows``, an array of (at, row) in time order. ``unblock`` takes a block apart again.
    """
    rows = max(rows, back, 1)
    placed = positions(df, by, time, "__at")
    own = F.floor(F.col("__at") / rows)
    homes = F.array_compact(F.array(own, F.when(F.col("__at") % rows >= rows - back, own + 1)))
    row = F.struct(F.col("__at").alias("at"), F.struct(*df.columns).alias("row"))
    dealt = placed.withColumn("__blk", F.explode(homes)).groupBy(*by, "__blk").agg(F.collect_list(row).alias("__rows"), F.max(own).alias("__last"))
    full = dealt.filter(F.col("__last") >= F.col("__blk")).drop("__last")  # a block of copies only has no rows of its own
    # The position is unique in a block, so no row is compared beyond it.
    return full.withColumn("__rows", F.array_sort("__rows", lambda a, b: (a["at"] - b["at"]).cast("int"))).withColumn("__size", F.lit(rows))


def unblock(blocks: DataFrame, values: Column, out: str) -> DataFrame:
    """The rows that belong to each block, with the value of the array ``values`` at their place as ``out``."""
    each = blocks.select("__blk", "__size", F.explode(F.arrays_zip(F.col("__rows").alias("r"), values.alias("v"))).alias("__e"))
    mine = each.filter(F.floor(F.col("__e.r.at") / F.col("__size")) == F.col("__blk"))
    return mine.select("__e.r.row.*", F.col("__e.v").alias(out))


def _apply(df: DataFrame, stages: Sequence[Stage], line: Line) -> DataFrame:
    for stage in stages:
        df = df.withColumns({name: make(line) for name, make in stage.items()})
    return df


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame, parts: dict[str, tuple[str, Column]], by: Sequence[str] = ("symbol",),
    time: str = "date", rows: int | None = None, exclusive: bool = False, longest: int | None = None,
) -> DataFrame:
    """Running sum / max / min from the first row of the key to the current one."""
    end = -1 if exclusive else 0
    if fits(df, by, rows, longest):
        w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({n: _COMBINE[k](e).over(w) for n, (k, e) in parts.items()})
    cut = ranged(df.withColumns({f"_in_{n}": e for n, (_, e) in parts.items()}), by, [time], rows)
    totals = cut.groupBy(*by, "__cell").agg(
        *[_COMBINE[k](f"_in_{n}").alias(f"_t_{n}") for n, (k, _) in parts.items()])
    prior = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, "__cell", *[
        _COMBINE[k](f"_t_{n}").over(prior).alias(f"_c_{n}") for n, (k, _) in parts.items()])
    w = Window.partitionBy(*by, "__cell").orderBy(time).rowsBetween(Window.unboundedPreceding, end)
    local = cut.withColumns({n: _COMBINE[k](f"_in_{n}").over(w) for n, (k, _) in parts.items()})
    joined = attach(local, carry, [*by, "__cell"])
    join2 = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}
    out = joined.withColumns({
        n: join2[k](F.col(n), F.col(f"_c_{n}")) for n, (k, _) in parts.items()})
    return out.drop("__cell", *[f"_{p}_{n}" for n in parts for p in ("in", "c")])


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int | None = None) -> DataFrame:
    """The rows with ``__cell``: numbered intervals of the total order by key, then by all order columns together.

    There are as many cells as tasks of ``rows`` rows need, bounded by sampled splitters of full values; rows that agree in key and
    order share one. Bounds are drawn once, so the numbered rows are written before anything is computed from them.
    """
    size = rows or rows_per_task(df.sparkSession)
    df = written(df)  # it is counted, sampled and dealt: what made it runs once
    cells = max(1, -(-df.count() // size))
    return written(df.repartitionByRange(cells, *by, *order).withColumn("__cell", F.spark_partition_id()))


def ordered(
    df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rn", total: str | None = None,
    rows: int | None = None, longest: int | None = None,
) -> DataFrame:
    """1-based ordinal in the key under a total order, and optionally the key's size."""
    if fits(df, by, rows, longest):
        w = Window.partitionBy(*by).orderBy(*order)
        df = df.withColumn(out, F.row_number().over(w).cast("bigint"))
        return df if total is None else df.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*by)))
    cut = ranged(df, by, order, rows)
    sizes = cut.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    base = _offsets(sizes, by, ["__cell"], "__n", "__base")
    if total is not None:
        base = group_stats(base, by, **{total: F.sum("__n")})
    w = Window.partitionBy(*by, "__cell").orderBy(*order)
    local = cut.withColumn("__rn", F.row_number().over(w))
    joined = attach(local, base.drop("__n"), [*by, "__cell"])
    return joined.withColumn(out, F.col("__base") + F.col("__rn")).drop("__base", "__rn", "__cell")


def distribution(
    df: DataFrame, by: Sequence[str], col: str, rows: int | None = None, longest: int | None = None,
) -> DataFrame:
    """Distinct non-null values per key with their count ``n``, the number of smaller
    rows ``below`` and the key's ``total``.  Equal values are counted before the shuffle."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    if fits(counts, by, rows, longest):
        w = Window.partitionBy(*by).orderBy(col)
        return counts.withColumns({
            "below": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "total": F.sum("n").over(Window.partitionBy(*by)),
        })
    cut = ranged(counts, by, [col], rows)
    sizes = cut.groupBy(*by, "__cell").agg(F.sum("n").alias("__n"))
    base = group_stats(_offsets(sizes, by, ["__cell"], "__n", "__base"), by, total=F.sum("__n"))
    w = Window.partitionBy(*by, "__cell").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("__in", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return (
        attach(local, base.drop("__n"), [*by, "__cell"])
        .withColumn("below", F.col("__base") + F.col("__in")).drop("__cell", "__base", "__in")
    )


def average_rank(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], outs: Sequence[str] | None = None,
    counts: bool = False, rows: int | None = None, longest: int | None = None,
) -> DataFrame:
    """Rank with ties averaged; NULL stays NULL.  ``counts`` adds ``<out>_n``, the
    number of non-null values in the key."""
    outs = outs or [f"{c}_rank" for c in cols]
    if fits(df, by, rows, longest):
        new, parts = {}, Window.partitionBy(*by)
        for col, out in zip(cols, outs):
            order = parts.orderBy(F.col(col).asc_nulls_last())
            up_to = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
            new[out] = F.when(F.col(col).isNotNull(), (F.rank().over(order) + up_to) / F.lit(2.0))
            if counts:
                new[f"{out}_n"] = F.count(col).over(parts)
        if len(cols) <= 4:
            return df.withColumns(new)
        # Many sorts of the same rows: carry what is not ranked as one packed value.
        rest = [c for c in df.columns if c not in (*by, *cols)]
        packed = df.select(*by, *cols, F.struct(*rest).alias("__rest")).withColumns(new)
        return packed.select(*by, "__rest.*", *cols, *new)
    kept = ranked = written(df)
    size = rows or rows_per_task(df.sparkSession)
    plain = [c for c in cols if isinstance(kept.schema[c].dataType, T.NumericType) and not isinstance(kept.schema[c].dataType, T.DecimalType)]
    bounds = _cell_bounds(kept, by, plain, size) if plain else None
    for col, out in zip(cols, outs):
        if col in plain:
            ranked = _cell_rank(ranked, kept, bounds, by, col, out)
        else:
            side = distribution(kept, by, col, rows, longest)
            ranked = attach(ranked, side.select(*by, col, (F.col("below") + (F.col("n") + 1) / F.lit(2.0)).alias(out)), [*by, col])
    if counts:
        sizes = kept.groupBy(*by).agg(*[F.count(c).alias(f"{o}_n") for c, o in zip(cols, outs)])
        ranked = attach(ranked, sizes, by) if by else _matched(ranked, sizes, by)
    return ranked


def _matched(df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """``attach`` for a side whose size is bounded by rows over rows per task, which every task can hold."""
    return attach(df, F.broadcast(side), on, how) if on else df.join(F.broadcast(side), how=how)


def _cell_bounds(kept: DataFrame, by: Sequence[str], cols: Sequence[str], size: int) -> DataFrame:
    """Per key of more than ``size`` rows: values ``__b_<col>`` that cut it into cells of about half that. Written, so all uses agree."""
    sizes = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    top = sizes.agg(F.max("__n")).first()[0] or 0
    parts = max(2, -(-2 * top // size))
    probs, accuracy = F.array(*[F.lit(i / parts) for i in range(1, parts)]), max(10_000, 10 * parts)
    long_keys = sizes.filter(F.col("__n") > size).drop("__n")
    rows = _matched(kept.select(*by, *cols), long_keys, by, "inner") if by else kept.select(*cols)
    return written(rows.groupBy(*by).agg(*[F.array_distinct(F.percentile_approx(c, probs, accuracy)).alias(f"__b_{c}") for c in cols]))


def _cell_rank(ranked: DataFrame, kept: DataFrame, bounds: DataFrame, by: Sequence[str], col: str, out: str) -> DataFrame:
    """Average ranks from cells of the value range: rows in lower cells, and the rank inside the own one.

    A bound is a cell of its own (odd numbers), so a value that fills much of a key needs no order and is spread over tasks.
    """
    b, v = F.coalesce(F.col("__b"), F.array().cast(bounds.schema[f"__b_{col}"].dataType)), F.col(col)
    bound = bounds.select(*by, F.col(f"__b_{col}").alias("__b"))
    number = F.when(v.isNotNull(), 2 * F.size(F.filter(b, lambda x: x < v)) + F.exists(b, lambda x: x == v).cast("int"))

    def celled(df: DataFrame) -> DataFrame:
        return _matched(df, bound, by).withColumn("__cell", number).drop("__b")

    # Short keys have no bounds: they are cell 0 with nothing below.
    sizes = celled(_matched(kept.select(*by, col), bounds.select(*by), by, "inner") if by else kept.select(col)).groupBy(*by, "__cell").agg(F.count(col).alias("__n"))
    base = _offsets(sizes.filter("__cell is not null"), by, ["__cell"], "__n", "__below")
    apart = v.isNull() | (F.col("__cell") % 2 == 1)
    rows = celled(ranked).withColumn("__salt", F.when(apart, F.spark_partition_id()).otherwise(-1))
    w = Window.partitionBy(*by, "__cell", "__salt").orderBy(v)
    up_to = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__in", (F.rank().over(w) + up_to) / F.lit(2.0))
    inside = F.when(F.col("__cell") % 2 == 1, (F.col("__n") + 1) / F.lit(2.0)).otherwise(F.col("__in"))
    done = _matched(rows, base, [*by, "__cell"])
    return done.withColumn(out, F.when(v.isNotNull(), F.coalesce("__below", F.lit(0)) + inside)).drop("__cell", "__salt", "__in", "__n", "__below")


def quantiles(
    df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], out: str = "cuts",
    rows: int | None = None, longest: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, as an array."""
    if fits(df, by, rows, longest):
        return df.groupBy(*by).agg(F.percentile(col, F.array(*[F.lit(float(p)) for p in probs])).alias(out))
    spread = distribution(df, by, col, rows, longest)

    def at(place: Column) -> Column:  # value of the row at a 0-based place, found in its count range
        return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col(col)))

    cuts = []
    for p in probs:
        place = F.lit(float(p)) * (F.col("total") - 1)
        lo, hi = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        cuts.append(lo + (hi - lo) * part)
    return spread.groupBy(*by).agg(F.array(*cuts).alias(out))

