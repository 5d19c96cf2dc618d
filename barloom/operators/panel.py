"""Universe, calendar and panel shaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import lit
from barloom.functions.grouping import along_time, attach, group_stats, positions
from barloom.sources.bars import carry_forward

KEY, TIME = ("symbol",), "date"


def min_history_filter(df: DataFrame, min_rows: int = 2500, *, by=KEY) -> DataFrame:
    keep = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows).select(*by)
    return df.join(keep, list(by), "left_semi")


def top_liquid_universe(df: DataFrame, n: int, lookback: int = 252, volume: str = "volume", *, time=TIME) -> DataFrame:
    """Rows of the ``n`` symbols with the largest mean volume over their last rows."""
    recent = Window.partitionBy("symbol").orderBy(F.col(time).desc())
    tail = df.select("symbol", time, volume).withColumn("_k", F.row_number().over(recent)).filter(F.col("_k") <= lookback)
    top = tail.groupBy("symbol").agg(F.avg(volume).alias("_v")).orderBy(F.desc("_v"), "symbol").limit(n)
    return df.join(top.select("symbol"), "symbol", "left_semi")


def calendar_intersect(df: DataFrame, *, time=TIME) -> DataFrame:
    """Rows on dates where every symbol is present."""
    everyone = df.agg(F.count_distinct("symbol")).scalar()
    full = df.groupBy(time).agg(F.count_distinct("symbol").alias("_n")).filter(F.col("_n") == everyone)
    return df.join(full.select(time), time, "left_semi")


def calendar_union_panel(df: DataFrame, *, time=TIME, grain: str = "month") -> DataFrame:
    """Every symbol on every date any symbol has; NULL where it has no row.

    Symbols are spread over the months of the calendar and meet its dates by an
    equi-join on the month, so the product is built in parallel pieces.
    """
    cell = F.trunc(time, grain)
    dates = df.select(time).distinct().withColumn("_cell", cell)
    months = dates.agg(F.collect_set("_cell")).scalar()
    names = df.select("symbol").distinct().withColumn("_cell", F.explode(months))
    grid = names.join(dates, "_cell").drop("_cell")
    return grid.join(df, ["symbol", time], "left")


def coverage_stats(df: DataFrame, *, time=TIME) -> DataFrame:
    per_day = df.groupBy(time).agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(
        F.min("n").alias("min_names"), F.percentile("n", lit(0.5)).alias("median_names"), F.max("n").alias("max_names"))


def panel_build(*tables: DataFrame, on: Sequence[str] = (TIME, "symbol"), how: str = "inner") -> DataFrame:
    """Align column groups (features, prices, volumes, targets) on (date, symbol)."""
    return reduce(lambda a, b: a.join(b, list(on), how), tables)


def triple_align(
    features: DataFrame, targets: DataFrame, liquidity: DataFrame, min_rows: int, *, on: Sequence[str] = (TIME, "symbol"),
) -> DataFrame:
    """Rows where features, target and liquidity are all non-null; short symbols dropped."""
    joined = panel_build(features.dropna(), targets.dropna(), liquidity.dropna(), on=on)
    return min_history_filter(joined, min_rows)


def macro_asof_join(df: DataFrame, macro: DataFrame, cols: Sequence[str], *, time=TIME) -> DataFrame:
    """Last known macro values on each panel date, for all symbols."""
    dates = df.select(time).distinct().withColumn("_want", F.lit(True))
    line = macro.select(time, *cols).join(dates, time, "full")
    known = carry_forward(line, cols, by=(), time=time).filter("_want").drop("_want")
    return attach(df, known, [time])


def date_index(df: DataFrame, out: str = "date_idx", *, time=TIME, longest: int | None = None) -> DataFrame:
    """Dense 0-based index of the date, counted on the distinct dates only."""
    return attach(df, positions(df.select(time).distinct(), (), time, out, longest=longest), [time])


def return_alignment(df: DataFrame, price: str = "close", scale: float = 100.0, *, by=KEY, time=TIME) -> DataFrame:
    """Each row with the next row's scaled log return and the previous squared return
    (the key's mean where there is none)."""
    nxt = along_time(
        df, {"next_return": lambda t: F.ln(F.lead(price).over(t.w) / F.col(price)) * lit(scale)}, by=by, time=time, ahead=1,
    ).filter(F.col("next_return").isNotNull())
    sq = F.col("next_return") * F.col("next_return")
    out = group_stats(nxt.withColumn("_sq", sq), by, _m=F.avg("_sq"))
    return along_time(
        out, {"sq_return_lag1": lambda t: F.coalesce(F.lag("_sq").over(t.w), F.col("_m"))}, by=by, time=time, back=1,
        drop=("_sq", "_m"))


def finite(col: str) -> Column:
    c = F.col(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < lit("inf"))


def valid_row_filter(
    df: DataFrame, features: Sequence[str], target: str, *, by: Sequence[str] = ("fold",), role: str = "role",
    min_train: int = 200, min_val: int = 50,
) -> DataFrame:
    """Rows with finite features and a target; folds with too few train or val rows are dropped."""
    ok = reduce(lambda a, b: a & b, [finite(c) for c in (*features, target)])
    rows = df.filter(ok)
    sizes = rows.groupBy(*by).agg(
        F.count_if(F.col(role) == "train").alias("_t"), F.count_if(F.col(role) == "val").alias("_v"))
    keep = sizes.filter((F.col("_t") >= min_train) & (F.col("_v") >= min_val)).select(*by)
    return rows.join(keep, list(by), "left_semi")


def impute_columns(
    df: DataFrame, cols: Sequence[str], how: str = "zero", *, by: Sequence[str] = ("fold",), role: str = "role",
) -> DataFrame:
    """NaN, infinite and NULL become 0, or the training mean of the fold (``how='mean'``)."""
    if how == "zero":
        return df.withColumns({c: F.when(finite(c), F.col(c)).otherwise(lit(0)) for c in cols})
    train = df.filter(F.col(role) == "train")
    means = train.groupBy(*by).agg(*[F.avg(F.when(finite(c), F.col(c))).alias(f"_m_{c}") for c in cols])
    out = attach(df, means, by)
    return out.withColumns({
        c: F.when(finite(c), F.col(c)).otherwise(F.coalesce(F.col(f"_m_{c}"), lit(0))) for c in cols
    }).drop(*[f"_m_{c}" for c in cols])


def set_checks(folds: DataFrame, key: Sequence[str], *, by: str = "fold", role: str = "role") -> DataFrame:
    """Per fold: sizes of train and test, and how many keys are in both."""
    roles = folds.groupBy(by, *key).agg(
        F.max((F.col(role) == "train").cast("int")).alias("tr"), F.max((F.col(role) != "train").cast("int")).alias("te"))
    return roles.groupBy(by).agg(
        F.sum("tr").alias("n_train"), F.sum("te").alias("n_test"), F.sum(F.col("tr") * F.col("te")).alias("n_both"),
        F.count(F.lit(1)).alias("n_keys"))
