"""Bar tables: readers, reshaping of raw quotes, and the panel derived from line items."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import clean

FIELDS = ("open", "high", "low", "close", "volume")
BAR_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType())] + [T.StructField(f, T.DoubleType()) for f in FIELDS]
)
KEYED_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), *BAR_SCHEMA.fields])


def read_bars(spark: SparkSession, path: str, fmt: str = "csv", min_rows: int = 0) -> DataFrame:
    """A folder with one CSV per symbol (file stem = symbol), or a bar table in parquet."""
    if fmt == "csv":
        bars = (
            spark.read.schema(BAR_SCHEMA).option("header", True).csv(path)
            .withColumn("symbol", F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.csv", 1))
        )
    else:
        bars = spark.read.schema(KEYED_SCHEMA).format(fmt).load(path)
    bars = bars.select("symbol", "date", *[clean(F.col(f)).alias(f) for f in FIELDS])
    if min_rows:
        from barloom.operators.panel import min_history_filter

        bars = min_history_filter(bars, min_rows)
    return bars


def merge_symbols(*tables: DataFrame) -> DataFrame:
    """Concatenate bar tables; columns are matched by name."""
    cols = ("symbol", "date", *FIELDS)
    return reduce(lambda a, b: a.unionByName(b), [t.select(*cols) for t in tables])


def tidy_wide_quotes(df: DataFrame, time: str = "date") -> DataFrame:
    """Columns named ``<Field>|<TICKER>`` become one row per (ticker, time)."""
    quotes = [c for c in df.columns if c != time]
    long = df.unpivot([time], quotes, "name", "value")
    parts = F.split("name", r"\|")
    field = F.regexp_replace(F.lower(parts[0]), "^adj ", "")
    return (
        long.select(parts[1].alias("symbol"), F.col(time), field.alias("field"), clean(F.col("value")).alias("value"))
        .filter(F.col("field").isin(*FIELDS))
        .groupBy("symbol", time)
        .pivot("field", list(FIELDS))
        .agg(F.max("value"))
        .dropna(how="all", subset=list(FIELDS))
    )


# The accepted ticker form and the footnote marks to strip.
TICKER_FORM = r"^[A-Z]{1,8}(\.[A-Z]{1,5})?$"
FOOTNOTE = r"\[[^\]]*\]"


def clean_tickers(df: DataFrame, col: str = "ticker", order: str = "pos") -> DataFrame:
    """Strip footnotes, upper-case, keep well-formed tickers, first occurrence wins."""
    name = F.upper(F.trim(F.regexp_replace(col, FOOTNOTE, "")))
    return (
        df.select(name.alias("_t"), order)
        .filter(F.col("_t").rlike(TICKER_FORM))
        .groupBy("_t")
        .agg(F.min(order).alias(order))
        .select(F.translate("_t", ".", "-").alias("symbol"), order)
    )


def business_days(df: DataFrame, time: str) -> DataFrame:
    """Monday-to-Friday dates between the first and the last date of a series."""
    span = df.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias(time))
    return days.filter(F.weekday(time) < 5)


def calendar_resample_ffill(
    series: dict[str, DataFrame], time: str = "date", value: str = "value", bfill: bool = False,
) -> DataFrame:
    """Irregular (date, value) series on a common business-day calendar, last value carried.

    Each series is carried within its own span first; spans are then outer-joined and
    carried again.  ``bfill`` also fills the head from the future, which looks ahead.
    """
    grids = []
    for name, df in series.items():
        calendar = business_days(df, time)
        both = df.select(time, F.col(value).alias(name)).join(calendar.withColumn("_day", F.lit(True)), time, "full")
        grids.append(_carry(both, [name], time).filter("_day").drop("_day"))
    wide = reduce(lambda a, b: a.join(b, time, "full"), grids)
    wide = _carry(wide, list(series), time)
    if bfill:
        for name in series:
            head = wide.filter(F.col(name).isNotNull()).agg(F.min_by(name, time).alias("v")).scalar()
            wide = wide.withColumn(name, F.coalesce(name, head))
    return wide


def _carry(df: DataFrame, cols: Sequence[str], time: str) -> DataFrame:
    """Last known value per column; the calendar is one row per day, split by year when long."""
    return carry_forward(df, cols, by=(), time=time)


def carry_forward(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("symbol",), time: str = "date") -> DataFrame:
    from barloom.functions.grouping import running

    # The latest non-null value is the maximum of (time, value) over non-null rows so far.
    marks = {
        f"_ff_{c}": ("max", F.when(F.col(c).isNotNull(), F.struct(F.col(time).alias("t"), F.col(c).alias("v"))))
        for c in cols
    }
    out = running(df, marks, by=by, time=time)
    return out.withColumns({c: F.col(f"_ff_{c}.v") for c in cols}).drop(*marks)


def bars_from_trades(trades: DataFrame, symbol: Column, day: Column) -> DataFrame:
    """Daily bars of any (symbol, day, price, size) table: one partial aggregate."""
    px, qty = F.col("price"), F.col("size")
    return (
        trades.select(symbol.cast("string").alias("symbol"), day.cast("date").alias("date"), px, qty)
        .groupBy("symbol", "date")
        .agg(
            F.avg("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("close"),
            F.sum("size").alias("volume"),
        )
    )


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test panel: one symbol per supplier, one bar per ship date."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_suppkey", "l_shipdate",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
    )
    return bars_from_trades(items, F.col("l_suppkey"), F.col("l_shipdate"))


