"""Inputs of the registered queries, in Spark and in SQL.

``bars`` is one symbol per supplier and one bar per ship date; ``scores`` holds two
simple signals and a forward return per (symbol, date), with the year as fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.grouping import along_time
from barloom.sources.bars import supplier_bars

SQL_TABLES: dict[str, tuple[list[str], str]] = {
    "bars": ([], """
        SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
               avg(l_extendedprice / l_quantity) AS open, max(l_extendedprice / l_quantity) AS high,
               min(l_extendedprice / l_quantity) AS low,
               sum(l_extendedprice / l_quantity * l_quantity) / sum(l_quantity) AS close,
               sum(l_quantity) AS volume
        FROM lineitem GROUP BY 1, 2"""),
    "px": (["bars"], """
        SELECT symbol, date, close, volume, row_number() OVER w AS rn, lag(close) OVER w AS prev
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)"""),
    "ret": (["px"], "SELECT *, coalesce(close / prev - 1, 0) AS r FROM px"),
    "days": (["bars"], "SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_idx FROM (SELECT DISTINCT date FROM bars)"),
    "scores": (["bars"], """
        SELECT * FROM (
          SELECT symbol, date, year(date) - 1995 AS fold,
                 close / lag(close, 5) OVER w - 1 AS pred_a,
                 close / avg(close) OVER (w ROWS 19 PRECEDING) - 1 AS pred_b,
                 lead(close, 5) OVER w / close - 1 AS y
          FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
        WHERE pred_a IS NOT NULL AND y IS NOT NULL"""),
    "daily": (["ret"], "SELECT date, avg(r) AS r FROM ret GROUP BY date"),
}


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return supplier_bars(spark, sf)


def px(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("symbol", "date", "close", "volume")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("close")
    return (
        along_time(
            px(spark, sf),
            {
                "pred_a": lambda t: c / F.lag("close", 5).over(t.w) - 1,
                "pred_b": lambda t: c / F.avg("close").over(t.last(20)) - 1,
                "y": lambda t: F.lead("close", 5).over(t.w) / c - 1,
            },
            back=19, ahead=5,
        )
        .filter(F.col("pred_a").isNotNull() & F.col("y").isNotNull())
        .select("symbol", "date", (F.year("date") - 1995).alias("fold"), "pred_a", "pred_b", "y")
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Equal-weight market return per date."""
    from barloom.operators.cross import market_return
    from barloom.operators.returns import simple_return

    return market_return(simple_return(px(spark, sf), out="r"), "r", out="r")
