"""Registered queries: each operator run over the given tables, with an independent
SQL text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.registry.tables import SQL_TABLES

NUDGE = 1e-9  # moves exact half-way decimals off the rounding edge, alike in both engines
Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Case:
    query: Query
    sql: str | None


CASES: dict[str, Case] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for comparison across engines; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(F.col(f.name) + F.lit(NUDGE), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def _needed(names: Sequence[str]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for name in names:
        needs, text = SQL_TABLES[name]
        for item in [*_needed(needs), (name, text)]:
            if item not in out:
                out.append(item)
    return out


def build_sql(sql: str, uses: str, ctes: Sequence[tuple[str, str]], nums: str) -> str:
    tables = [*_needed(uses.split()), *ctes]
    rec = "RECURSIVE " if any("(" in n or "RECURSIVE" in t for n, t in tables) else ""
    head = f"WITH {rec}" + ", ".join(f"{n} AS ({t})" for n, t in tables) + " " if tables else ""
    fixes = ", ".join(f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in nums.split())
    pick = f"* REPLACE ({fixes})" if fixes else "*"
    return f"{head}SELECT {pick} FROM ({sql}) AS result"


def case(name: str, sql: str | None = None, uses: str = "", nums: str = "",
         ctes: Sequence[tuple[str, str]] = ()) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in CASES:
            raise ValueError(f"{name} registered twice")
        text = None if sql is None else build_sql(sql, uses, ctes, nums)
        CASES[name] = Case(lambda spark, sf: rounded(fn(spark, sf)), text)
        return fn

    return register


def load_all() -> dict[str, Case]:
    from importlib import import_module

    for module in ("ingest", "features", "folds", "scoring", "metrics", "portfolio", "grouped", "ledger"):
        import_module(f"barloom.registry.{module}")
    return CASES
