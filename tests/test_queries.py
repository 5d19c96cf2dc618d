"""Registered queries against their SQL on the smallest tables.

A spread of them runs by default; BARLOOM_ALL=1 runs every one.
"""

import os
from pathlib import Path

import duckdb
import pytest

from barloom.registry import load_all
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
CASES = load_all()
PICKED = ("prj06", "pan04", "pan08", "src05", "win03", "win09", "win14", "win18", "xs02", "xs10", "lab02", "lab05", "spl05", "spl07",
          "fit01", "fit05", "fit11", "eval02", "eval10", "eval17_diebold_mariano_simple", "eval20", "pf02", "pf10", "pf12", "led01", "led05")
NAMES = [n for n in CASES if CASES[n].sql and (os.environ.get("BARLOOM_ALL") or n.startswith(PICKED))]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got, want = rows_of(CASES[name].query(spark, SF).toPandas()), rows_of(con.sql(CASES[name].sql).df())
    assert got[1] == want[1]
    assert got[0] == want[0]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
