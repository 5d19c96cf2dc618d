"""Rolling rank correlation from incremental ranks, in one and in many blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import grouping
from barloom.operators import metrics
from barloom.operators.metrics import rolling_ic


def panel():
    rng = np.random.default_rng(4)
    frames = []
    for symbol, n in (("a", 400), ("b", 90), ("c", 5), (None, 40), ("e", 25)):
        x = rng.integers(0, 12, n) * 1.0 if symbol in ("b", None) else rng.normal(size=n)
        frames.append(pd.DataFrame({"symbol": symbol, "date": rng.permutation(n), "y": x, "p": np.where(rng.random(n) < 0.5, x, rng.integers(0, 6, n)), "tag": "t"}))
    frames.append(pd.DataFrame({"symbol": "flat", "date": range(30), "y": 1.0, "p": range(30), "tag": "t"}))
    return pd.concat(frames)


def brute(d, window, late):
    out = {}
    for symbol, part in d.groupby("symbol", dropna=False):
        part = part.sort_values("date")
        for i, date in enumerate(part.date):
            end = i + 1 - late
            w = part.iloc[max(0, end - window):max(0, end)]
            full = len(w) == window and w.y.nunique() > 1 and w.p.nunique() > 1
            out[None if pd.isna(symbol) else symbol, date] = w.y.rank().corr(w.p.rank()) if full else None
    return out


def test_values_leave_python_as_numbers():
    x = pd.Series([np.arange(9.0), np.arange(3.0)])
    found = metrics._block_spearman(4, 1).func(x, -x)
    assert all(v.dtype == np.float64 for v in found)
    assert np.allclose(found[0], [np.nan] * 4 + [-1.0] * 5, equal_nan=True) and np.isnan(found[1]).all() and len(found[1]) == 3


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("rows", [None, 30])
def test_against_new_ranks(spark, monkeypatch, late, rows):
    d = panel()
    if rows:  # many blocks a key
        monkeypatch.setattr(metrics, "frame_blocks", lambda df, back, by, time, _: grouping.frame_blocks(df, back, by, time, rows))
    got = {(r.symbol, r.date): r.rolling_ic for r in rolling_ic(spark.createDataFrame(d).repartition(3), "y", "p", 20, exclude_current=late).collect()}
    want = brute(d, 20, int(late))
    assert got.keys() == want.keys() and sum(v is not None for v in want.values()) > 300
    for k, v in want.items():
        assert (v is None) == (got[k] is None), k
        assert v is None or abs(v - got[k]) < 1e-9


def test_columns_and_edges(spark):
    df = spark.createDataFrame(panel()).withColumn("deep", F.struct("y", F.array("p")))
    out = rolling_ic(df, "y", "p", 20)
    assert out.columns == [*df.columns, "rolling_ic"] and out.count() == df.count()
    assert rolling_ic(df.filter("false"), "y", "p", 20).count() == 0
    assert rolling_ic(df, "y", "p", 5000).filter("rolling_ic is not null").count() == 0
