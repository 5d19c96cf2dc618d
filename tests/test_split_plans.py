"""Long groups are cut into pieces; the results must not change."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import grouping as G
from barloom.operators import cross, labels, metrics, panel, portfolio, rolling, scoring, splits
from barloom.operators import returns as R
from barloom.plans.features import enhanced_feature_set
from tests.helpers import same, walk


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(hot=150)).repartition(3).persist()


def both(spark, build, keys=("symbol", "date"), tol=1e-9):
    plain = build().toPandas()
    spark.conf.set("barloom.rows.per.task", "7")
    try:
        split = build().toPandas()
    finally:
        spark.conf.unset("barloom.rows.per.task")
    assert len(plain)
    same(plain, split, keys, tol)


@pytest.mark.parametrize("op", [
    lambda d: R.vol_adjusted_return(d), lambda d: R.forward_realized_vol(d), lambda d: rolling.sma(d), lambda d: rolling.momentum(d, periods=[5, 21]),
    lambda d: rolling.expanding_zscore(d, ["close"]), lambda d: rolling.amihud_illiquidity(d), lambda d: G.positions(d, ["symbol"], "date"),
    lambda d: rolling.sequence_aggregates(d, ["close"], 10), lambda d: rolling.frac_diff(d, "close", 0.4, 1e-3), lambda d: cross.cs_pct_rank(d, ["volume"]),
    lambda d: cross.group_quantile_labels(d, "volume", by=["symbol"]), lambda d: cross.signal_deciles(d, "volume"),
    lambda d: portfolio.rank_positions(d, "volume", 2, 2), lambda d: portfolio.ensemble_signal_output(d, "close", by=["symbol"]),
    lambda d: panel.date_index(d), lambda d: splits.time_or_random_split(d, by_time=False), lambda d: metrics.equity_curve(
        d.withColumn("r", F.col("volume") / 1000 - 0.03), "r", by=["symbol"]),
    lambda d: metrics.drawdowns(d, "close", by=["symbol"]),
])
def test_operator(spark, bars, op):
    both(spark, lambda: op(bars))


def test_trailing_moments_without_sliding_frames(spark):
    rng = np.random.default_rng(5)
    d = pd.DataFrame({"symbol": np.repeat(["a", "b", "c"], [120, 4, 33]), "date": np.r_[0:120, 0:4, 0:33]})
    d["x"] = 1e6 + rng.normal(size=len(d)).cumsum()
    d["r"] = rng.normal(size=len(d))
    d.loc[40:60, "x"] = 7.25  # constant frames
    d.loc[(d.index % 11 == 3) | (d.index > 140), ["x", "r"]] = None
    table = spark.createDataFrame(d.astype(object).where(d.notna(), None), "symbol string, date long, x double, r double")

    def build():
        z = rolling.rolling_zscore(table, ["x", "r"], 6)
        return rolling.idiosyncratic_vol(z, "r", 7, 3, "iv")

    plan = build()._jdf.queryExecution().toString()
    assert "RowFrame, -5, currentrow" not in plan and "RowFrame, -6, currentrow" not in plan
    both(spark, build)
    got = build().toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    d["m"] = d.groupby("date").r.transform("mean")
    for _, rows in d.groupby("symbol"):
        for k, i in enumerate(rows.index):
            for c in ("x", "r"):
                part = rows[c].iloc[max(0, k - 5):k + 1].dropna()
                want = 0.0 if k == 0 else np.nan if pd.isna(rows[c][i]) else (rows[c][i] - part.mean()) / (part.std(ddof=0) + 1e-12)
                assert np.isclose(got[f"z_{c}"][i], want, rtol=1e-6, atol=1e-6, equal_nan=True)
            part = rows.iloc[max(0, k - 6):k + 1].dropna(subset=["r"])
            want = np.nan
            if k >= 7 and len(part) > 3:
                want = np.std(part.r - np.polyval(np.polyfit(part.m, part.r, 1), part.m)) if part.m.std() > 0 else 0.0
            assert np.isclose(got.iv[i], want, rtol=1e-6, atol=1e-6, equal_nan=True)


def test_events_and_weights(spark, bars):
    vol = rolling.ewm_vol(bars, span=20, out="vol")
    both(spark, lambda: labels.triple_barrier_events(vol), ("symbol", "t0"))
    both(spark, lambda: labels.sample_weights(labels.triple_barrier_events(vol), 0.01).select("symbol", "t0", "weight"), ("symbol", "t0"))


def test_rank_correlation_and_quantiles(spark, bars):
    d = R.forward_return(bars, out="y").withColumn("fold", F.year("date"))
    both(spark, lambda: metrics.spearman_ic(d, "y", "volume"), ("fold",))
    both(spark, lambda: G.quantiles(bars, ["symbol"], "volume", [0.1, 0.5, 0.9]).select("symbol", F.col("cuts")[1].alias("m")), ("symbol",))
    both(spark, lambda: portfolio.long_short_pooled(d, "volume", "y"), ("fold",))


def test_enhanced_set(spark, bars):
    both(spark, lambda: enhanced_feature_set(bars), tol=1e-7)


def test_recursions_survive_cutting(spark, bars):
    """Blocks are far longer than one cell here, so this checks carry across block edges."""
    pdf = walk(1, 60, hot=2500)
    d = spark.createDataFrame(pdf)
    got = rolling.rsi_wilder(d, period=3).toPandas().sort_values("date")["rsi"].to_numpy()
    chg = pdf["close"].diff().fillna(0).to_numpy()
    gain, loss = chg.clip(min=0), (-chg).clip(min=0)
    ag, al = gain[1:4].mean(), loss[1:4].mean()
    want = [0, 0, 0, 100 - 100 / (ag / (al + 1e-8) + 1)]
    for g, lo in zip(gain[4:], loss[4:]):
        ag, al = ag + (g - ag) / 3, al + (lo - al) / 3
        want.append(100 - 100 / (ag / (al + 1e-8) + 1))
    assert abs(got - want).max() < 1e-8
    ewm = rolling.ewm_vol(d, span=5).toPandas().sort_values("date")["ewm_vol"].to_numpy()
    ref = pdf["close"].pct_change().ewm(span=5).std().clip(lower=1e-8).to_numpy()
    assert pd.isna(ewm[:2]).all() and abs(ewm[2:].astype(float) - ref[2:]).max() < 1e-9


def test_soft_rank_grid_is_near_exact(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=3000)
    d = spark.createDataFrame(pd.DataFrame({"date": 1, "x": x}))
    got = scoring.soft_rank(d, ["x"]).toPandas().sort_values("x")["soft_rank_x"].to_numpy()
    s = np.sort(x)
    want = (0.5 * (1 + np.tanh((s[:, None] - s[None, :]) / 0.2))).sum(axis=1)
    assert abs(got - want).max() < 1.0


def test_long_keys_with_many_values(spark):
    """20 000 distinct values, a hot key, long shared prefixes, ties and NULLs, cut into pieces of 500 rows."""
    rng = np.random.default_rng(7)
    n = 20_000
    d = spark.createDataFrame(pd.DataFrame({
        "fold": np.where(rng.random(n) < 0.8, 0, rng.integers(1, 4, n)), "symbol": [f"SUPPLIER#{i:09d}" for i in rng.permutation(n)],
        "at": np.arange(n), "pred": rng.normal(size=n), "tied": rng.integers(0, 50, n).astype(float), "y": rng.normal(size=n)})).withColumn(
        "pred", F.when(F.col("at") % 97 > 0, F.col("pred"))).repartition(5)

    def compare(build, keys=("at",)):
        plain = build().toPandas()
        spark.conf.set("barloom.rows.per.task", "500")
        try:
            split = build().toPandas()
        finally:
            spark.conf.unset("barloom.rows.per.task")
        same(plain, split, keys)

    compare(lambda: G.ordered(d, ["fold"], ["pred", "symbol"], total="n"))
    compare(lambda: G.ordered(d, ["fold"], ["tied", "symbol"]))
    compare(lambda: G.ordered(d, [], ["symbol"]))
    compare(lambda: G.average_rank(d, ["fold"], ["pred", "tied"], counts=True))
    compare(lambda: G.quantiles(d, ["fold"], "pred", [0.01, 0.5, 0.9]).select("fold", F.col("cuts")[0].alias("a"), F.col("cuts")[2].alias("b")), ("fold",))
    compare(lambda: G.running(d, {"s": ("sum", F.col("y")), "m": ("max", F.col("pred"))}, ["fold"], "at"))
    compare(lambda: G.along_time(d, {"s": lambda t: F.sum("y").over(t.last(20))}, by=["fold"], time="at", back=19))
    compare(lambda: portfolio.long_short_pooled(d.withColumn("date", F.col("at")), "pred", "y"), ("fold",))
    compare(lambda: portfolio.ensemble_signal_output(d.withColumn("date", F.lit(1)), "pred", by=["fold"]), ("at",))


def test_average_rank_cells(spark):
    """A value that fills most of a long key, nulls, NaN, null keys, whole numbers, and no key at all, cut into cells of 300 rows."""
    rng = np.random.default_rng(11)
    n = 6000
    d = spark.createDataFrame(pd.DataFrame({"at": np.arange(n), "k": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 40, n)), "x": rng.normal(size=n)}))
    d = d.withColumns({"k": F.when(F.col("k") != 3, F.col("k")), "x": F.when(F.col("at") % 2 == 0, F.lit(0.25)).when(F.col("at") % 5 == 0, F.lit(None)).when(
        F.col("at") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x")), "m": F.col("at") % 11}).repartition(5)
    for by in (["k"], []):
        plain = G.average_rank(d, by, ["x", "m"], counts=True, rows=10**6).toPandas()
        split = G.average_rank(d, by, ["x", "m"], counts=True, rows=300).toPandas()
        same(plain, split, ("at",))


def test_split_rank_runs_its_input_once(spark, split_small):
    """The split plan may not compute what it ranks again for counts, samples and joins."""
    runs = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    d = spark.range(2000).selectExpr("int(id % 2) as fold", "id * 7 % 1999 / 10 as y", "id * 11 % 1997 / 10 as p").mapInArrow(rows, "fold int, y double, p double")
    assert metrics.spearman_ic(d, "y", "p").count() == 2
    assert runs.value == 2000
