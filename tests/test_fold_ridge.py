"""Ridge from merged moments, per key and per fold of overlapping spans."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators.scoring import fold_ridge, moments, ridge_fit, walk_forward_ridge, walk_forward_score
from barloom.operators.splits import fold_expand

SPANS = [(0, "train", 0, 40), (0, "val", 45, 60), (1, "train", 0, 55), (1, "val", 50, 75), (2, "train", 20, 70), (2, "val", 72, 90), (3, "train", 95, 96),
         (3, "val", 0, 100)]


def rows(n=5000, seed=1):
    rng = np.random.default_rng(seed)
    d = pd.DataFrame(rng.normal(size=(n, 4)), columns=list("abcy"))
    d["a"] += 1e8
    d["y"] += 3 * (d.a - 1e8) - d.b
    d["symbol"], d["date_idx"] = np.arange(n), rng.integers(0, 100, n)
    d["date"] = d.date_idx
    d.loc[::50, "b"] = np.nan
    return d


def test_moments_merge(spark):
    d = rows()
    df = spark.createDataFrame(d).repartition(7).withColumn("b", F.when(~F.isnan("b"), F.col("b"))).withColumn("k", F.when(F.col("symbol") % 3 > 0, F.col("symbol") % 3))
    for r in moments(df, list("abcy"), by=["k"]).collect():
        part = d[(d.symbol % 3 == (r.k or 0))].dropna()[list("abcy")].to_numpy()
        assert r.n == len(part) and np.allclose(r.mean, part.mean(0), rtol=1e-12)
        centred = part - part.mean(0)
        assert np.allclose(np.reshape(r.cross, (4, 4)), centred.T @ centred, rtol=1e-6, atol=1e-3)
    assert moments(df.filter("false"), ["a", "y"], by=["k"]).count() == 0
    assert moments(df, ["a", "y"], by=[]).first().n == 5000


def test_folds_without_copies(spark):
    d = rows()
    df = spark.createDataFrame(d).repartition(5).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    folds = spark.createDataFrame(SPANS, "fold int, role string, lo int, hi int")
    expanded = fold_expand(df, folds)
    want = {r.fold: r for r in ridge_fit(expanded.filter("role = 'train'"), list("abc"), "y").collect()}
    got = {r.fold: r for r in fold_ridge(df, folds, list("abc"), "y").collect()}
    assert got.keys() == want.keys() == {0, 1, 2, 3}
    for fold, r in got.items():
        assert r.n == want[fold].n and np.allclose(r.coef, want[fold].coef, atol=1e-6)
    one = {(r.symbol, r.fold, round(r.pred, 3)) for r in walk_forward_ridge(df, folds, list("abc"), "y").collect()}
    two = {(r.symbol, r.fold, round(r.pred, 3)) for r in walk_forward_score(expanded, list("abc"), "y").collect()}
    assert {x[:2] for x in one} == {x[:2] for x in two} and len(one) > 1500
    assert max(abs(a[2] - b[2]) for a, b in zip(sorted(one), sorted(two), strict=True)) < 0.01
    plan = walk_forward_ridge(df, folds, list("abc"), "y")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
