"""Forests grown together, their histograms, and the sketches that bin them."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions.sketches import Distinct, sketch_boundaries
from barloom.operators import fold_forests
from barloom.operators.boosting import BoostConfig, bin_boundaries, boost_fit, grad_histogram
from barloom.operators.fold_forests import Member, grow_forests, logistic, score_forests, tune_by_sharpe, walk_forward_trees

FOLDS = [(0, "train", 0, 60), (0, "val", 70, 80), (1, "train", 20, 80), (1, "val", 75, 100), (2, "train", 0, 1), (2, "val", 1, 2)]
CONFIG = BoostConfig(num_trees=5, max_depth=3, learning_rate=0.3, max_bins=32, early_stopping=2)


def panel(n=6000, seed=1):
    rng = np.random.default_rng(seed)
    d = pd.DataFrame({"symbol": np.arange(n) % 40, "date": 0, "a": rng.normal(size=n), "b": rng.normal(size=n), "date_idx": rng.integers(0, 100, n)})
    d["y"] = np.where(d.a > 0.3, 2.0, -1.0) + d.b * d.b + rng.normal(size=n) * 0.1
    d["date"] = d.date_idx
    d.loc[::97, "a"] = np.nan
    d.loc[::101, "y"] = np.nan
    return d


def folds(spark):
    return spark.createDataFrame(FOLDS, "fold int, role string, lo long, hi long")


def nodes(forest):
    return sorted((r.tree_id, r.node_id, r.feature_idx, round(r.split_value, 9), r.num_samples, round(r.leaf_value, 9), round(r.gain, 5)) for r in forest.collect())


def test_equal_to_single_fits(spark):
    d = panel()
    scored, forests = walk_forward_trees(spark.createDataFrame(d).repartition(3), folds(spark), ["a", "b"], "y", CONFIG)
    assert [m.member.fold for m in forests.members] == [0, 1]  # fold 2 has too few rows
    for fold, role, lo, hi in FOLDS[:1]:
        own = d[((d.date_idx >= lo) & (d.date_idx < hi)) | ((d.date_idx >= 70) & (d.date_idx < 80))]
        one = boost_fit(spark.createDataFrame(own).withColumn("v", F.col("date_idx") >= 70), ["a", "b"], "y", "mse", CONFIG, validation="v")
        assert nodes(one.forest(spark)) == nodes(forests.forest(spark).filter(F.col("fold") == fold))
        assert np.allclose(one.val_losses, [v for _, v in forests.members[fold].losses[1:]])
    got = scored.toPandas()
    inside = d[(d.date_idx >= 70)]
    assert len(got) == len(inside)
    assert (got.fold == np.where(got.date_idx >= 75, 1, 0)).all()  # the later fold wins
    known = got.dropna()
    assert ((known.pred - known.y) ** 2).mean() < 0.35 * known.y.var()


def test_partitions_do_not_matter(spark):
    d = panel(2500, 2)
    config = BoostConfig(num_trees=3, max_depth=2, learning_rate=0.5, max_bins=16, subsample_col=0.5, min_samples_leaf=5, lambda_l1=0.1, monotone={0: 1})
    one, many = (grow_forests(spark.createDataFrame(d).coalesce(1).repartition(k), folds(spark), ["a", "b"], "y", [Member(7, 0, config)], rewrite_every=r)
                 for k, r in ((1, 1), (5, 50)))
    assert nodes(one.forest(spark)) == nodes(many.forest(spark)) and len(one.members[0].trees) == 3
    empty = grow_forests(spark.createDataFrame(d).filter("false"), folds(spark), ["a", "b"], "y", [Member(7, 0, config)])
    assert empty.members == [] and score_forests(spark.createDataFrame(d), empty, folds(spark)).count() == 0


def test_shuffled_and_collected_histograms_agree(spark, monkeypatch):
    d = panel(2500, 4)
    members = [Member(i, f, BoostConfig(num_trees=t, max_depth=3, learning_rate=0.3, max_bins=16, min_samples_leaf=5)) for i, (f, t) in enumerate([(0, 4), (1, 2)])]
    rows, first = spark.createDataFrame(d).repartition(3), []
    monkeypatch.setattr(fold_forests, "TASK_ROWS", 1000)
    for most in (fold_forests.COLLECTED, 3000, 0):  # all on the driver, some levels, none
        monkeypatch.setattr(fold_forests, "COLLECTED", most)
        found = grow_forests(rows, folds(spark), ["a", "b"], "y", members, rewrite_every=2)
        first = first or nodes(found.forest(spark))
        assert nodes(found.forest(spark)) == first and [len(m.trees) for m in found.members] == [4, 2]
    assert not spark.sparkContext._jsc.getPersistentRDDs()  # nothing is left in memory


def test_logistic_members_and_grid(spark):
    d = panel(3000, 3)
    d["y"] = (d.y > 0).astype(float)
    one = grow_forests(spark.createDataFrame(d), folds(spark), ["a", "b"], "y", [Member(0, 0, BoostConfig(num_trees=4, max_depth=3, learning_rate=0.5))], logistic)
    losses = [a for a, _ in one.members[0].losses]
    assert losses == sorted(losses, reverse=True) and len(losses) == 5
    long = spark.createDataFrame([(0, "train", 0, 60), (0, "val", 60, 100)], "fold int, role string, lo long, hi long")  # a Sharpe needs 20 days
    table, best = tune_by_sharpe(spark.createDataFrame(panel(3000, 4)).fillna(0.0, ["y"]), long, ["a", "b"], "y", [(1, 1, 0.01), (4, 3, 0.5)])
    rows = table.collect()
    assert len(rows) == 2 and rows[0].sharpe >= rows[1].sharpe and best.members[0].member.name == rows[0].member
    assert rows[0].trees == 4


def test_histograms_add_up(spark):
    rng = np.random.default_rng(5)
    d = pd.DataFrame({"node": rng.choice(["l", "r"], 5000), "grad": rng.normal(size=5000), "hess": rng.random(5000), "p": rng.integers(0, 9, 5000), "q": rng.integers(0, 300, 5000)})
    df = spark.createDataFrame(d).repartition(7).withColumn("node", F.when(F.col("node") == "l", "l"))
    got = {(r.node, r.feature, r.bin): (round(r.g, 9), round(r.h, 9), r.n) for r in grad_histogram(df, F.array("p", "q")).collect()}
    want = {}
    for i, name in enumerate(("p", "q")):
        for (node, b), part in d.groupby(["node", name]):
            want["l" if node == "l" else None, i, b] = (round(part.grad.sum(), 9), round(part.hess.sum(), 9), len(part))
    assert got == want
    plan = grad_histogram(df, F.array("p", "q"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "Generate" not in plan
    assert grad_histogram(df.filter("false"), F.array("p", "q")).count() == 0


def test_sketch_boundaries(spark):
    rng = np.random.default_rng(6)
    d = pd.DataFrame({"many": rng.normal(size=20_000), "few": rng.integers(0, 20, 20_000) * 1.0, "one": 3.0, "none": np.nan})
    df = spark.createDataFrame(d).repartition(6)
    names = ["many", "few", "one", "none"]
    exact = {r.feature: r.bounds for r in bin_boundaries(df, names, 64).collect()}
    got = {r.feature: r.bounds for r in sketch_boundaries(df, names, 64).collect()}
    assert got.keys() == exact.keys() and all(np.allclose(got[f], exact[f]) for f in got)
    thin = {r.feature: r.bounds for r in sketch_boundaries(df, names, 64, capacity=2000).collect()}
    ranks = np.searchsorted(np.sort(d.many), thin["many"]) / len(d)
    assert np.abs(ranks - np.arange(1, 64) / 64).max() < 4 * 0.5 / np.sqrt(2000)
    one, two = Distinct(500), Distinct(500)
    one.add(d.many.to_numpy()), two.add(d.many.to_numpy()[:7000])
    three = Distinct(500)
    three.add(d.many.to_numpy()[7000:])
    two.add(three.values, three.limit)
    assert (one.values == two.values).all() and one.limit == two.limit and abs(one.count / 20_000 - 1) < 0.2


def test_exact_boundaries_of_many_values(spark, monkeypatch):
    """Far more distinct values than a sketch holds, in several intervals and with folds in more than one mask."""
    d = panel(5000, 7)
    d["c"] = d.b.round(1)
    d.loc[::3, "b"] = -0.0
    rows, edges = spark.createDataFrame(d).repartition(4), {}
    members = [Member(f, f, BoostConfig(num_trees=1, max_depth=1, max_bins=16)) for f in (0, 1)]
    spark.conf.set("barloom.rows.per.task", "700")
    try:
        for masked in (62, 1):
            monkeypatch.setattr(fold_forests, "MASKED", masked)
            edges = grow_forests(rows, folds(spark), ["a", "b", "c"], "y", members, capacity=10, exact=True).edges
            for fold, lo, hi in ((0, 0, 60), (1, 20, 80)):
                seen = d[(d.date_idx >= lo) & (d.date_idx < hi) & d.y.notna()]
                for i, name in enumerate("abc"):
                    x = np.unique(seen[name].dropna() + 0.0)
                    assert len(x) > 16
                    assert edges[fold, i].tolist() == x[np.floor(np.arange(1, 16) / 16 * (len(x) - 1)).astype(int)].tolist()
    finally:
        spark.conf.unset("barloom.rows.per.task")


def test_cells_grow_the_forests_of_rows(spark, monkeypatch):
    """Rows of one cell are added up before the trees grow: same trees, losses and predictions as from blocks of rows."""
    d = panel(4000, 8)
    rows, config = spark.createDataFrame(d).repartition(3), BoostConfig(num_trees=12, max_depth=4, learning_rate=0.3, max_bins=16, early_stopping=3, min_samples_leaf=5)
    members = [Member(0, 0, config), Member(1, 1, config), Member(2, 1, BoostConfig(num_trees=4, max_depth=2, max_bins=8, subsample_col=0.5, lambda_l1=0.1))]
    found = []
    for most in (2**17, 0):
        monkeypatch.setattr(fold_forests, "CELLS", most)
        monkeypatch.setattr(fold_forests, "_level", fold_forests._level if not most else None)  # cells need no job per level
        forests = grow_forests(rows, folds(spark), ["a", "b"], "y", members)
        scored = score_forests(rows, forests, folds(spark), by_member=True).toPandas().sort_values(["member", "symbol", "date", "a", "b"]).reset_index(drop=True)
        found.append((nodes(forests.forest(spark)), [loss for m in forests.members for loss in m.losses], scored))
        monkeypatch.undo()
    (one, losses, pred), (many, row_losses, row_pred) = found
    assert one == many and np.allclose(losses, row_losses) and len(losses) > 10
    pd.testing.assert_frame_equal(pred, row_pred, rtol=1e-9)
