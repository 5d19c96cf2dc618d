"""Hand-computed and published values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.operators import boosting, inference, labels, ledger, metrics, panel, rolling, scoring, series, splits
from barloom.operators import returns as R
from barloom.sources import store
from tests.helpers import same, walk


def ints(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_uniqueness(spark):
    ev = ints(spark, symbol=["A"] * 4, t0_pos=[0, 1, 2, 5], t1_pos=[2, 3, 4, 7], ret=[0.05, -0.03, 0.02, 0.10])
    got = labels.sample_weights(labels.avg_uniqueness(ev)).orderBy("t0_pos").toPandas()
    u = [0.6111111111, 0.4444444444, 0.6111111111, 1.0]
    assert np.allclose(got["uniqueness"], u) and np.allclose(got["weight"], np.array(u) * [0.05, 0.03, 0.02, 0.10])


def test_uniqueness_edges(spark):
    one = ints(spark, symbol=["A"], t0_pos=[3], t1_pos=[5])
    back = ints(spark, symbol=["A"], t0_pos=[5], t1_pos=[3])
    three = ints(spark, symbol=["A"] * 3, t0_pos=[0] * 3, t1_pos=[4] * 3)
    assert labels.avg_uniqueness(one).first()["uniqueness"] == 1.0
    assert labels.avg_uniqueness(back).first()["uniqueness"] == 0.0
    assert all(abs(r["uniqueness"] - 1 / 3) < 1e-12 for r in labels.avg_uniqueness(three).collect())


def test_fractional_weights(spark):
    assert np.allclose(rolling.ffd_weights(0.35, 0.05), [1, -0.35, -0.11375, -0.0625625])
    assert rolling.ffd_weights(1.0) == [1.0, -1.0] and rolling.ffd_weights(0.0) == [1.0]
    d = ints(spark, symbol=["A"] * 5, date=[1, 2, 3, 4, 5], x=[1.0, 2, 3, 4, 5])
    assert [r["frac_diff"] for r in rolling.frac_diff(d, "x", 1.0).orderBy("date").collect()] == [None, 1, 1, 1, 1]
    assert [r["frac_diff"] for r in rolling.frac_diff(d, "x", 0.0).orderBy("date").collect()] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        rolling.ffd_weights(1.5)


def test_long_fractional_window_matches_convolution(spark):
    x = np.arange(400.0) ** 0.5
    d = ints(spark, symbol=["A"] * 400, date=list(range(400)), x=x)
    w = rolling.ffd_weights(0.3, 3e-4)
    assert len(w) > 128
    got = rolling.frac_diff(d, "x", 0.3, 3e-4).orderBy("date").toPandas()["frac_diff"].to_numpy(float)
    assert np.isnan(got[:len(w) - 1]).all() and np.allclose(got[len(w) - 1:], np.convolve(x, w, "valid"))


def test_first_return_and_small_series(spark):
    d = ints(spark, symbol=["A"] * 4, date=[1, 2, 3, 4], close=[100.0, 102, 105, 103])
    got = R.simple_return(d).orderBy("date").toPandas()["simple_return"]
    assert got[0] == 0 and np.allclose(got[1:], [0.02, 105 / 102 - 1, 103 / 105 - 1])


def test_chronological_split(spark):
    d = ints(spark, symbol=["A"] * 100, date=list(range(100)))
    sizes = {r["role"]: r["count"] for r in splits.chronological_split(d).groupBy("role").count().collect()}
    assert sizes == {"train": 70, "val": 15, "test": 15}


def test_folds_never_overlap(spark):
    days = spark.range(1000).withColumnRenamed("id", "date")
    for sliding in (False, True):
        rows = splits.expanding_or_sliding_folds(days, 5, 0.5, 10, sliding).toPandas()
        tr, te = rows[rows.role == "train"].set_index("fold"), rows[rows.role == "test"].set_index("fold")
        assert (te["lo"] - tr["hi"] == 10).all() and te["hi"].max() == 1000 and len(te) == 5
    with pytest.raises(ValueError):
        splits.expanding_or_sliding_folds(days, 0)


def test_purged_split_and_kfold(spark):
    rng = np.random.default_rng(42)
    t0 = np.arange(100)
    t1 = t0 + rng.integers(1, 21, 100)
    d = ints(spark, idx=t0, t0=t0, t1=t1)
    got = splits.purged_split(d, 80, 100, t0="t0").toPandas()
    emb = int(0.01 * (t1.max() - t1.min()))
    assert set(got[got.role == "train"].idx) == {i for i in range(80) if t1[i] < 80 - emb}
    folds = splits.purged_kfold(d, 5, "t1", "t0")
    check = panel.set_checks(folds, ["idx"]).toPandas()
    assert (check["n_both"] == 0).all() and check["n_test"].sum() == 100
    for k, part in folds.toPandas().groupby("fold"):
        te, tr = part[part.role == "test"], part[part.role == "train"]
        lo, hi = te.idx.min(), te.idx.max() + 1
        want = {i for i in range(lo) if t1[i] < lo - emb} | {i for i in range(hi, 100) if i > te.t1.max() + emb}
        assert set(tr.idx) == want


TREE = ('{"trees": [[{"nodeid": 0, "split": 0, "split_condition": 0.5, "yes": 1, "no": 2, "missing": 1},'
        '{"nodeid": 1, "leaf": 0.3}, {"nodeid": 2, "leaf": -0.2}]]}')


def test_three_node_tree(spark):
    forest = store.forest_table(spark.createDataFrame([(TREE,)], "json string"))
    rows = spark.createDataFrame([(1, 0.2, 9.0), (2, 0.9, 9.0), (3, None, 9.0)], "id int, a double, b double")
    scores = {r["id"]: r["pred"] for r in boosting.forest_score(rows, forest, ["a", "b"]).collect()}
    assert scores == {1: 0.3, 2: -0.2, 3: 0.3}
    att = {(r["id"], r["feature"]): r["attribution"] for r in boosting.path_attribution(rows, forest, ["a", "b"], ["id"]).collect()}
    assert att[(1, "a")] == 0.3 and att[(2, "a")] == -0.2 and att[(1, "b")] == 0
    again = store.forest_table(store.forest_json(forest))
    same(forest.toPandas(), again.toPandas(), ("tree_id", "node_id"))


def test_boosting_learns_and_rolls_back(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 2))
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.01 * rng.normal(size=2000)
    d = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "v": np.arange(2000) % 4 == 0}))
    conf = boosting.BoostConfig(num_trees=4, max_depth=2, learning_rate=0.5, lambda_l2=0.0, max_bins=64, early_stopping=2)
    fit = boosting.boost_fit(d, ["a", "b"], "y", "mse", conf, validation="v")
    assert fit.train_losses[-1] < 0.2 and fit.train_losses == sorted(fit.train_losses, reverse=True)
    scored = boosting.forest_score(d, fit.forest(spark), ["a", "b"], fit.init).toPandas()
    assert abs(((scored.pred - scored.y)[~scored.v] ** 2).mean() - fit.train_losses[-1]) < 1e-6
    imp = {r["feature_idx"]: r["gain"] for r in boosting.forest_importance(fit.forest(spark)).collect()}
    assert imp[0] > 0.95


def test_gradients_are_derivatives(spark):
    d = spark.createDataFrame([(0.5, 0.2), (-1.0, 2.0), (1.0, 1.3)], "y double, p double")
    for name in ("mse", "huber", "logloss"):
        up = boosting.grad_hess(d.withColumn("p", F.col("p") + 1e-6), "y", "p", name).toPandas()
        here = boosting.grad_hess(d, "y", "p", name).toPandas()
        assert np.allclose((up.loss - here.loss) / 1e-6, here.grad, atol=1e-4)


def test_tails():
    assert abs(stats.normal_two_sided(1.959963984540054) - 0.05) < 1e-12
    assert abs(stats.student_two_sided(2.0, 10) - 0.0733880347707) < 1e-9
    assert abs(stats.binomial_at_least(9, 11) - sum(math.comb(11, k) for k in (9, 10, 11)) / 2**11) < 1e-12


def test_t_test_and_dm(spark):
    d = ints(spark, k=["a"] * 30, date=list(range(30)), x=np.linspace(-0.2, 0.5, 30), y=np.zeros(30))
    row = inference.t_test(d, "x").first()
    x = np.linspace(-0.2, 0.5, 30)
    assert abs(row["t_statistic"] - x.mean() / (x.std(ddof=1) / 30**0.5)) < 1e-9 and 0 < row["p_value"] < 0.01
    dm = inference.diebold_mariano(d, "x", "y", by=["k"]).first()
    assert abs(dm["dm_statistic"] - x.mean() / (x.var() / 30) ** 0.5) < 1e-9


def test_constant_signal_is_safe(spark):
    d = ints(spark, fold=[0] * 12, y=np.arange(12.0), p=np.ones(12))
    assert metrics.spearman_ic(d, "y", "p").first()["ic"] == 0
    assert metrics.spearman_ic(d, "y", "p", "library").first()["ic"] == 0
    q = ints(spark, fold=[0] * 12, y=np.arange(12.0), p=-np.arange(12.0))
    assert abs(metrics.spearman_ic(q, "y", "p").first()["ic"] + 1) < 1e-12


def test_sharpe_guards(spark):
    one = ints(spark, strategy=["s"], r=[0.1])
    flat = ints(spark, strategy=["s"] * 30, r=[0.25] * 30)
    assert metrics.sharpe(one, "r").first()["sharpe"] == 0
    assert metrics.sharpe(flat, "r", "sample").first()["sharpe"] == 0 and metrics.sharpe(flat, "r", "strict").first()["sharpe"] == 0
    assert metrics.sortino(flat, "r").first()["sortino"] == float("inf")


def test_equity_through_total_loss(spark):
    d = ints(spark, strategy=["s"] * 4, date=[1, 2, 3, 4], r=[0.5, -1.0, 0.2, 0.1])
    assert [round(r["equity"], 9) for r in metrics.equity_curve(d, "r").orderBy("date").collect()] == [1.5, 0, 0, 0]


def replay(fills):
    from barloom.streaming.ledger import apply_fill

    books = {}
    for f in sorted(fills, key=lambda f: f[2]):
        books[f[:2]] = apply_fill(books.get(f[:2], (0.0, 0.0, False, 0.0, 0.0, 0)), f[3], f[4], f[5])
    return books


def random_fills(n=600, seed=5):
    rng = np.random.default_rng(seed)
    return [("a", f"S{rng.integers(2)}" if i % 3 else "HOT", i, "buy" if rng.random() < 0.5 else "sell",
             float(rng.integers(1, 5)), float(rng.integers(5, 15))) for i in range(n)]


@pytest.mark.parametrize("block,rows", [(4096, "1000000"), (16, "1000000"), (16, "20")])
def test_positions_equal_replay(spark, monkeypatch, block, rows):
    """Whole sizes make positions pass through zero often; small blocks test the carry."""
    spark.conf.set("barloom.rows.per.task", rows)
    monkeypatch.setattr(ledger, "BLOCK", block)
    fills = random_fills()
    d = spark.createDataFrame(fills, "account string, symbol string, seq bigint, side string, qty double, price double").withColumn("filled_qty", F.lit(0.0))
    for r in ledger.fills_to_positions(d).collect():
        q, avg, held, pl, cash, n = replay(fills)[(r["account"], r["symbol"])]
        assert abs(r["qty"] - q) < 1e-9 and abs(r["realized_pl"] - pl) < 1e-6 and abs(r["cash_flow"] - cash) < 1e-6 and r["n_fills"] == n
        if q:
            assert abs(r["avg_entry_price"] - avg) < 1e-9
    spark.conf.unset("barloom.rows.per.task")


def test_features_are_causal(spark):
    pdf = walk(3, 80)
    cut = sorted(pdf["date"].unique())[100]
    whole = rolling.base_features(spark.createDataFrame(pdf)).filter(F.col("date") <= F.lit(cut))
    past = rolling.base_features(spark.createDataFrame(pdf[pdf["date"] <= cut]))
    same(whole, past, tol=1e-9)


def test_order_and_partitions_do_not_matter(spark):
    pdf = walk(3, 80)
    a = rolling.base_features(spark.createDataFrame(pdf).repartition(1))
    b = rolling.base_features(spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(7))
    same(a, b)


def test_missing_column(spark):
    with pytest.raises(ValueError, match="volume"):
        rolling.base_features(spark.createDataFrame([("A", 1, 1.0)], "symbol string, date int, close double"))


def test_ridge_keeps_its_digits_for_large_means(spark):
    rng = np.random.default_rng(0)
    x = 1e8 + rng.normal(size=4000)
    d = spark.createDataFrame(pd.DataFrame({"fold": np.arange(4000) % 2, "x": x, "y": 3 * (x - 1e8) + 5}))
    for by in (("fold",), ()):
        for r in scoring.ridge_fit(d, ["x"], "y", 1e-6, by=by).collect():
            assert abs(r.coef[0] - 3) < 1e-4 and abs(r.intercept + r.coef[0] * 1e8 - 5) < 1e-3


def test_nan_goes_left_in_both_forms(spark):
    node = "tree_id int, node_id int, feature_idx int, split_value double, left int, right int, leaf_value double"
    forest = spark.createDataFrame([(0, 0, 0, 1.0, 1, 2, None), (0, 1, None, None, -1, -1, -10.0), (0, 2, None, None, -1, -1, 10.0)], node)
    d = spark.createDataFrame([(float("nan"),), (None,), (0.5,), (2.0,)], "x double")
    for inline in (400, 0):
        assert [r.pred for r in boosting.forest_score(d, forest, ["x"], inline_nodes=inline).collect()] == [-10.0, -10.0, -10.0, 10.0]


def test_adf_p_is_monotone_and_meets_its_knots():
    p = [series.adf_p(t, 100) for t in np.linspace(-8, 0, 200)]
    assert all(a <= b for a, b in zip(p, p[1:]))
    assert [series.adf_p(t, 100) for t in (-7.02, -3.51, -2.89, -2.58, -2.57)] == [0.001, 0.01, 0.05, 0.1, 0.5]
