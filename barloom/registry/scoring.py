"""Queries of fits, scores, blends and forests."""

import numpy as np
from pyspark.sql import functions as F

from barloom.functions.sketches import sketch_boundaries
from barloom.operators import boosting as B
from barloom.operators import fold_forests as R
from barloom.operators import inference as I
from barloom.operators import metrics as M
from barloom.operators import panel as P
from barloom.operators import scoring as S
from barloom.operators import splits as K
from barloom.registry import case
from barloom.registry import tables as X
from barloom.registry.folds import WF, wf
from barloom.registry.metrics import FOLD_IC, RANKS, RHO, SOFT, rolling_sql
from barloom.sources import store

FEATS = ["pred_a", "pred_b"]


def _closed(table: str, key: str, alpha: float = 1.0, y: str = "y") -> str:
    """Ridge with two features from centred sums."""
    c = lambda a, b: f"(covar_pop({a}, {b}) * count(*))"
    saa, sbb, sab = f"({c('pred_a', 'pred_a')} + {alpha})", f"({c('pred_b', 'pred_b')} + {alpha})", c("pred_a", "pred_b")
    say, sby, det = c("pred_a", y), c("pred_b", y), f"({saa} * {sbb} - {sab} * {sab})"
    return f"""SELECT *, my - wa * ma - wb * mb AS b0 FROM (SELECT {key}, count(*) AS n, avg({y}) AS my, avg(pred_a) AS ma, avg(pred_b) AS mb,
       ({say} * {sbb} - {sby} * {sab}) / {det} AS wa, ({sby} * {saa} - {say} * {sab}) / {det} AS wb FROM {table} GROUP BY {key})"""


_FIT = [("fit", _closed("scores", "fold"))]


@case("fit01_ridge_fit", "SELECT fold, n, b0 AS intercept, wa, wb FROM fit", "scores", "intercept wa wb", _FIT)
def _(s, sf):
    m = S.ridge_fit(X.scores(s, sf), FEATS, "y")
    return m.select("fold", "n", "intercept", F.col("coef")[0].alias("wa"), F.col("coef")[1].alias("wb"))


_SYM = [("roled_s", "SELECT *, month(date) <= 8 AS tr FROM scores"), ("train_s", "SELECT * FROM roled_s WHERE tr"),
        ("fit", _closed("train_s", "symbol, fold")),
        ("pred_s", "SELECT r.symbol, r.fold, r.y, b0 + wa * r.pred_a + wb * r.pred_b AS pred FROM roled_s r JOIN fit f ON r.symbol = f.symbol AND r.fold = f.fold WHERE NOT tr"),
        ("rk", """SELECT *, rank() OVER (PARTITION BY symbol, fold ORDER BY y) + (count(*) OVER (PARTITION BY symbol, fold, y) - 1) / 2.0 AS ry,
            rank() OVER (PARTITION BY symbol, fold ORDER BY pred) + (count(*) OVER (PARTITION BY symbol, fold, pred) - 1) / 2.0 AS rp FROM pred_s"""),
        ("ics", f"SELECT symbol, fold, CASE WHEN count(*) >= 10 THEN {RHO} ELSE 0 END AS ic FROM rk GROUP BY 1, 2")]


@case("fit02_ridge_per_symbol", "SELECT symbol, avg(ic) AS ic, count(*) AS n_folds FROM ics GROUP BY 1", "scores", "ic", _SYM)
def _(s, sf):
    d = X.scores(s, sf).withColumn("role", F.when(F.month("date") <= 8, "train").otherwise("val"))
    return S.ridge_per_symbol(d, FEATS, "y")


@case("fit03_linear_score", "SELECT s.symbol, s.date, b0 + wa * pred_a + wb * pred_b AS pred FROM scores s JOIN fit USING (fold)", "scores", "pred", _FIT)
def _(s, sf):
    d = X.scores(s, sf)
    return S.linear_score(d, S.ridge_fit(d, FEATS, "y"), FEATS).select("symbol", "date", "pred")


def _indexed(s, sf):
    return P.date_index(X.scores(s, sf).drop("fold"))


def folded(s, sf):
    return K.fold_expand(_indexed(s, sf), wf(s, sf), roles=["train", "val"])


WFS = [WF, ("sd", "SELECT s.* EXCLUDE (fold), row_number() OVER (PARTITION BY symbol ORDER BY date) AS k, d.i AS date_idx FROM scores s JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM scores)) d USING (date)"),
       ("ex", "SELECT sd.*, wf.fold, wf.role FROM sd JOIN wf ON date_idx >= lo AND date_idx < hi WHERE role IN ('train', 'val')"),
       ("trn", "SELECT * FROM ex WHERE role = 'train'"), ("fit", _closed("trn", "fold")),
       ("oos", """SELECT symbol, date, max_by(b0 + wa * pred_a + wb * pred_b, fold) AS pred, any_value(y) AS y, max(fold) AS fold
          FROM ex JOIN fit USING (fold) WHERE role = 'val' GROUP BY 1, 2""")]


@case("fit05_walk_forward_score", "SELECT * FROM oos", "days scores", "pred y", WFS)
def _(s, sf):
    return S.walk_forward_ridge(_indexed(s, sf), wf(s, sf), FEATS, "y").select("symbol", "date", "pred", "y", "fold")


@case("fit05_folded_rows", "SELECT * FROM oos", "days scores", "pred y", WFS)
def _(s, sf):
    return S.walk_forward_score(folded(s, sf), FEATS, "y")


@case("fit04_gbt_fit")
def _(s, sf):
    first = wf(s, sf).filter("fold = 0")
    return R.walk_forward_trees(_indexed(s, sf), first, FEATS, "y")[1].history(s)


def _tree_sql(t: int, bins: int = 32, rate: float = 0.3, least: int = 20) -> list[tuple[str, str]]:
    """Tables of tree t of every fold, two levels deep: b{t}1, b{t}2 (splits), p{t+1} (rows with new predictions), o{t} (nodes)."""
    def level(rows: str, name: str) -> list[tuple[str, str]]:
        return [
            (f"h{name}", f"""SELECT fold, node, feature, bin, sum(2 * (p - y)) AS g, sum(2.0) AS h, count(*) AS n FROM (SELECT fold, node, p, y,
                unnest([0, 1]) AS feature, unnest([b0, b1]) AS bin FROM {rows} WHERE role = 'train') GROUP BY ALL"""),
            (f"c{name}", f"""SELECT *, gl * gl / (hl + 1) + (gp - gl) * (gp - gl) / (hp - hl + 1) - gp * gp / (hp + 1) AS gain FROM (
                SELECT fold, node, feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER q AS gp, sum(h) OVER q AS hp, sum(n) OVER q AS np
                FROM h{name} WINDOW w AS (PARTITION BY fold, node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY fold, node, feature))"""),
            (f"b{name}", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, node ORDER BY gain DESC, feature, bin) AS k FROM c{name} WHERE hl > 0 AND hp - hl > 0 AND nl < np)
                WHERE k = 1 AND gain > 0 AND least(nl, np - nl) >= {least}"""),
        ]

    step = lambda name: f"CASE WHEN b.gain IS NULL THEN r.node WHEN CASE b.feature WHEN 0 THEN b0 ELSE b1 END <= b.bin THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END"
    move = lambda rows, name: f"SELECT r.* REPLACE ({step(name)} AS node) FROM {rows} r LEFT JOIN b{name} b ON b.fold = r.fold AND b.node = r.node"
    return [
        *level(f"p{t}", f"{t}1"), (f"r{t}1", move(f"p{t}", f"{t}1")), *level(f"r{t}1", f"{t}2"), (f"r{t}2", move(f"r{t}1", f"{t}2")),
        (f"l{t}", f"SELECT fold, node, -sum(2 * (p - y)) / (sum(2.0) + 1) AS leaf, count(*) AS n FROM r{t}2 WHERE role = 'train' GROUP BY ALL"),
        (f"p{t + 1}", f"SELECT r.* REPLACE (0 AS node, p + {rate} * leaf AS p) FROM r{t}2 r JOIN l{t} l ON l.fold = r.fold AND l.node = r.node"),
        (f"o{t}", f"""SELECT fold, {t} AS tree_id, node AS node_id, -1 AS feature_idx, CAST(0 AS DOUBLE) AS split_value, leaf AS leaf_value, n AS num_samples, CAST(0 AS DOUBLE) AS gain FROM l{t}
            UNION ALL SELECT b.fold, {t}, node, feature, xs[bin + 1], 0, CAST(np AS BIGINT), gain FROM (SELECT * FROM b{t}1 UNION ALL SELECT * FROM b{t}2 WHERE node > 0) b JOIN eg USING (fold, feature)"""),
    ]


_DEEP = [*WFS[:3], ("vx", """SELECT fold, feature, x, row_number() OVER (PARTITION BY fold, feature ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY fold, feature) AS u FROM (
            SELECT DISTINCT fold, feature, x FROM (SELECT fold, unnest([0, 1]) AS feature, unnest([pred_a, pred_b]) AS x FROM ex WHERE role = 'train'))"""),
         ("eg", """SELECT fold, feature, list(x ORDER BY x) AS xs FROM vx WHERE k IN (SELECT CAST(floor(s / 32.0 * (u - 1)) AS BIGINT) FROM (SELECT unnest(range(1, 32)) AS s)) GROUP BY ALL"""),
         ("p0", """SELECT symbol, date, ex.fold, role, y, 0 AS node, my AS p, len(list_filter(a.xs, lambda v: v < pred_a)) AS b0, len(list_filter(b.xs, lambda v: v < pred_b)) AS b1 FROM ex
            JOIN eg a ON a.fold = ex.fold AND a.feature = 0 JOIN eg b ON b.fold = ex.fold AND b.feature = 1
            JOIN (SELECT fold, avg(y) AS my FROM ex WHERE role = 'train' GROUP BY fold) m ON m.fold = ex.fold"""), *_tree_sql(0), *_tree_sql(1)]


def _two_trees(s, sf):
    """Two trees of two levels for every fold, with exact boundaries: as far as SQL goes. fit04 and fit06 run the full settings."""
    config, folds, rows = B.BoostConfig(num_trees=2, max_depth=2, learning_rate=0.3, max_bins=32), wf(s, sf), _indexed(s, sf)
    members = [R.Member(r["fold"], r["fold"], config) for r in folds.select("fold").distinct().collect()]
    return rows, folds, R.grow_forests(rows, folds, FEATS, "y", members, exact=True)


@case("fit05_trees_depth2", "SELECT * FROM o0 UNION ALL SELECT * FROM o1", "days scores", "split_value leaf_value gain", _DEEP)
def _(s, sf):
    forest = _two_trees(s, sf)[2].forest(s)
    return forest.select("fold", "tree_id", "node_id", "feature_idx", "split_value", "leaf_value", "num_samples", "gain")


@case("fit05_walk_forward_trees", """SELECT symbol, date, max_by(p, fold) AS pred, any_value(y) AS y, CAST(max(fold) AS INT) AS fold FROM p2 WHERE role = 'val' GROUP BY 1, 2""",
      "days scores", "pred y", _DEEP)
def _(s, sf):
    rows, folds, forests = _two_trees(s, sf)
    return R.score_forests(rows, forests, folds).select("symbol", "date", "pred", "y", "fold")


@case("fit06_hp_grid_by_sharpe")
def _(s, sf):
    table, _ = R.tune_by_sharpe(_indexed(s, sf), wf(s, sf).filter("fold = 0"), FEATS, "y")
    return table.drop("member")


@case("spl10_cv_runner", """SELECT fold, CASE WHEN count(*) >= 10 THEN avg(CASE WHEN sign(y) = sign(pred) THEN CAST(1 AS DOUBLE) ELSE 0 END) ELSE 0.5 END AS direction_accuracy
      FROM (SELECT r.fold, y, my - wa * ma - wb * mb + wa * pred_a + wb * pred_b AS pred FROM rs r JOIN fit USING (fold) WHERE NOT tr) GROUP BY 1""", "scores", "direction_accuracy",
      [("rs", "SELECT *, month(date) <= 8 AS tr FROM scores"), ("trn", "SELECT * FROM rs WHERE tr"), ("fit", _closed("trn", "fold"))])
def _(s, sf):
    d = X.scores(s, sf).withColumn("role", F.when(F.month("date") <= 8, "train").otherwise("test"))
    train = lambda t: S.ridge_fit(t, FEATS, "y", by=["fold"])
    _, metric = K.cv_runner(d, train, lambda m, t: S.linear_score(t, m, FEATS), lambda p: M.direction_accuracy(p, "y", "pred"))
    return metric


def _ridge_arrays(x, y):
    mx, my = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return w, my - mx @ w


@case("spl10_cv_arrays", """SELECT fold, CASE WHEN count(*) >= 10 THEN avg(CASE WHEN sign(y) = sign(pred) THEN CAST(1 AS DOUBLE) ELSE 0 END) ELSE 0.5 END AS direction_accuracy
      FROM (SELECT r.fold, y, my - wa * ma - wb * mb + wa * pred_a + wb * pred_b AS pred FROM rs r JOIN fit USING (fold) WHERE NOT tr) GROUP BY 1""", "scores", "direction_accuracy",
      [("rs", "SELECT *, month(date) <= 8 AS tr FROM scores"), ("trn", "SELECT * FROM rs WHERE tr"), ("fit", _closed("trn", "fold"))])
def _(s, sf):
    d = X.scores(s, sf).withColumn("role", F.when(F.month("date") <= 8, "train").otherwise("test"))
    accuracy = lambda y, p: float((np.sign(y) == np.sign(p)).mean()) if len(y) >= 10 else 0.5
    _, metric = K.cv_arrays(d, FEATS, "y", _ridge_arrays, lambda m, x: m[1] + x @ m[0], accuracy)
    return metric.withColumnRenamed("metric", "direction_accuracy")


@case("eval23_coef_stability", """SELECT feature, cv, mean_abs, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INT) AS size_rank, median(cv) OVER () AS median_cv,
      row_number() OVER (ORDER BY mean_abs DESC, feature) <= 10 AS in_top FROM (SELECT feature, stddev_pop(w) / (abs(avg(w)) + 1e-10) AS cv, avg(abs(w)) AS mean_abs FROM (
        SELECT unnest(['pred_a', 'pred_b']) AS feature, unnest([wa, wb]) AS w FROM fit) GROUP BY 1)""", "scores", "cv mean_abs median_cv", _FIT)
def _(s, sf):
    return I.coef_stability(S.coefficients(S.ridge_fit(X.scores(s, sf), FEATS, "y"), FEATS))


# ---- stored tables -------------------------------------------------------------------

@case("src07_feature_params_store", """SELECT unnest(['pred_a', 'pred_b']) AS feature, unnest([avg(pred_a), avg(pred_b)]) AS mean,
      unnest([stddev_pop(pred_a), stddev_pop(pred_b)]) AS std FROM scores""", "scores", "mean std")
def _(s, sf):
    from barloom.operators.cross import fit_pooled_params

    return store.unpack_feature_params(store.pack_feature_params(fit_pooled_params(X.scores(s, sf), FEATS)))


@case("src08_model_registry", """SELECT f.fold, f.n, f.b0 AS intercept, f.wa, f.wb, i.ic, s.first, s.last FROM fit f JOIN fic i USING (fold)
      JOIN (SELECT fold, min(date) AS first, max(date) AS last FROM scores GROUP BY 1) s USING (fold) WHERE fold = (SELECT max(fold) FROM fit)""",
      "scores", "intercept wa wb ic", [*_FIT, *FOLD_IC])
def _(s, sf):
    d = X.scores(s, sf)
    spans = d.groupBy("fold").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    reg = store.model_registry(S.ridge_fit(d, FEATS, "y"), M.spearman_ic(d, "y", "pred_a").select("fold", "ic"), spans)
    return store.production_model(reg).select("fold", "n", "intercept", F.col("coef")[0].alias("wa"), F.col("coef")[1].alias("wb"), "ic", "first", "last")


def part_forests(s, sf):
    """One three-node tree per part, as JSON under the short field names."""
    p = s.read.parquet(f"{sf}/part.parquet")
    text = F.format_string(
        '{"trees": [[{"nodeid": 0, "split": "f%d", "split_condition": %.2f, "yes": 1, "no": 2, "num_samples": %d, "gain": %.1f}, {"nodeid": 1, "leaf_value": 0.5}, {"nodeid": 2, "leaf_value": -0.25}]]}',
        F.col("p_size") % 5, F.col("p_retailprice"), F.col("p_size"), F.col("p_size") / 10)
    return p.select("p_partkey", text.alias("json"))


@case("src09_forest_table", """SELECT p_partkey, n AS node_id, CASE WHEN n = 0 THEN p_size % 5 ELSE -1 END AS feature_idx, CASE WHEN n = 0 THEN p_retailprice ELSE 0 END AS split_value,
      CASE WHEN n = 0 THEN 1 ELSE -1 END AS "left", CASE WHEN n = 0 THEN 2 ELSE -1 END AS "right", CASE n WHEN 0 THEN 0 WHEN 1 THEN 0.5 ELSE -0.25 END AS leaf_value,
      CASE WHEN n = 0 THEN p_size END AS num_samples, CASE WHEN n = 0 THEN p_size / 10 END AS gain, true AS default_left FROM part, (SELECT unnest([0, 1, 2]) AS n)""", "", "split_value leaf_value gain")
def _(s, sf):
    return store.forest_table(part_forests(s, sf), by=["p_partkey"]).drop("tree_id")


@case("fit15_forest_importance", """SELECT feature_idx, n / sum(n) OVER () AS frequency, g / sum(g) OVER () AS gain, c / sum(c) OVER () AS coverage FROM (
      SELECT p_size % 5 AS feature_idx, count(*) AS n, sum(p_size / 10) AS g, sum(p_size) AS c FROM part GROUP BY 1)""", "", "frequency gain coverage")
def _(s, sf):
    return B.forest_importance(store.forest_table(part_forests(s, sf), by=["p_partkey"]))


_IMP = [("imp", """SELECT b AS win, feature_idx, n / sum(n) OVER w AS frequency, g / sum(g) OVER w AS gain, c / sum(c) OVER w AS coverage FROM (
   SELECT p_partkey % 7 AS b, p_size % 5 AS feature_idx, count(*) AS n, sum(p_size / 10) AS g, sum(p_size) AS c FROM part GROUP BY 1, 2) WINDOW w AS (PARTITION BY b)""")]


def _imp(s, sf):
    f = store.forest_table(part_forests(s, sf), by=["p_partkey"]).withColumn("win", F.col("p_partkey") % 7)
    return B.forest_importance(f, by=["win"])


@case("fit16_importance_by_window", "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY win ORDER BY gain DESC, feature_idx) AS INT) AS place FROM imp) WHERE place <= 3",
      "", "frequency gain coverage", _IMP)
def _(s, sf):
    return B.importance_by_window(_imp(s, sf), 3, window="win")[0]


@case("fit16_importance_mean", """SELECT *, CAST(row_number() OVER (ORDER BY gain DESC, feature_idx) AS INT) AS place, row_number() OVER (ORDER BY gain DESC, feature_idx) <= 3 AS in_top FROM (
      SELECT feature_idx, avg(gain) AS gain, avg(frequency) AS frequency, avg(coverage) AS coverage FROM imp GROUP BY 1)""", "", "gain frequency coverage", _IMP)
def _(s, sf):
    return B.importance_by_window(_imp(s, sf), 3, window="win")[1]


# ---- losses, bins, splits ----------------------------------------------------------------

@case("fit07_grad_hess", """SELECT symbol, date, 2 * e AS g_mse, sign(e) AS g_mae, CASE WHEN abs(e) <= 1 THEN e ELSE sign(e) END AS g_huber, CASE WHEN abs(e) <= 1 THEN 1 ELSE 1e-8 END AS h_huber,
      CASE WHEN e > 0 THEN 0.3 ELSE -0.7 END AS g_quantile, 1 / (1 + exp(-p)) - u AS g_logloss, 1 / (1 + exp(-p)) * (1 - 1 / (1 + exp(-p))) AS h_logloss,
      greatest(p, 0) - p * u + ln(1 + exp(-abs(p))) AS l_logloss FROM (SELECT symbol, date, pred_a AS p, pred_a - y AS e, CASE WHEN y > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS u FROM scores)""",
      "scores", "g_mse g_mae g_huber h_huber g_quantile g_logloss h_logloss l_logloss")
def _(s, sf):
    d = X.scores(s, sf).withColumn("u", (F.col("y") > 0).cast("double"))
    for name, target, extra in (("mse", "y", {}), ("mae", "y", {}), ("huber", "y", {}), ("quantile", "y", {"alpha": 0.3}), ("logloss", "u", {})):
        d = B.grad_hess(d, target, "pred_a", name, f"{name}_", **extra)
    return d.select("symbol", "date", *[F.col(f"{n}_grad").alias(f"g_{n}") for n in B.LOSSES], F.col("huber_hess").alias("h_huber"),
                    F.col("logloss_hess").alias("h_logloss"), F.col("logloss_loss").alias("l_logloss"))


_BINS = [("vals", "SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY feature) AS u FROM (SELECT DISTINCT feature, x FROM (SELECT unnest(['pred_a', 'volume']) AS feature, unnest([pred_a, volume]) AS x FROM scores JOIN bars USING (symbol, date)))"),
         ("bounds", """SELECT feature, x AS bound FROM vals WHERE u >= 64 AND k IN (SELECT CAST(floor(s / 64.0 * (u - 1)) AS BIGINT) FROM (SELECT unnest(range(1, 64)) AS s))
            UNION ALL SELECT feature, (x + lead(x) OVER (PARTITION BY feature ORDER BY x)) / 2 FROM vals WHERE u < 64 QUALIFY lead(x) OVER (PARTITION BY feature ORDER BY x) IS NOT NULL"""),
         ("binned", """SELECT symbol, date, y, pred_b, (SELECT count(*) FROM bounds WHERE feature = 'pred_a' AND bound < pred_a) AS b0, (SELECT count(*) FROM bounds WHERE feature = 'volume' AND bound < volume) AS b1
            FROM scores JOIN bars USING (symbol, date)""")]


def _two(s, sf):
    return X.scores(s, sf).join(X.bars(s, sf).select("symbol", "date", "volume"), ["symbol", "date"])


def _binned(s, sf):
    d = _two(s, sf)
    return B.bin_features(d, sketch_boundaries(d, ["pred_a", "volume"], 64), ["pred_a", "volume"])


@case("fit08_bin_boundaries", "SELECT feature, bound FROM bounds", "scores", "bound", _BINS)
def _(s, sf):
    return B.bin_boundaries(_two(s, sf), ["pred_a", "volume"], 64).select("feature", F.explode("bounds").alias("bound"))


@case("fit08_sketch_boundaries", "SELECT feature, bound FROM bounds", "scores", "bound", _BINS)
def _(s, sf):
    return sketch_boundaries(_two(s, sf), ["pred_a", "volume"], 64).select("feature", F.explode("bounds").alias("bound"))


@case("fit09_bin_features", "SELECT symbol, date, b0, b1 FROM binned", "scores", "", _BINS)
def _(s, sf):
    return _binned(s, sf).select("symbol", "date", F.col("bin_pred_a").alias("b0"), F.col("bin_volume").alias("b1"))


_HIST = [*_BINS, ("hist", """SELECT node, feature, bin, sum(2 * (pred_b - y)) AS g, sum(2.0) AS h, count(*) AS n FROM (
   SELECT year(date) % 2 AS node, unnest([0, 1]) AS feature, unnest([b0, b1]) AS bin, pred_b, y FROM binned) GROUP BY 1, 2, 3"""),
   ("cum", """SELECT node, feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER p AS gp, sum(h) OVER p AS hp, sum(n) OVER p AS np
      FROM hist WINDOW w AS (PARTITION BY node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY node, feature)""")]


def _hist(s, sf):
    d = B.grad_hess(_binned(s, sf), "y", "pred_b").withColumn("node", F.year("date") % 2)
    return B.grad_histogram(d, F.array("bin_pred_a", "bin_volume"))


@case("fit10_grad_histogram", "SELECT * FROM hist", "scores", "g h", _HIST)
def _(s, sf):
    return _hist(s, sf)


@case("fit11_best_split", """SELECT node, gain, feature, bin, CAST(nl AS BIGINT) AS nl, CAST(np AS BIGINT) AS np FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) AS k FROM (
      SELECT *, gl * gl / (hl + 1) + (gp - gl) * (gp - gl) / (hp - hl + 1) - gp * gp / (hp + 1) AS gain FROM cum WHERE hl > 0 AND hp - hl > 0 AND nl < np)) WHERE k = 1""", "scores", "gain", _HIST)
def _(s, sf):
    return B.best_split(_hist(s, sf))


@case("fit12_leaf_value", """SELECT node, g, h, -sign(g) * greatest(abs(g) - 2, 0) / (h + 1) AS leaf_value FROM (
      SELECT year(date) AS node, sum(2 * (pred_b - y)) AS g, sum(2.0) AS h FROM scores GROUP BY 1)""", "scores", "g h leaf_value")
def _(s, sf):
    return B.leaf_values(B.grad_hess(X.scores(s, sf), "y", "pred_b").withColumn("node", F.year("date")), 2.0)


CONFIG = B.BoostConfig(num_trees=3, max_depth=3, learning_rate=0.3, max_bins=32)


def boosted(s, sf):
    return B.boost_fit(X.scores(s, sf), FEATS, "y", "mse", CONFIG)


@case("fit13_boost_fit")
def _(s, sf):
    return boosted(s, sf).forest(s)


_NODES = [(0, 0, 0, 0.1, 1, 2, 0.0), (0, 1, -1, 0.0, -1, -1, 0.3), (0, 2, 1, 0.05, 3, 4, 0.0), (0, 3, -1, 0.0, -1, -1, -0.1), (0, 4, -1, 0.0, -1, -1, -0.2),
          (1, 0, 1, -0.1, 1, 2, 0.0), (1, 1, -1, 0.0, -1, -1, 0.25), (1, 2, -1, 0.0, -1, -1, -0.05)]
_TREES = """0.01 + 0.1 * CASE WHEN pred_a <= 0.1 THEN 0.3 WHEN pred_b <= 0.05 THEN -0.1 ELSE -0.2 END + 0.1 * CASE WHEN pred_b <= -0.1 THEN 0.25 ELSE -0.05 END"""


def small_forest(s):
    return s.createDataFrame([(*n, 10, 1.0, True, 0.1) for n in _NODES], B.FOREST_SCHEMA)


@case("fit14_forest_score", f"SELECT symbol, date, {_TREES} AS pred, {_TREES} AS batch FROM scores", "scores", "pred batch")
def _(s, sf):
    d = B.forest_score(X.scores(s, sf), small_forest(s), FEATS, 0.01)
    return B.forest_score(d, small_forest(s), FEATS, 0.01, out="batch", inline_nodes=0).select("symbol", "date", "pred", "batch")


@case("fit17_path_attribution", """SELECT symbol, date, unnest(['pred_a', 'pred_b']) AS feature, unnest([0.1 * a, 0.1 * (b + CASE WHEN pred_b <= -0.1 THEN 0.25 ELSE -0.05 END)]) AS attribution FROM (
      SELECT *, CASE WHEN pred_a <= 0.1 THEN 0.3 WHEN pred_b <= 0.05 THEN -0.05 ELSE -0.1 END AS a, CASE WHEN pred_a <= 0.1 THEN 0 WHEN pred_b <= 0.05 THEN -0.05 ELSE -0.1 END AS b FROM scores)""",
      "scores", "attribution")
def _(s, sf):
    return B.path_attribution(X.scores(s, sf), small_forest(s), FEATS, ["symbol", "date"], 0.1)


# ---- blends -----------------------------------------------------------------------------------

@case("fit18_blend_static", "SELECT symbol, date, (0.6 * pred_a + 0.2 * pred_b) / 0.8 AS blend FROM scores", "scores", "blend")
def _(s, sf):
    return S.blend_static(X.scores(s, sf), {"pred_a": 0.6, "pred_b": 0.2}).select("symbol", "date", "blend")


@case("fit19_blend_by_fold_ic", """SELECT s.symbol, s.date, (abs(a.ic) * pred_a + abs(b.ic) * pred_b) / (abs(a.ic) + abs(b.ic)) AS blend FROM scores s JOIN fic a USING (fold) JOIN ficb b USING (fold)""",
      "scores", "blend", [*FOLD_IC, ("rankedb", RANKS("fold", "pred_b")), ("ficb", f"SELECT fold, {RHO} AS ic FROM rankedb GROUP BY 1")])
def _(s, sf):
    return S.blend_by_fold_ic(X.scores(s, sf), "y", FEATS).select("symbol", "date", "blend")


@case("fit20_blend_rolling_ic", """SELECT symbol, date, CASE WHEN rn > 252 THEN a / (a + b + 1e-8) ELSE 0.5 END AS weight_a, CASE WHEN rn > 252 THEN b / (a + b + 1e-8) ELSE 0.5 END AS weight_b,
      CASE WHEN rn > 252 THEN a / (a + b + 1e-8) ELSE 0.5 END * pred_a + CASE WHEN rn > 252 THEN b / (a + b + 1e-8) ELSE 0.5 END * pred_b AS fused FROM (
        SELECT s.*, abs(coalesce(x.ic, 0)) AS a, abs(coalesce(z.ic, 0)) AS b FROM seq s LEFT JOIN roll_pred_a x USING (symbol, rn) LEFT JOIN roll_pred_b z USING (symbol, rn))""",
      "scores", "weight_a weight_b fused", [*rolling_sql("pred_a", -252, -1), *rolling_sql("pred_b", -252, -1)[1:]])
def _(s, sf):
    return S.blend_rolling_ic(X.scores(s, sf), "y", "pred_a", "pred_b").select("symbol", "date", "weight_a", "weight_b", "fused")


@case("fit21_time_decay_blend", """SELECT symbol, date, w AS weight_a, w * pred_a + (1 - w) * pred_b AS blend FROM (SELECT *, 1 / (1 + exp(-(2 * exp(-4 * t)))) AS w FROM (
      SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY date) - 1) / greatest(count(*) OVER (PARTITION BY symbol) - 1, 1) AS t FROM scores))""", "scores", "weight_a blend")
def _(s, sf):
    return S.time_decay_blend(X.scores(s, sf), "pred_a", "pred_b").select("symbol", "date", "weight_a", "blend")


@case("fit22_soft_rank", "SELECT symbol, date, kp AS soft_rank_pred_a FROM soft", "scores", "soft_rank_pred_a", SOFT)
def _(s, sf):
    return S.soft_rank(X.scores(s, sf), ["pred_a"]).select("symbol", "date", "soft_rank_pred_a")


_GRID = [("lim", "SELECT fold, count(*) AS n, min(pred_a) AS lo, max(pred_a) AS hi FROM scores GROUP BY 1"),
         ("curve", """SELECT l.fold, k, sum(1 / (1 + exp(-(lo + (hi - lo) * k / 511 - s.pred_a) / 0.1))) AS v FROM lim l JOIN (SELECT unnest(range(0, 512)) AS k) ON true JOIN scores s ON s.fold = l.fold GROUP BY 1, 2""")]


@case("fit22_soft_rank_grid", """SELECT t.symbol, t.date, a.v + least(greatest(p - (r - 1), 0), 1) * (b.v - a.v) AS soft_rank_pred_a FROM (
      SELECT symbol, date, fold, (pred_a - lo) / (hi - lo) * 511 AS p, CAST(greatest(least(ceil((pred_a - lo) / (hi - lo) * 511), 511), 1) AS BIGINT) AS r FROM scores JOIN lim USING (fold)) t
      JOIN curve a ON a.fold = t.fold AND a.k = r - 1 JOIN curve b ON b.fold = t.fold AND b.k = r""", "scores", "soft_rank_pred_a", _GRID)
def _(s, sf):
    return S.soft_rank(X.scores(s, sf), ["pred_a"], method="grid", by=["fold"]).select("symbol", "date", "soft_rank_pred_a")


@case("fit23_rankic_value", "SELECT date, rankic_loss FROM rankic", "scores", "rankic_loss", SOFT)
def _(s, sf):
    return S.rankic_value(X.scores(s, sf), "y", "pred_a")


@case("study_walk_forward_ridge")
def _(s, sf):
    from barloom.plans.research import momentum_features, walk_forward_study

    return walk_forward_study(*momentum_features(X.bars(s, sf)))
