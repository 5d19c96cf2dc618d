"""Queries of labels, sample weights, splits and folds."""

from pyspark.sql import functions as F

from barloom.functions.grouping import longest_group, positions
from barloom.operators import labels as L
from barloom.operators import panel as P
from barloom.operators import rolling as G
from barloom.operators import splits as S
from barloom.registry import case
from barloom.registry import tables as X
from barloom.registry.ingest import _ROLES, _roled

W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"

_EV = [
    ("vol", """SELECT symbol, date, close, rn, greatest(stddev_samp(close / prev - 1) OVER w, 1e-8) * 0.5 AS vol, sign(close - prev) AS side
       FROM px WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING)"""),
    ("hits", """SELECT a.symbol, a.rn, min(b.rn - a.rn) FILTER (b.close / a.close - 1 >= 2 * a.vol) AS up,
       min(b.rn - a.rn) FILTER (b.close / a.close - 1 <= -a.vol) AS dn, max(b.rn - a.rn) AS last
       FROM vol a JOIN vol b ON a.symbol = b.symbol AND b.rn - a.rn BETWEEN 1 AND 20 WHERE a.vol > 0 GROUP BY 1, 2"""),
    ("events_", """SELECT a.symbol, a.date AS t0, b.date AS t1, CASE WHEN h.up IS NULL AND h.dn IS NULL OR h.up = h.dn THEN 0
         WHEN h.dn IS NULL OR h.up < h.dn THEN 1 ELSE -1 END AS label, b.close / a.close - 1 AS ret,
         CASE WHEN h.up IS NULL AND h.dn IS NULL OR h.up = h.dn THEN 'vertical' WHEN h.dn IS NULL OR h.up < h.dn THEN 'upper' ELSE 'lower' END AS type,
         CAST(a.rn - 1 AS INT) AS t0_pos, CAST(b.rn - 1 AS INT) AS t1_pos
       FROM hits h JOIN vol a ON a.symbol = h.symbol AND a.rn = h.rn
       JOIN vol b ON b.symbol = h.symbol AND b.rn = h.rn + coalesce(least(h.up, h.dn), h.last)"""),
]


def _vol(s, sf):
    from barloom.functions.grouping import along_time
    from barloom.operators.returns import change_of

    return along_time(
        X.px(s, sf),
        {"_r": lambda t: change_of("close", t, 1), "side": lambda t: F.signum(F.col("close") - F.lag("close").over(t.w))},
        {"vol": lambda t: F.greatest(F.stddev_samp("_r").over(t.last(21)), F.lit(1e-8)) * 0.5,
         "_n": lambda t: F.count("_r").over(t.last(21))},
        back=21).withColumn("vol", F.when(F.col("_n") >= 2, F.col("vol"))).drop("_r", "_n")


_EV[0] = ("vol", _EV[0][1].replace("greatest(", "CASE WHEN count(close / prev - 1) OVER w >= 2 THEN greatest(").replace("* 0.5 AS vol", "* 0.5 END AS vol"))


@case("lab01_triple_barrier_events", "SELECT * FROM events_", "px", "ret", _EV)
def _(s, sf):
    return L.triple_barrier_events(_vol(s, sf))


@case("lab02_meta_labels", """SELECT a.symbol, a.date AS t0, b.date AS t1, CASE WHEN h.hit IS NULL THEN 0 ELSE 1 END AS label, b.close / a.close - 1 AS ret
      FROM (SELECT a.symbol, a.rn, min(b.rn - a.rn) FILTER (CASE WHEN a.side > 0 THEN b.close / a.close - 1 >= 2 * a.vol
              ELSE b.close / a.close - 1 <= -a.vol END) AS hit, max(b.rn - a.rn) AS last
            FROM vol a JOIN vol b ON a.symbol = b.symbol AND b.rn - a.rn BETWEEN 1 AND 20 WHERE a.vol > 0 AND a.side <> 0 GROUP BY 1, 2) h
      JOIN vol a ON a.symbol = h.symbol AND a.rn = h.rn JOIN vol b ON b.symbol = h.symbol AND b.rn = h.rn + coalesce(h.hit, h.last)""",
      "px", "ret", _EV[:1])
def _(s, sf):
    return L.meta_labels(_vol(s, sf), "side").select("symbol", "t0", "t1", "label", "ret")


@case("lab03_bins_to_bars", """SELECT b.symbol, b.date, CAST(e.label AS DOUBLE) AS bin FROM bars b
      LEFT JOIN events_ e ON e.symbol = b.symbol AND e.t0 = b.date""", "px", "bin", _EV)
def _(s, sf):
    d = _vol(s, sf)
    return L.bins_to_bars(d.select("symbol", "date"), L.triple_barrier_events(d))


@case("lab04_concurrency", """SELECT p.symbol, p.date, count(e.symbol) AS active FROM px p LEFT JOIN events_ e
      ON e.symbol = p.symbol AND p.rn - 1 BETWEEN e.t0_pos AND e.t1_pos GROUP BY 1, 2""", "px", "", _EV)
def _(s, sf):
    d = positions(_vol(s, sf), ("symbol",), "date")
    return L.concurrency(d, L.triple_barrier_events(d.drop("pos"))).select("symbol", "date", "active")


_UNIQ = [*_EV, ("active", """SELECT p.symbol, p.rn - 1 AS pos, count(e.symbol) AS n FROM px p JOIN events_ e
      ON e.symbol = p.symbol AND p.rn - 1 BETWEEN e.t0_pos AND e.t1_pos GROUP BY 1, 2"""),
         ("uniq", """SELECT e.symbol, e.t0, any_value(e.ret) AS ret, any_value(e.t0_pos) AS t0_pos, any_value(e.t1_pos) AS t1_pos, avg(1.0 / a.n) AS uniqueness
      FROM events_ e JOIN active a ON a.symbol = e.symbol AND a.pos BETWEEN e.t0_pos AND e.t1_pos GROUP BY 1, 2""")]


@case("lab05_avg_uniqueness", "SELECT symbol, t0, uniqueness FROM uniq", "px", "uniqueness", _UNIQ)
def _(s, sf):
    d = _vol(s, sf)
    return L.avg_uniqueness(L.triple_barrier_events(d), longest=longest_group(d, ["symbol"])).select("symbol", "t0", "uniqueness")


@case("lab06_sample_weights", """SELECT symbol, t0, uniqueness * abs(ret) * exp(-0.01 * greatest(max(t1_pos) OVER (PARTITION BY symbol) - t0_pos, 0)) AS weight
      FROM uniq""", "px", "weight", _UNIQ)
def _(s, sf):
    d = _vol(s, sf)
    return L.sample_weights(L.triple_barrier_events(d), decay=0.01, longest=longest_group(d, ["symbol"])).select("symbol", "t0", "weight")


# ---- splits ------------------------------------------------------------------------

@case("spl01_chronological_split", """SELECT symbol, date, CASE WHEN rn - 1 < floor(n * 0.7) THEN 'train' WHEN rn - 1 < floor(n * 0.85) THEN 'val' ELSE 'test' END AS role
      FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM px)""", "px")
def _(s, sf):
    return S.chronological_split(X.px(s, sf)).select("symbol", "date", "role")


@case("spl02_time_split", """SELECT symbol, date, CASE WHEN date_idx < floor((SELECT count(*) FROM days) * 0.8) THEN 'train' ELSE 'test' END AS role
      FROM bars JOIN days USING (date)""", "bars days")
def _(s, sf):
    return S.time_or_random_split(X.px(s, sf)).select("symbol", "date", "role")


@case("spl02_random_split", """SELECT symbol, date, CASE WHEN row_number() OVER (ORDER BY md5(symbol || '|' || date || '|7')) <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS role
      FROM bars, (SELECT count(*) AS n FROM bars)""", "bars")
def _(s, sf):
    return S.time_or_random_split(X.px(s, sf), by_time=False, seed=7).select("symbol", "date", "role")


def _days(s, sf):
    return X.bars(s, sf).select("date").distinct()


WF = ("wf", """SELECT CAST(i AS INT) AS fold, unnest(['train', 'purge', 'val']) AS role, unnest([i * 126, i * 126 + 1008, i * 126 + 1134]) AS lo,
      unnest([i * 126 + 1008, i * 126 + 1134, i * 126 + 1386]) AS hi FROM (SELECT unnest(range(0, (SELECT count(*) FROM days) // 126)) AS i)
      WHERE i * 126 + 1386 <= (SELECT count(*) FROM days)""")


def wf(s, sf):
    return S.walk_forward_windows(_days(s, sf), 1008, 252, 126, 126)


@case("spl03_walk_forward_windows", "SELECT * FROM wf", "days", "", [WF])
def _(s, sf):
    return wf(s, sf)


@case("spl04_train_val_test_folds", """SELECT CAST(i AS INT) AS fold, unnest(['train', 'val', 'test']) AS role, unnest([i * 126, i * 126 + 882, i * 126 + 1008]) AS lo,
      unnest([i * 126 + 756, i * 126 + 1008, i * 126 + 1134]) AS hi FROM (SELECT unnest(range(0, 40)) AS i)
      WHERE i * 126 + 1134 <= (SELECT count(*) FROM days)""", "days")
def _(s, sf):
    return S.train_val_test_folds(_days(s, sf), 756, 126, 126, 126)


def _sizes_sql(sliding: bool) -> str:
    lo = "greatest(pos - f, 0)" if sliding else "0"
    return f"""SELECT CAST(i AS INT) AS fold, unnest(['train', 'test']) AS role, unnest([CAST({lo} AS BIGINT), CAST(pos + 5 AS BIGINT)]) AS lo, unnest([CAST(pos AS BIGINT), CAST(pos + 5 + size AS BIGINT)]) AS hi FROM (
      SELECT *, f + 5 * i + coalesce(sum(size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM (
        SELECT i, f, (n - f - 35) // 7 + CASE WHEN 6 - i < (n - f - 35) % 7 THEN 1 ELSE 0 END AS size
        FROM (SELECT n, CAST(floor(n * 0.6) AS BIGINT) AS f FROM (SELECT count(*) AS n FROM days)), (SELECT unnest(range(0, 7)) AS i)))"""


@case("spl05_expanding_folds", _sizes_sql(False), "days")
def _(s, sf):
    return S.expanding_or_sliding_folds(_days(s, sf), 7, 0.6, 5)


@case("spl05_sliding_folds", _sizes_sql(True), "days")
def _(s, sf):
    return S.expanding_or_sliding_folds(_days(s, sf), 7, 0.6, 5, sliding=True)


_IV = ("iv", """SELECT symbol, date, date_idx AS idx, date_idx AS t0, date_idx + 1 + (CAST(symbol AS INT) % 20) AS t1 FROM bars JOIN days USING (date)""")


def _iv(s, sf):
    d = P.date_index(X.bars(s, sf).select("symbol", "date"))
    return d.select("symbol", "date", F.col("date_idx").alias("idx"), F.col("date_idx").alias("t0"),
                    (F.col("date_idx") + 1 + F.col("symbol").cast("int") % 20).alias("t1"))


@case("spl06_purged_split", """SELECT * FROM (SELECT symbol, date, idx, CASE WHEN idx >= 1500 AND idx < 1800 THEN 'test' WHEN idx < 1500 AND t1 <
      (SELECT min(t0) FROM iv WHERE idx >= 1500 AND idx < 1800) - (SELECT CAST(floor(0.01 * (max(t1) - min(t1))) AS BIGINT) FROM iv) THEN 'train' END AS role FROM iv)
      WHERE role IS NOT NULL""", "bars days", "", [_IV])
def _(s, sf):
    return S.purged_split(_iv(s, sf), 1500, 1800, t0="t0").select("symbol", "date", "idx", "role")


_KF = """SELECT * FROM (SELECT d.idx, d.t1, k.fold, CASE WHEN d.fold = k.fold THEN 'test' WHEN d.idx < k.lo AND d.t1 < k.b - e THEN 'train'
      WHEN d.idx >= k.hi AND d.t0 > k.en + e THEN 'train' END AS role FROM kf d,
      (SELECT fold, min(idx) AS lo, max(idx) + 1 AS hi, min(t0) AS b, max(t1) AS en FROM kf GROUP BY 1) k,
      (SELECT CAST(floor(0.01 * (max(t1) - min(t1))) AS BIGINT) AS e FROM kf)) WHERE role IS NOT NULL"""


@case("spl07_purged_kfold", _KF, "days", "", [("kf", """SELECT date_idx AS idx, date_idx AS t0, date_idx + 1 + date_idx % 20 AS t1,
      CAST(ntile(5) OVER (ORDER BY date_idx) - 1 AS INT) AS fold FROM days""")])
def _(s, sf):
    d = positions(_days(s, sf), (), "date", "idx").withColumns({"t0": F.col("idx"), "t1": F.col("idx") + 1 + F.col("idx") % 20})
    return S.purged_kfold(d, 5, "t1", "t0").select("idx", "t1", "fold", "role")


@case("spl08_fold_expand", """SELECT b.symbol, b.date, wf.fold, wf.role FROM bars b JOIN days USING (date) JOIN wf ON date_idx >= lo AND date_idx < hi
      WHERE role IN ('train', 'val')""", "bars days", "", [WF])
def _(s, sf):
    d = P.date_index(X.bars(s, sf).select("symbol", "date"))
    return S.fold_expand(d, wf(s, sf), roles=["train", "val"]).select("symbol", "date", "fold", "role")


@case("spl09_fold_normalize", """SELECT symbol, date, fold, (m - avg(m) FILTER (role = 'train') OVER f) / CASE WHEN coalesce(stddev_pop(m) FILTER (role = 'train') OVER f, 0) < 1e-8
      THEN 1 ELSE stddev_pop(m) FILTER (role = 'train') OVER f END AS z_m FROM roled WINDOW f AS (PARTITION BY fold)""", "bars", "z_m", [_ROLES])
def _(s, sf):
    return S.fold_normalize(_roled(s, sf), ["m"], prefix="z_").select("symbol", "date", "fold", "z_m")


@case("spl09_fold_normalize_latest", """SELECT r.symbol, r.date, r.fold, (m - a) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END AS z_m FROM roled r JOIN (
      SELECT fold, avg(m) AS a, stddev_pop(m) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY date DESC, symbol DESC) AS k
      FROM roled WHERE role = 'train') WHERE k <= 252 GROUP BY 1) t USING (fold)""", "bars", "z_m", [_ROLES])
def _(s, sf):
    return S.fold_normalize(_roled(s, sf), ["m"], "latest", prefix="z_").select("symbol", "date", "fold", "z_m")
