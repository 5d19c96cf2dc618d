"""Splits and walk-forward folds.

A fold table has one row per (fold, role) with end-exclusive bounds ``lo``/``hi`` on an
integer axis.  It holds tens of rows, so it reaches the data as one array of structs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import lit
from barloom.functions.grouping import attach, group_stats, ordered, positions

KEY, TIME = ("symbol",), "date"


def chronological_split(
    df: DataFrame, train_ratio: float = 0.7, val_ratio: float = 0.15, *, by=KEY, time=TIME, out: str = "role",
) -> DataFrame:
    """train / val / test by position in time; bounds are truncated to whole rows."""
    placed = group_stats(positions(df, by, time, "_p"), by, _n=F.count(F.lit(1)))
    cut = lambda r: F.floor(F.col("_n") * lit(r))
    role = F.when(F.col("_p") < cut(train_ratio), "train").when(
        F.col("_p") < cut(train_ratio + val_ratio), "val").otherwise("test")
    return placed.withColumn(out, role).drop("_p", "_n")


def time_or_random_split(
    df: DataFrame, test_size: float = 0.2, by_time: bool = True, seed: int = 0, *, time=TIME,
    key: Sequence[str] = ("symbol", "date"), out: str = "role",
) -> DataFrame:
    """Split on the date axis, or a seeded shuffle ordered by a hash of the key."""
    if by_time:
        days = positions(df.select(time).distinct(), (), time, "_p")
        days = group_stats(days, [], _n=F.count(F.lit(1)))
        placed = attach(df, days, [time])
        inside = F.col("_p") < F.floor(F.col("_n") * lit(1.0 - test_size))
        return placed.withColumn(out, F.when(inside, "train").otherwise("test")).drop("_p", "_n")
    tag = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    placed = ordered(df.withColumn("_h", tag), (), ["_h"], out="_p", total="_n")
    inside = F.col("_p") <= F.floor(F.col("_n") * lit(1.0 - test_size))
    return placed.withColumn(out, F.when(inside, "train").otherwise("test")).drop("_h", "_p", "_n")


def _spans(base: DataFrame, spans: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    rows = [F.struct(F.lit(r).alias("role"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")) for r, lo, hi in spans]
    return base.select("fold", F.inline(F.array(*rows)))


def _count_of(days: DataFrame) -> DataFrame:
    return days.agg(F.count(F.lit(1)).alias("n"))


def _fold_ids(size: DataFrame, folds: Column) -> DataFrame:
    some = size.withColumn("_k", folds.cast("int")).filter(F.col("_k") > 0)
    return some.select("n", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("fold"))


def walk_forward_windows(days: DataFrame, train: int, val: int, purge: int, step: int) -> DataFrame:
    """(train, purge, val) windows stepping while they fit the number of rows of ``days``."""
    total = train + purge + val
    base = _fold_ids(_count_of(days), F.floor((F.col("n") - total) / step) + 1)
    lo = F.col("fold") * step
    return _spans(base, [("train", lo, lo + train), ("purge", lo + train, lo + train + purge), ("val", lo + train + purge, lo + total)])


def train_val_test_folds(
    days: DataFrame, train: int, purge: int, val: int, step: int, min_test: int = 10,
) -> DataFrame:
    """Train, purged gap, validation and a test span of ``step`` rows."""
    total = train + purge + val + step
    base = _fold_ids(_count_of(days), F.floor((F.col("n") - total) / step) + 1)
    lo = F.col("fold") * step
    vs = lo + train + purge
    te = F.least(vs + val + step, F.col("n"))
    keep = base.filter(te - (vs + val) >= min_test)
    return _spans(keep, [("train", lo, lo + train), ("val", vs, vs + val), ("test", vs + val, te)])


def expanding_or_sliding_folds(
    days: DataFrame, n_folds: int, train_size: float = 0.6, gap: int = 0, sliding: bool = False,
) -> DataFrame:
    """``n_folds`` test spans after the first training span; later folds take the remainder rows."""
    if n_folds < 1 or not 0 < train_size < 1 or gap < 0:
        raise ValueError("need n_folds >= 1, 0 < train_size < 1, gap >= 0")
    first = F.floor(F.col("n") * lit(train_size))
    room = F.col("n") - first - gap * n_folds
    base, extra = F.floor(room / n_folds), room % n_folds
    i = F.col("fold")
    start = first + i * (gap + base) + F.greatest(i - (n_folds - extra), F.lit(0))
    end = start + gap + base + F.when(n_folds - 1 - i < extra, 1).otherwise(0)
    lo = F.greatest(start - first, F.lit(0)) if sliding else F.lit(0)
    ids = _fold_ids(_count_of(days).filter((first >= 1) & (room >= n_folds)), F.lit(n_folds))
    return _spans(ids, [("train", lo, start), ("test", start + gap, F.least(end, F.col("n")))])


def as_array(folds: DataFrame) -> Column:
    """A fold table as one array value (tens of structs)."""
    return folds.agg(F.collect_list(F.struct(*folds.columns))).scalar()


def fold_expand(df: DataFrame, folds: DataFrame, idx: str = "date_idx", roles: Sequence[str] | None = None) -> DataFrame:
    """One copy of a row per fold span that contains it: columns fold and role are added."""
    if roles:
        folds = folds.filter(F.col("role").isin(*roles))
    hits = F.filter("_folds", lambda f: (f["lo"] <= F.col(idx)) & (F.col(idx) < f["hi"]))
    out = df.withColumn("_folds", as_array(folds.select("fold", "role", "lo", "hi"))).withColumn("_f", F.explode(hits))
    return out.withColumns({"fold": F.col("_f.fold"), "role": F.col("_f.role")}).drop("_folds", "_f")


def _embargo(df: DataFrame, t1: str, embargo_pct: float) -> Column:
    if embargo_pct <= 0:
        return F.lit(0)
    span = F.max(t1) - F.min(t1)
    span = F.when(span <= 0, F.greatest(F.count(F.lit(1)), F.lit(1))).otherwise(span)
    return df.agg(F.floor(span * lit(embargo_pct))).scalar()


def purged_split(
    df: DataFrame, test_start: int, test_end: int, t1: str = "t1", t0: str | None = None, idx: str = "idx",
    embargo_pct: float = 0.01,
) -> DataFrame:
    """Test rows [test_start, test_end) and the earlier rows whose label ends before the
    test start less the embargo."""
    if not 0 <= test_start < test_end:
        raise ValueError("need 0 <= test_start < test_end")
    test = (F.col(idx) >= test_start) & (F.col(idx) < test_end)
    begin = df.filter(test).agg(F.min(t0)).scalar() if t0 else F.lit(test_start)
    bounded = df.withColumn("_cut", begin - _embargo(df, t1, embargo_pct))
    role = F.when(test, "test").when((F.col(idx) < test_start) & (F.col(t1) < F.col("_cut")), "train")
    return bounded.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_cut")


def purged_kfold(
    df: DataFrame, n_splits: int = 5, t1: str | None = "t1", t0: str | None = None, idx: str = "idx",
    embargo_pct: float = 0.01,
) -> DataFrame:
    """k contiguous test folds; training rows overlapping the test span or inside the
    embargo on either side are left out.  Without ``t1``, plain k-fold."""
    if n_splits < 2 or embargo_pct < 0:
        raise ValueError("need n_splits >= 2 and embargo_pct >= 0")
    sized = group_stats(df, [], _n=F.count(F.lit(1)))
    big, rest = F.floor(F.col("_n") / n_splits) + 1, F.col("_n") % n_splits
    own = F.when(F.col(idx) < big * rest, F.floor(F.col(idx) / big)).otherwise(
        rest + F.floor((F.col(idx) - big * rest) / F.greatest(big - 1, F.lit(1))))
    placed = sized.withColumn("_own", own.cast("int"))
    lo, hi = F.min(idx), F.max(idx) + 1
    spans = placed.groupBy(F.col("_own").alias("fold")).agg(
        lo.alias("lo"), hi.alias("hi"),
        (F.min(t0) if t0 else lo).alias("begin"), (F.max(t1) if t0 and t1 else hi).alias("end"))
    crossed = placed.withColumns({
        "_f": F.explode(as_array(spans)), "_emb": _embargo(df, t1, embargo_pct) if t1 else F.lit(0)})
    f, at = (lambda c: F.col(f"_f.{c}")), F.col(idx)
    if t1 is None:
        train = at.isNotNull()
    else:
        after = F.col(t0) > f("end") + F.col("_emb") if t0 else at >= f("hi") + F.col("_emb")
        train = ((at < f("lo")) & (F.col(t1) < f("begin") - F.col("_emb"))) | ((at >= f("hi")) & after)
    role = F.when((at >= f("lo")) & (at < f("hi")), "test").when(train, "train")
    out = crossed.withColumns({"fold": f("fold"), "role": role}).filter(F.col("role").isNotNull())
    return out.drop("_n", "_own", "_f", "_emb")


def fold_normalize(
    df: DataFrame, cols: Sequence[str], mode: str = "expanding", latest: int = 252, prefix: str = "",
    *, by: Sequence[str] = ("fold",), role: str = "role", order: Sequence[str] = ("date", "symbol"),
) -> DataFrame:
    """Scale with the mean and deviation of the fold's training rows (all, or the last ones)."""
    train = df.filter(F.col(role) == "train")
    if mode == "latest":
        w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
        train = train.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= latest)
    elif mode != "expanding":
        raise ValueError(f"unknown mode {mode!r}")
    aggs = {}
    for c in cols:
        sd = F.stddev_pop(c)
        aggs[f"_m_{c}"] = F.coalesce(F.avg(c), lit(0))
        aggs[f"_s_{c}"] = F.when(sd.isNull() | (sd < 1e-8), lit(1)).otherwise(sd)
    stats = train.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    out = attach(df, stats, by)
    return out.withColumns({f"{prefix}{c}": (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in cols}).drop(*aggs)


def cv_runner(
    folded: DataFrame, train_fn: Callable[[DataFrame], object], predict_fn: Callable[[object, DataFrame], DataFrame],
    metric_fn: Callable[[DataFrame], DataFrame] | None = None, *, role: str = "role", test_role: str = "test",
) -> tuple[DataFrame, DataFrame | None]:
    """Fit and predict every fold with user callables that take Spark DataFrames.

    Returns the stacked predictions and, with ``metric_fn`` (an aggregate by fold), its result.
    """
    ids = [r[0] for r in folded.select("fold").distinct().orderBy("fold").collect()]  # tens of folds
    parts = []
    for fold in ids:
        one = folded.filter(F.col("fold") == fold)
        model = train_fn(one.filter(F.col(role) == "train"))
        parts.append(predict_fn(model, one.filter(F.col(role) == test_role)))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked, metric_fn(stacked) if metric_fn else None


# Test rows that one call of a flat prediction takes at most, about.
PART_ROWS = 1_000_000


def _flat_arrays(
    folded: DataFrame, features: list[str], y: str, train_fn: Callable, predict_fn: Callable, metric_fn: Callable | None,
    role: str, test_role: str, parts: int, out: str,
) -> tuple[DataFrame, DataFrame | None]:
    """``cv_arrays`` on flat arrays: a fit moves its numbers only, a model meets the test rows of its fold in ``parts`` parts."""
    kept = [f for f in folded.schema.fields if f.name not in (out, "_metric")]
    key = folded.select("fold").schema.fields
    numbers = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate([*features, y])]
    test = folded.filter(F.col(role) == test_role)
    train = attach(folded.filter(F.col(role) == "train").select("fold", *numbers), test.select("fold").distinct(), ["fold"], "left_semi")

    def matrix(rows: pa.Table, names: Sequence[str]) -> np.ndarray:
        full = np.empty((rows.num_rows, len(names)))
        for i, c in enumerate(names):
            full[:, i] = rows.column(c).to_numpy()
        return full

    def fit(rows: pa.Table) -> pa.Table:
        full = matrix(rows, [f"_x{i}" for i in range(len(features) + 1)])
        full = full[~np.isnan(full).any(axis=1)]
        model = cloudpickle.dumps(train_fn(np.ascontiguousarray(full[:, :-1]), full[:, -1].copy()))
        return pa.table({"fold": rows.column("fold").slice(0, 1), "_model": pa.array([model], pa.binary())})

    models = train.groupBy("fold").applyInArrow(fit, T.StructType([*key, T.StructField("_model", T.BinaryType())]))
    models = models.select(F.col("fold").alias("_of"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_to"), "_model")
    part = F.pmod(F.xxhash64(*folded.columns), F.lit(parts)).cast("int")
    dealt = test.select(*[f.name for f in kept], *numbers[:-1], part.alias("_part"))

    def predict(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.select([f.name for f in kept])
        if not left.num_rows or not right.num_rows:
            return rows.slice(0, 0).append_column(out, pa.array([], pa.float64()))
        model = cloudpickle.loads(left.column("_model")[0].as_py())
        pred = np.asarray(predict_fn(model, matrix(right, [f"_x{i}" for i in range(len(features))])), float)
        return rows.append_column(out, pa.array(pred))

    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])
    scored = models.groupBy("_of", "_to").cogroup(dealt.groupBy("fold", "_part")).applyInArrow(predict, schema)
    if not metric_fn:
        return scored, None

    def measure(rows: pa.Table) -> pa.Table:
        value = float(metric_fn(rows.column("_y").to_numpy(), rows.column("_p").to_numpy()))
        return pa.table({"fold": rows.column("fold").slice(0, 1), "metric": pa.array([value], pa.float64())})

    pairs = scored.select("fold", F.col(y).cast("double").alias("_y"), F.col(out).alias("_p"))
    return scored, pairs.groupBy("fold").applyInArrow(measure, T.StructType([*key, T.StructField("metric", T.DoubleType())]))


def cv_arrays(
    folded: DataFrame, features: Sequence[str], y: str, train_fn: Callable[[np.ndarray, np.ndarray], object],
    predict_fn: Callable[[object, np.ndarray], np.ndarray], metric_fn: Callable[[np.ndarray, np.ndarray], float] | None = None, *,
    role: str = "role", test_role: str = "test", panel: tuple[str, str] | None = None, most_rows: int | None = None, out: str = "pred",
) -> tuple[DataFrame, DataFrame | None]:
    """Fit and predict all folds in one job with user callables on arrays: ``train_fn(x, y)``, ``predict_fn(model, x)``, ``metric_fn(y, pred)``.

    A fit takes the features and targets of its fold in one task, as arrays of doubles, and so does a metric with targets and
    predictions; ``most_rows`` refuses folds with longer sides before any fit (``cv_runner`` has no such arrays). Flat arrays are (rows,
    features) without null targets or features in training; a flat fold of more than PART_ROWS test rows is predicted in parts. With
    ``panel`` = (time, symbol), arrays are (times, symbols, features) and (times, symbols), NaN where a row is missing, and a fold's
    rows meet in one task by cogroup. Returns the test rows with ``out``, and (fold, metric).
    """
    longest = folded.groupBy("fold", role).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most_rows is not None and longest > most_rows:
        raise ValueError(f"a fold has {longest} rows, more than {most_rows}: use cv_runner")
    if not panel:
        return _flat_arrays(folded, list(features), y, train_fn, predict_fn, metric_fn, role, test_role, max(1, -(-longest // PART_ROWS)), out)
    features, every = list(features), folded.columns
    own = [*panel, *features, y]
    names = dict.fromkeys(["fold", *own])
    # Columns of the two sides get names of their own: both come from one table.
    train = folded.filter(F.col(role) == "train").select(*[F.col(c).alias(f"_train_{i}") for i, c in enumerate(names)])
    test = folded.filter(F.col(role) == test_role)
    test = test.select(*[F.col(c).alias(f"_test_{i}") for i, c in enumerate(test.columns)])

    def arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, tuple]:
        x, target = rows[features].to_numpy(float), rows[y].to_numpy(float)
        t, times = pd.factorize(rows[panel[0]], sort=True)
        s, symbols = pd.factorize(rows[panel[1]], sort=True)
        cube, plane = np.full((len(times), len(symbols), len(features)), np.nan), np.full((len(times), len(symbols)), np.nan)
        cube[t, s], plane[t, s] = x, target
        return cube, plane, (t, s)

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=schema.names)
        left.columns, right.columns = list(names), every
        model = train_fn(*arrays(left)[:2])
        x, target, at = arrays(right)
        pred = np.asarray(predict_fn(model, x), float)
        right[out], right["_metric"] = pred[at], float(metric_fn(target, pred)) if metric_fn else np.nan
        return right[schema.names]

    kept = [f for f in folded.schema.fields if f.name not in (out, "_metric")]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType()), T.StructField("_metric", T.DoubleType())])
    by_fold = test.groupBy(f"_test_{folded.columns.index('fold')}")
    scored = train.groupBy("_train_0").cogroup(by_fold).applyInPandas(fold, schema)
    metric = scored.groupBy("fold").agg(F.first("_metric").alias("metric")) if metric_fn else None
    return scored.drop("_metric"), metric
