"""Linear fits from sufficient statistics, scoring, blends and soft ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import lit
from barloom.functions.grouping import attach, group_stats, positions
from barloom.operators.metrics import daily_ic_series, rolling_ic, spearman_ic

FOLD, TIME = ("fold",), "date"


# ---- ridge ----------------------------------------------------------------------------

def _joined(a: tuple[float, np.ndarray, np.ndarray], b: tuple[float, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, centred cross products) of two sets of rows together; no large means are ever subtracted from sums."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _moment_schema(keys: T.StructType) -> T.StructType:
    array = T.ArrayType(T.DoubleType())
    return T.StructType([*keys.fields, T.StructField("n", T.DoubleType()), T.StructField("mean", array), T.StructField("cross", array)])


def moments(df: DataFrame, cols: Sequence[str], *, by: Sequence[str] = FOLD, flush: int = 4096) -> DataFrame:
    """Per key: the number of rows without nulls in ``cols``, their means, and their centred cross products as one flat array.

    One pass: tasks centre their own batches and merge them, so the shuffle carries one small matrix per task and key.
    """
    keys = df.select(*by).schema
    used = df.select(*by, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    names = [f"_c{i}" for i in range(len(cols))]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(list(held), columns=list(by)) if by else pd.DataFrame(index=range(len(held)))
            frame["n"] = [m[0] for m in held.values()]
            frame["mean"], frame["cross"] = [m[1] for m in held.values()], [m[2].ravel() for m in held.values()]
            held.clear()
            return frame

        for pdf in batches:
            for key, part in pdf.groupby(list(by), sort=False, dropna=False) if by else [((), pdf)]:
                x = part[names].to_numpy(float)
                if len(x):
                    mean = x.mean(axis=0)
                    one = float(len(x)), mean, (x - mean).T @ (x - mean)
                    held[key] = _joined(held[key], one) if key in held else one
            if len(held) > flush:
                yield out()
        if held:
            yield out()

    return joined_moments(used.dropna(subset=names).mapInPandas(partial, _moment_schema(keys)), by)


def joined_moments(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row of moments per key: parts stream by, sorted by key, and one key is held at a time."""
    schema = _moment_schema(parts.select(*by).schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        done: list[tuple] = []
        types: Sequence[pa.DataType] = []
        for batch in batches:
            types = batch.schema.types
            columns = [c.to_pylist() for c in batch.columns[:len(by)]]
            n, mean, cross = (batch.column(i) for i in range(len(by), len(by) + 3))
            for i, count in enumerate(n.to_pylist()):
                now = tuple(c[i] for c in columns)
                m = mean[i].values.to_numpy()
                one = count, m, cross[i].values.to_numpy().reshape(len(m), -1)
                if held is not None and now == key:
                    held = _joined(held, one)
                    continue
                if held is not None:
                    done.append((*key, held[0], held[1], held[2].ravel()))
                key, held = now, one
                if len(done) >= 1000:
                    yield _moment_batch(done, types, schema.names)
                    done = []
        if held is not None:
            yield _moment_batch([*done, (*key, held[0], held[1], held[2].ravel())], types, schema.names)

    placed = parts.repartition(*by).sortWithinPartitions(*by) if by else parts.repartition(1)
    return placed.mapInArrow(join, schema)


def _moment_batch(rows: list[tuple], types: Sequence[pa.DataType], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def ridge_of(moment_rows: DataFrame, alpha: float = 1.0, *, by: Sequence[str] = FOLD) -> DataFrame:
    """n, intercept and coef per key from moments of (features..., target)."""

    @F.pandas_udf("intercept double, coef array<double>")
    def solve(mean: pd.Series, cross: pd.Series) -> pd.DataFrame:
        rows = []
        for m, c in zip(mean, cross, strict=True):
            k = len(m) - 1
            c = np.asarray(c).reshape(k + 1, k + 1)
            w = np.linalg.lstsq(c[:k, :k] + alpha * np.eye(k), c[:k, k], rcond=None)[0]
            rows.append((m[k] - np.asarray(m[:k]) @ w, w))
        return pd.DataFrame(rows, columns=["intercept", "coef"])

    solved = moment_rows.withColumn("_s", solve("mean", "cross"))
    return solved.select(*by, F.col("n").cast("long").alias("n"), "_s.intercept", "_s.coef")


def ridge_fit(df: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0, *, by: Sequence[str] = FOLD) -> DataFrame:
    """Ridge with an unpenalised intercept for every key at once: n, intercept, coef. One pass over the rows.

    Columns are summed around their means, so that features with large means (prices, volumes) keep their digits.
    """
    return ridge_of(moments(df, [*features, y], by=by), alpha, by=by)


def fold_ridge(
    df: DataFrame, folds: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0, *, idx: str = "date_idx", train_role: str = "train",
) -> DataFrame:
    """Ridge of every fold of a span table (fold, role, lo, hi) without a copy of any row: fold, n, intercept, coef.

    The bounds of all training spans cut the axis into blocks; each block has one table of moments, and a fold merges those of its
    blocks. Rows are read once, whatever the overlap of the folds.
    """
    spans = [(r["fold"], r["lo"], r["hi"]) for r in folds.filter(F.col("role") == train_role).collect()]  # tens of rows
    cuts = sorted({c for _, lo, hi in spans for c in (lo, hi)})
    pairs = [(i, fold) for i, c in enumerate(cuts) for fold, lo, hi in spans if lo <= c < hi]
    used = sorted({i for i, _ in pairs})
    block = F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c <= F.col(idx))) - 1 if cuts else F.lit(-1)
    rows = df.withColumn("_block", block).filter(F.col("_block").isin(used))
    per_block = moments(rows, [*features, y], by=["_block"])
    members = df.sparkSession.createDataFrame(pairs, "_block int, fold int")
    return ridge_of(joined_moments(per_block.join(F.broadcast(members), "_block").select("fold", "n", "mean", "cross"), ["fold"]), alpha)


def walk_forward_ridge(
    df: DataFrame, folds: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0, *, idx: str = "date_idx", train_role: str = "train",
    test_role: str = "val", min_train: int = 200,
) -> DataFrame:
    """Rows inside a test span with ``pred`` and ``fold``: of overlapping spans the latest fold with ``min_train`` training rows.

    Two passes over ``df`` and no row copied or shuffled: moments per block of the axis, then scoring with all models as one value.
    Rows with a null feature have no prediction and are left out.
    """
    spans = [tuple(r) for r in folds.select("fold", "role", "lo", "hi").collect()]  # tens of rows, computed once
    folds = df.sparkSession.createDataFrame(spans, "fold int, role string, lo long, hi long")
    models = fold_ridge(df, folds, features, y, alpha, idx=idx, train_role=train_role).filter(F.col("n") >= min_train)
    tests = folds.filter(F.col("role") == test_role).select("fold", "lo", "hi")
    scorers = models.join(F.broadcast(tests), "fold").select("fold", "lo", "hi", "intercept", "coef")
    every = scorers.agg(F.collect_list(F.struct("fold", "lo", "hi", "intercept", "coef"))).scalar()  # tens of models
    hits = F.filter("_models", lambda m: (m["lo"] <= F.col(idx)) & (F.col(idx) < m["hi"]))
    scored = df.drop("fold").withColumn("_models", every).withColumn("_m", F.array_max(hits)).filter(F.col("_m").isNotNull())
    total = F.col("_m.intercept")
    for i, f in enumerate(features):
        total = total + F.col("_m.coef")[i] * F.col(f)
    return scored.withColumns({"fold": F.col("_m.fold"), "pred": total}).filter(F.col("pred").isNotNull()).drop("_models", "_m")


def coefficients(models: DataFrame, features: Sequence[str], *, by: Sequence[str] = FOLD) -> DataFrame:
    """Models as one row per (key, feature)."""
    names = F.array(*[F.lit(f) for f in features])
    return models.select(*by, F.posexplode("coef").alias("_i", "coef"), names.alias("_n")).select(
        *by, F.col("_n")[F.col("_i")].alias("feature"), "coef")


def linear_score(df: DataFrame, models: DataFrame, features: Sequence[str], out: str = "pred", *, by: Sequence[str] = FOLD) -> DataFrame:
    """intercept + sum(coef_i * x_i), with the model joined on the key."""
    side = models.select(*by, F.col("intercept").alias("_b"), F.col("coef").alias("_w"))
    joined = attach(df, side, by) if by else df.withColumns({"_b": side.select("_b").scalar(), "_w": side.select("_w").scalar()})
    total = F.col("_b")
    for i, f in enumerate(features):
        total = total + F.col("_w")[i] * F.col(f)
    return joined.withColumn(out, total).drop("_b", "_w")


def ridge_per_symbol(
    folded: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0, *, role: str = "role", test_role: str = "val",
) -> DataFrame:
    """One ridge per (symbol, fold), scored on its validation rows; mean IC per symbol."""
    keys = ("symbol", "fold")
    models = ridge_fit(folded.filter(F.col(role) == "train"), features, y, alpha, by=keys)
    scored = linear_score(folded.filter(F.col(role) == test_role), models, features, by=keys)
    ics = spearman_ic(scored, y, "pred", by=keys)
    return ics.groupBy("symbol").agg(F.avg("ic").alias("ic"), F.count(F.lit(1)).alias("n_folds"))


def walk_forward_score(
    folded: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0, *, role: str = "role", test_role: str = "val",
    key: Sequence[str] = ("symbol", "date"), min_train: int = 200,
) -> DataFrame:
    """Out-of-sample ridge predictions of all folds; where test spans overlap the later fold wins."""
    models = ridge_fit(folded.filter(F.col(role) == "train"), features, y, alpha).filter(F.col("n") >= min_train)
    scored = linear_score(folded.filter(F.col(role) == test_role), models, features)
    return scored.filter(F.col("pred").isNotNull()).groupBy(*key).agg(
        F.max_by("pred", "fold").alias("pred"), F.max_by(y, "fold").alias(y), F.max("fold").alias("fold"))


def gbt_fit(train: DataFrame, features: Sequence[str], y: str, validation: str | None = None, **params):
    """Boosted regression trees by the ML library; ``validation`` is a boolean early-stop column."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    settings = {"maxIter": 300, "maxDepth": 4, "stepSize": 0.03, "seed": 42} | params
    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(train.dropna(subset=[*features, y]))
    model = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="pred", **settings)
    if validation:
        model = model.setValidationIndicatorCol(validation)
    return model.fit(rows)


def gbt_score(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df.dropna(subset=list(features)))
    return model.transform(rows).drop("_x")


# The five-point grid, as (trees, depth, step).
GBT_GRID = ((200, 3, 0.02), (300, 4, 0.03), (400, 5, 0.05), (500, 3, 0.01), (300, 6, 0.03))


def hp_grid_by_sharpe(
    train: DataFrame, val: DataFrame, features: Sequence[str], y: str, grid: Sequence[tuple[int, int, float]] = GBT_GRID, **params,
) -> DataFrame:
    """Validation long-short Sharpe for each grid point, best first."""
    from functools import reduce

    from barloom.operators.portfolio import long_short_daily, long_short_summary

    parts = []
    for trees, depth, step in grid:
        model = gbt_fit(train, features, y, maxIter=trees, maxDepth=depth, stepSize=step, **params)
        scored = gbt_score(model, val, features)
        parts.append(long_short_summary(long_short_daily(scored, "pred", y)).withColumns({"trees": F.lit(trees), "max_depth": F.lit(depth), "step": F.lit(step)}))
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.desc("sharpe"))


# ---- blends -------------------------------------------------------------------------------

def blend_static(df: DataFrame, weights: dict[str, float], out: str = "blend") -> DataFrame:
    """Weighted average of prediction columns, weights renormalised."""
    total = max(sum(weights.values()), 1e-10)
    value: Column = lit(0)
    for c, w in weights.items():
        value = value + lit(w) * F.col(c)
    return df.withColumn(out, value / lit(total))


def blend_by_fold_ic(df: DataFrame, y: str, preds: Sequence[str], out: str = "blend", *, by: Sequence[str] = FOLD, ics: DataFrame | None = None) -> DataFrame:
    """Weights |IC| / sum |IC| per fold, from ``ics`` (key, one column per model) or from ``df``."""
    if ics is None:
        for p in preds:
            one = spearman_ic(df, y, p, by=by).select(*by, F.abs("ic").alias(f"_w_{p}"))
            ics = one if ics is None else ics.join(one, list(by))
    else:
        ics = ics.select(*by, *[F.abs(p).alias(f"_w_{p}") for p in preds])
    joined = attach(df, ics, by)
    total = sum((F.col(f"_w_{p}") for p in preds), lit(0))
    value = sum((F.col(f"_w_{p}") * F.col(p) for p in preds), lit(0))
    return joined.withColumn(out, F.when(total > 1e-10, value / F.nullif(total, lit(0)))).drop(*[f"_w_{p}" for p in preds])


def blend_rolling_ic(
    df: DataFrame, y: str, a: str, b: str, lookback: int = 252, out: str = "fused", *, by: Sequence[str] = ("symbol",), time=TIME,
) -> DataFrame:
    """Weights from |rolling IC| over the ``lookback`` rows before the current one; 0.5 before."""
    both = rolling_ic(df, y, a, lookback, "_ia", True, by=by, time=time)
    both = rolling_ic(both, y, b, lookback, "_ib", True, by=by, time=time)
    both = positions(both, by, time, "_p")
    ia, ib = F.abs(F.coalesce("_ia", lit(0))), F.abs(F.coalesce("_ib", lit(0)))
    den = ia + ib + lit(1e-8)
    ready = F.col("_p") >= lookback
    wa, wb = F.when(ready, ia / den).otherwise(lit(0.5)), F.when(ready, ib / den).otherwise(lit(0.5))
    return both.withColumns({"weight_a": wa, "weight_b": wb, out: wa * F.col(a) + wb * F.col(b)}).drop("_ia", "_ib", "_p")


def time_decay_blend(
    df: DataFrame, a: str, b: str, alpha: float = 2.0, beta: float = 4.0, gamma: float = 0.0, out: str = "blend",
    *, by: Sequence[str] = ("symbol",), time=TIME,
) -> DataFrame:
    """w * a + (1 - w) * b with w = sigmoid(alpha * exp(-beta * tau) + gamma), tau = t / (T - 1)."""
    placed = group_stats(positions(df, by, time, "_p"), by, _n=F.count(F.lit(1)))
    tau = F.col("_p") / F.greatest(F.col("_n") - 1, F.lit(1))
    w = lit(1) / (lit(1) + F.exp(-(lit(alpha) * F.exp(lit(-beta) * tau) + lit(gamma))))
    return placed.withColumns({"weight_a": w, out: w * F.col(a) + (1 - w) * F.col(b)}).drop("_p", "_n")


# ---- soft ranks ------------------------------------------------------------------------------

GRID = 512  # fixed value: points of the grid


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


NODES = 20  # fixed value: terms that give the curve of a cell to the last digits of a double


def _kernels(width: float) -> np.ndarray:
    """Per offset of cells, ``width`` temperatures wide: Chebyshev sums of a cell's values to the polynomial they add to another cell.

    Beyond the offsets given, the same number to either side, a value counts 1 or 0 to the last digit.
    """
    reach, angle = int(np.ceil(42 / width)) + 1, np.pi * (np.arange(NODES) + 0.5) / NODES
    points = np.cos(angle) / 2
    terms = np.cos(np.outer(np.arange(NODES), angle)) * 2 / NODES
    terms[0] /= 2
    powers = np.stack([np.pad(np.polynomial.chebyshev.cheb2poly([0.0] * k + [1.0]), (0, NODES - 1 - k)) for k in range(NODES)], axis=1)
    return np.stack([powers @ (terms @ _sigmoid(width * (points[:, None] - points[None, :] - d)) @ terms.T) for d in range(-reach, reach + 1)])


def _curves(batches: Iterator[pa.RecordBatch], keys: int, width: float) -> Iterator[pa.RecordBatch]:
    """Cells in order of key and number to the polynomials of their curves; of what streams by, one batch and the cells in reach are held."""
    kernels = _kernels(width)
    reach = len(kernels) // 2
    held: pa.Table | None = None
    before, below, done = None, 0.0, 0  # the key of the last cell counted, the values of that key up to it, cells of ``held`` already given out

    def given(table: pa.Table, start: int, stop: int) -> pa.RecordBatch:
        nonlocal before, below
        rows, cell = table.num_rows, table.column("_cell").to_numpy()
        sums = np.stack([table.column(f"_m{k}").to_numpy() for k in range(NODES)], axis=1)
        lists = [table.column(i).to_pylist() for i in range(keys)]
        names = list(zip(*lists, strict=True)) if keys else [()] * rows
        new = np.array([True, *[a != b for a, b in zip(names[1:], names)]])
        group = np.cumsum(new) - 1
        first, end = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], rows)
        upto = np.concatenate([[0.0], np.cumsum(sums[:, 0])])
        at = np.arange(start, stop)
        far_to, pairs = at.copy(), []
        # Cells are distinct, so those in reach are at most as many places away.
        for step in range(-reach, reach + 1):
            to = at + step
            mine = np.flatnonzero((to >= first[group[at]]) & (to < end[group[at]]))
            with np.errstate(invalid="ignore"):  # a cell of -inf is in reach of none
                apart = cell[to[mine]] - cell[at[mine]]
                near = np.abs(apart) <= reach
            mine, apart = mine[near], apart[near].astype(np.int64)
            far_to[mine] = np.minimum(far_to[mine], to[mine])
            pairs.append((apart, mine, to[mine]))
        apart, target, source = map(np.concatenate, zip(*pairs, strict=True))
        order = np.argsort(apart, kind="stable")
        cuts = np.searchsorted(apart[order], np.arange(-reach, reach + 2))
        total = np.zeros((len(at), NODES))
        for d, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            total[target[order[lo:hi]]] += sums[source[order[lo:hi]]] @ kernels[d].T  # one cell at most is ``d`` away
        # Cells of the key before the first near one count in full, those that are no longer held too.
        base = np.zeros(len(first))
        if before is not None and before == names[0]:
            base[0] = below
        total[:, 0] += base[group[at]] + upto[far_to] - upto[first[group[at]]]
        return pa.RecordBatch.from_arrays([*[table.column(i).slice(start, stop - start).combine_chunks() for i in range(keys)], pa.array(cell[start:stop]),
                                           pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * NODES, pa.int32()), pa.array(total.ravel()))], [*table.column_names[:keys], "_cell", "_curve"])

    def dropped(table: pa.Table, rows: int) -> pa.Table:
        """The table without its first rows, whose values are kept as a number."""
        nonlocal before, below
        if not rows:
            return table
        names = list(zip(*[table.column(i).slice(0, rows).to_pylist() for i in range(keys)], strict=True)) if keys else [()] * rows
        counts = table.column("_m0").slice(0, rows).to_numpy()
        mine = np.array([n == names[-1] for n in names])
        below = (below if before == names[-1] else 0.0) + float(counts[mine].sum())
        before = names[-1]
        return table.slice(rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        ready = held.num_rows - reach
        if ready > done:
            yield given(held, done, ready)
            held, done = dropped(held, max(0, ready - reach)), min(ready, reach)
    if held is not None and held.num_rows > done:
        yield given(held, done, held.num_rows)


def _curve_rank(rows: DataFrame, cols: Sequence[str], outs: Sequence[str], temperature: float, by: Sequence[str]) -> DataFrame:
    """sum_j sigmoid((x_i - x_j) / temperature) without pairs: the values of a cell act through their Chebyshev sums.

    In cells of at most two temperatures the share of a value is a polynomial to rounding, in both values. Sums per (key, cell) are
    partial aggregates, the curves come from the cells as they stream by in order, and each row evaluates the curve of its cell; no
    task holds a key. A cell's width is a power of two, so that places in it are exact. Infinite values have no rank.
    """
    width = 2.0 ** np.floor(np.log2(2 * temperature))
    number = lambda q: F.when(F.abs(q) < 2.0**53, F.floor(q).cast("double")).otherwise(q)
    angle = lambda q: F.acos(2 * (q - number(q)) - 1)
    c64 = [F.col(c).cast("double") for c in cols]
    scaled = [c / lit(width) for c in c64]
    each = F.array(*[F.struct(F.lit(i).alias("_of"), q.alias("_q")) for i, q in enumerate(scaled)])
    values = rows.select(*by, F.inline(each)).filter(F.col("_q") < float("inf"))
    keys = ["_of", *by]
    sums = values.select(*keys, number(F.col("_q")).alias("_cell"), angle(F.col("_q")).alias("_angle")).groupBy(*keys, "_cell").agg(
        *[F.sum(F.cos(k * F.col("_angle")) if k else lit(1)).alias(f"_m{k}") for k in range(NODES)])
    dealt = sums.repartition(*keys).sortWithinPartitions(*keys, "_cell")
    schema = T.StructType([*sums.select(*keys, "_cell").schema.fields, T.StructField("_curve", T.ArrayType(T.DoubleType()))])
    curves = dealt.mapInArrow(lambda batches: _curves(batches, len(keys), width / temperature), schema)
    out = rows
    for i, (q, o) in enumerate(zip(scaled, outs, strict=True)):
        mine = curves.filter(F.col("_of") == i).drop("_of")
        # Places are columns of their own below the join: inlined in every term they would make a method too long to compile.
        out = attach(out.withColumns({"_cell": number(q), "_u": 2 * (q - number(q)) - 1}), mine, [*by, "_cell"])
        value = reduce(lambda total, k: total * F.col("_u") + F.col("_curve")[k], range(NODES - 2, -1, -1), F.col("_curve")[NODES - 1])
        out = out.withColumn(o, F.when(F.abs(c64[i]) < float("inf"), value).otherwise(lit(float("nan")))).drop("_cell", "_u", "_curve")
    return out.select(*rows.columns, *outs)


def soft_rank(
    df: DataFrame, cols: Sequence[str], temperature: float = 0.1, prefix: str = "soft_rank_", method: str = "exact",
    *, by: Sequence[str] = (TIME,),
) -> DataFrame:
    """sum_j sigmoid((x_i - x_j) / temperature) per key.

    ``method="exact"`` sums over all rows of a key, of any size, to rounding: see ``_curve_rank``. ``method="grid"`` takes the smoothed distribution at 512 points between the
    extremes of a key of any size, summed by tasks and interpolated.  The size of a key never picks the method.
    """
    if method not in ("exact", "grid"):
        raise ValueError(f"no such method: {method}")
    rows = df.dropna(subset=list(cols))
    outs = [f"{prefix}{c}" for c in cols]
    if method == "grid":
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
        sized = attach(rows, sizes, by)
        for c, o in zip(cols, outs):
            sized = _grid_rank(sized, c, o, temperature, by)
        return sized.select(*df.columns, *outs)

    return _curve_rank(rows, cols, outs, temperature, by)


def _grid_rank(df: DataFrame, col: str, out: str, temperature: float, by: Sequence[str]) -> DataFrame:
    lo, hi, step = f"_lo_{col}", f"_hi_{col}", GRID - 1
    keys = [f for f in df.schema.fields if f.name in by]
    schema = T.StructType([*keys, T.StructField("k", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in pdf.groupby(list(by), sort=False, dropna=False):
                q = np.linspace(part[lo].iloc[0], part[hi].iloc[0], GRID)
                x = part[col].to_numpy(float)
                total = sum(_sigmoid((q[None, :] - x[i:i + 2048, None]) / temperature).sum(axis=0) for i in range(0, len(x), 2048))
                frame = pd.DataFrame({"k": np.arange(GRID, dtype="int32"), "v": total})
                for name, value in zip(by, key):
                    frame[name] = value
                yield frame[[*by, "k", "v"]]

    sums = df.select(*by, col, lo, hi).mapInPandas(partial, schema).groupBy(*by, "k").agg(F.sum("v").alias("v"))
    curve = sums.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("_curve"))
    spread = F.col(hi) - F.col(lo)
    place = F.when(spread >= 1e-8, (F.col(col) - F.col(lo)) / F.nullif(spread, lit(0)) * step)
    right = F.greatest(F.least(F.ceil(place), F.lit(step)), F.lit(1)).cast("int")
    frac = F.least(F.greatest(place - (right - 1), lit(0)), lit(1))
    left_v, right_v = F.col("_curve")[right - 1], F.col("_curve")[right]
    value = F.when(spread < 1e-8, F.col("_n") / lit(2)).otherwise(left_v + frac * (right_v - left_v))
    return attach(df, curve, by).withColumn(out, value).drop("_curve")


def rankic_value(df: DataFrame, y: str, yhat: str, temperature: float = 0.1, method: str = "exact", *, by: Sequence[str] = (TIME,)) -> DataFrame:
    """1 - correlation of the soft ranks per key."""
    ranked = soft_rank(df.select(*by, y, yhat), [y, yhat], temperature, "_k_", method, by=by)
    a, b = F.col(f"_k_{y}"), F.col(f"_k_{yhat}")
    n = F.count(F.lit(1))
    cov, va, vb = F.covar_pop(a, b) * n, F.var_pop(a) * n, F.var_pop(b) * n
    rho = cov / (F.sqrt(va + lit(1e-8)) * F.sqrt(vb + lit(1e-8)) + lit(1e-8))
    return ranked.groupBy(*by).agg((1 - rho).alias("rankic_loss"))


def evaluate_folds(scored: DataFrame, y: str, yhat: str = "pred", *, by: Sequence[str] = FOLD) -> DataFrame:
    """IC, direction accuracy, pooled long-short Sharpe and daily IC mean per fold."""
    from barloom.operators.metrics import direction_accuracy
    from barloom.operators.portfolio import long_short_pooled

    daily = daily_ic_series(scored, y, yhat, 10, by=(*by, TIME)).groupBy(*by).agg(F.avg("ic").alias("daily_ic_mean"))
    out = spearman_ic(scored, y, yhat, by=by)
    for side in (direction_accuracy(scored, y, yhat, by=by), long_short_pooled(scored, yhat, y, by=by), daily):
        out = out.join(side, list(by), "left")
    return out


