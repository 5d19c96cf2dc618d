"""Boosted trees as Spark jobs: each level of a tree is one histogram aggregate over all
rows, and a forest is a table of nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import lit
from barloom.functions.grouping import attach, group_stats, longest_group, ordered, quantiles
from barloom.session import cut_lineage, rows_per_task

Loss = Callable[[Column, Column], tuple[Column, Column, Column]]
HELD = 2**28


# ---- losses: (row loss, gradient, hessian) as columns --------------------------------------

def mse(y: Column, p: Column):
    return (p - y) * (p - y), lit(2) * (p - y), lit(2)


def mae(y: Column, p: Column, eps: float = 1e-8):
    return F.abs(p - y), F.signum(p - y), lit(eps)


def huber(y: Column, p: Column, delta: float = 1.0):
    r, near = p - y, F.abs(p - y) <= delta
    loss = F.when(near, lit(0.5) * r * r).otherwise(lit(delta) * (F.abs(r) - lit(0.5 * delta)))
    return loss, F.when(near, r).otherwise(lit(delta) * F.signum(r)), F.when(near, lit(1)).otherwise(lit(1e-8))


def quantile(y: Column, p: Column, alpha: float = 0.5):
    """The residual is prediction minus target."""
    r = p - y
    return F.greatest(lit(alpha) * r, lit(alpha - 1) * r), F.when(r > 0, lit(alpha)).otherwise(lit(alpha - 1)), lit(1e-8)


def logloss(y: Column, p: Column):
    """Targets in [0, 1], predictions are logits."""
    s = lit(1) / (lit(1) + F.exp(-p))
    return F.greatest(p, lit(0)) - p * y + F.log1p(F.exp(-F.abs(p))), s - y, s * (1 - s)


LOSSES: dict[str, Loss] = {"mse": mse, "mae": mae, "huber": huber, "quantile": quantile, "logloss": logloss}


def grad_hess(df: DataFrame, y: str, pred: str, loss: str | Loss = "mse", prefix: str = "", **params) -> DataFrame:
    """Add loss, grad and hess columns for a named or user loss."""
    fn = LOSSES[loss] if isinstance(loss, str) else loss
    value, g, h = fn(F.col(y), F.col(pred), **params)
    return df.withColumns({f"{prefix}loss": value, f"{prefix}grad": g, f"{prefix}hess": h})


# ---- bins ---------------------------------------------------------------------------------------

def bin_boundaries(df: DataFrame, features: Sequence[str], num_bins: int = 256) -> DataFrame:
    """Per feature: midpoints of the distinct values when they are few, else values at equal
    steps through the distinct values.  Only the picked values (at most 255) are collected."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("v"))
    values = long.select("v.*").filter(F.col("x").isNotNull() & ~F.isnan("x")).distinct()
    rows = longest_group(df, ())  # no feature has more distinct values than rows
    bound = rows if rows <= rows_per_task(df.sparkSession) else None
    placed = ordered(values, ["feature"], ["x"], out="_k", total="_u", longest=bound)
    k = F.col("_k") - 1
    steps = F.sequence(F.lit(1), F.lit(num_bins - 1))
    picks = F.transform(steps, lambda s: F.floor(s.cast("double") / lit(num_bins) * (F.col("_u") - 1)))
    kept = placed.filter((F.col("_u") < num_bins) | F.array_contains(picks, k.cast("bigint")))
    sorted_ = kept.groupBy("feature").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.max("_u").alias("u"))
    mids = F.zip_with(F.slice("xs", 1, F.size("xs") - 1), F.slice("xs", 2, F.size("xs")), lambda a, b: (a + b) / 2)
    eps = F.greatest(F.abs(F.col("xs")[0]) * 1e-5, lit(1e-7))
    one = F.transform(steps, lambda s: F.col("xs")[0] + eps * s)
    return sorted_.select("feature", F.when(F.col("u") == 1, one).when(F.col("u") < num_bins, mids).otherwise(F.col("xs")).alias("bounds"))


def _edges(bounds: DataFrame) -> dict[str, np.ndarray]:
    """Boundaries on the driver: at most 255 numbers per feature."""
    return {r["feature"]: np.asarray(r["bounds"], float) for r in bounds.collect()}


def _bin_udf(edges: dict[str, np.ndarray], features: Sequence[str]):
    @F.pandas_udf("array<int>")
    def place(*cols: pd.Series) -> pd.Series:
        placed = [np.where(c.isna(), 0, np.searchsorted(edges.get(f, np.zeros(0)), c.to_numpy(float), side="left"))
                  for f, c in zip(features, cols)]
        return pd.Series(list(np.column_stack(placed).astype("int32")))

    return place(*[F.col(f).cast("double") for f in features])


def bin_features(df: DataFrame, bounds: DataFrame, features: Sequence[str], prefix: str = "bin_") -> DataFrame:
    """Bin = number of boundaries below the value; NULL goes to bin 0."""
    rows = df.withColumn("_b", _bin_udf(_edges(bounds), features))
    return rows.withColumns({f"{prefix}{f}": F.col("_b")[i] for i, f in enumerate(features)}).drop("_b")


# ---- histograms and splits -------------------------------------------------------------------------

def grad_histogram(df: DataFrame, bins: Column, *, node: str = "node", grad: str = "grad", hess: str = "hess") -> DataFrame:
    """Sum of gradients, hessians and rows per (node, feature, bin); ``bins`` is an array column with one bin per feature.

    Tasks add their rows into one flat array per node, and ship that: the shuffle carries a row per (task, node), not per row and
    feature. A task holds at most ``HELD`` bytes of arrays before it ships them.
    """
    rows = df.select(F.col(node).alias("node"), F.col(grad).cast("double"), F.col(hess).cast("double"), bins.cast("array<int>"))
    kind = rows.schema["node"].dataType
    partial = T.StructType([T.StructField("node", kind), T.StructField("features", T.IntegerType()), T.StructField("sums", T.BinaryType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(0).dictionary_encode(null_encoding="encode")
            codes, names = nodes.indices.to_numpy(), nodes.dictionary.to_pylist()
            g, h = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (1, 2))
            cells = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            width = int(cells.max(initial=0)) + 1
            sums = np.empty((len(names), cells.shape[1], width, 3))
            for i in range(cells.shape[1]):
                at = codes * width + cells[:, i]
                for j, weight in enumerate((g, h, None)):
                    sums[:, i, :, j] = np.bincount(at, weight, len(names) * width).reshape(-1, width)
            for name, one in zip(names, sums, strict=True):
                held[name] = _added(held.get(name), one)
            if sum(a.nbytes for a in held.values()) > HELD:
                yield _shipped(held, batch.schema.field(0).type)
                held = {}
        if held:
            yield _shipped(held, batch.schema.field(0).type)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            kind = batch.schema.field(0).type
            for name, features, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held[name] = _added(held.get(name), np.frombuffer(body.as_buffer()).reshape(features, -1, 3))
        for name, sums in held.items():
            feature, at = np.nonzero(sums[:, :, 2])
            g, h, n = sums[feature, at].T
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), kind), pa.array(feature, pa.int32()), pa.array(at, pa.int32()), pa.array(g), pa.array(h), pa.array(n.astype(np.int64))],
                ["node", "feature", "bin", "g", "h", "n"])

    out = T.StructType([T.StructField("node", kind), T.StructField("feature", T.IntegerType()), T.StructField("bin", T.IntegerType()),
                        T.StructField("g", T.DoubleType()), T.StructField("h", T.DoubleType()), T.StructField("n", T.LongType())])
    return rows.mapInArrow(fill, partial).repartition("node").mapInArrow(join, out).withColumnRenamed("node", node)


def _added(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """The sum of two (feature, bin, 3) arrays, as wide as the wider one."""
    if a is None:
        return b.copy()
    if a.shape[1] < b.shape[1]:
        a, b = b.copy(), a
    a[:, :b.shape[1]] += b
    return a


def _shipped(held: dict, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), kind), pa.array([a.shape[0] for a in held.values()], pa.int32()), pa.array([a.tobytes() for a in held.values()], pa.binary())],
        ["node", "features", "sums"])


def _score(g: Column, h: Column, l2: float) -> Column:
    den = h + lit(l2)
    return F.when(den <= 1.1754943508222875e-38, lit(0)).otherwise(g * g / F.nullif(den, lit(0)))


def best_split(
    hist: DataFrame, lambda_l2: float = 1.0, gamma: float = 0.0, monotone: dict[int, int] | None = None, *, node: str = "node",
) -> DataFrame:
    """Best (feature, bin) per node: rows in bins up to ``bin`` go left.  The first maximum in
    feature, bin order wins; ``monotone`` maps a feature to +1 or -1."""
    line = Window.partitionBy(node, "feature")  # at most 256 bins
    run = line.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumns({
        "gl": F.sum("g").over(run), "hl": F.sum("h").over(run), "nl": F.sum("n").over(run),
        "gp": F.sum("g").over(line), "hp": F.sum("h").over(line), "np": F.sum("n").over(line)})
    gr, hr = F.col("gp") - F.col("gl"), F.col("hp") - F.col("hl")
    gain = _score(F.col("gl"), F.col("hl"), lambda_l2) + _score(gr, hr, lambda_l2) - _score(F.col("gp"), F.col("hp"), lambda_l2) - lit(gamma)
    ok = (F.col("hl") > 0) & (hr > 0) & (F.col("nl") < F.col("np"))
    for feature, way in (monotone or {}).items():
        left = F.try_divide(-F.col("gl"), F.col("hl") + lit(lambda_l2))
        right = F.try_divide(-gr, hr + lit(lambda_l2))
        ok = ok & ((F.col("feature") != feature) | (left <= right if way > 0 else left >= right))
    best = F.min_by(F.struct("gain", "feature", "bin", "nl", "np"), F.struct((-F.col("gain")).alias("o"), "feature", "bin"))
    return cum.withColumn("gain", gain).filter(ok).groupBy(node).agg(best.alias("s")).select(node, "s.*")


def leaf_value_of(g: Column, h: Column, lambda_l1: float = 0.0, lambda_l2: float = 1.0) -> Column:
    """-soft(G, l1) / (H + l2); 0 when the denominator vanishes."""
    shrunk = F.signum(g) * F.greatest(F.abs(g) - lit(lambda_l1), lit(0))
    den = h + lit(lambda_l2)
    return F.when(den <= 1e-20, lit(0)).otherwise(-shrunk / F.nullif(den, lit(0)))


def leaf_values(df: DataFrame, lambda_l1: float = 0.0, lambda_l2: float = 1.0, *, node: str = "node", grad: str = "grad", hess: str = "hess") -> DataFrame:
    sums = df.groupBy(node).agg(F.sum(grad).alias("g"), F.sum(hess).alias("h"))
    return sums.withColumn("leaf_value", leaf_value_of(F.col("g"), F.col("h"), lambda_l1, lambda_l2))


# ---- fitting ---------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class BoostConfig:
    num_trees: int = 100
    max_depth: int = 6
    learning_rate: float = 0.1
    lambda_l1: float = 0.0
    lambda_l2: float = 1.0
    gamma: float = 0.0
    min_samples_leaf: int = 20
    min_gain: float = 0.0
    max_bins: int = 256
    subsample_row: float = 1.0
    subsample_col: float = 1.0
    line_search: bool = False
    early_stopping: int = 0
    tolerance: float = 0.0
    checkpoint_every: int = 5
    seed: int = 42
    monotone: dict[int, int] = field(default_factory=dict)


FOREST_SCHEMA = ("tree_id int, node_id int, feature_idx int, split_value double, left int, right int, leaf_value double, "
                 "num_samples bigint, gain double, default_left boolean, step double")


@dataclass
class Boosted:
    """A fitted forest: the starting prediction, node rows and the loss history."""

    init: float
    features: list[str]
    nodes: list[tuple]
    train_losses: list[float]
    val_losses: list[float]

    def forest(self, spark) -> DataFrame:
        return spark.createDataFrame(self.nodes, FOREST_SCHEMA)


def _route(splits: dict[int, tuple[int, int]], leaves: dict[int, float], node: int, bins: str) -> Column:
    """Nested condition over bins giving the leaf value of a tree."""
    if node not in splits:
        return lit(leaves[node])
    f, b = splits[node]
    return F.when(F.col(bins)[f] <= b, _route(splits, leaves, 2 * node + 1, bins)).otherwise(
        _route(splits, leaves, 2 * node + 2, bins))


def boost_fit(
    df: DataFrame, features: Sequence[str], y: str, loss: str | Loss = "mse", config: BoostConfig = BoostConfig(),
    validation: str | None = None,
) -> Boosted:
    """Custom-loss boosting.  The driver only sees the chosen splits and node totals (at most
    2^depth per level); rows stay in place, and lineage is cut every few trees."""
    fn = LOSSES[loss] if isinstance(loss, str) else loss
    features = list(features)
    is_val = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    rows = df.select(*[F.col(f).cast("double") for f in features], F.col(y).cast("double").alias("_y"), is_val.alias("_val")).dropna(subset=["_y"])
    train = rows.filter(~F.col("_val"))
    bounds = _edges(bin_boundaries(train, features, config.max_bins))
    centre = quantiles(train, (), "_y", [0.5]).select(F.col("cuts")[0]) if loss == "mae" else train.agg(F.avg("_y"))
    init = float(centre.first()[0])
    state = rows.select(_bin_udf(bounds, features).alias("_b"), "_y", "_val", F.rand(config.seed).alias("_u"), lit(init).alias("_p"))
    state = cut_lineage(state)
    nodes: list[tuple] = []
    train_losses: list[float] = []
    val_losses: list[float] = []
    best, best_trees, waited, tree = float("inf"), 0, 0, 0
    for tree in range(config.num_trees):
        _, g, h = fn(F.col("_y"), F.col("_p"))
        seen = state.filter(~F.col("_val")).withColumns({"grad": g, "hess": h})
        if config.subsample_row < 1:
            seen = seen.filter(F.pmod(F.xxhash64("_u", F.lit(tree)), F.lit(1_000_000)) < int(config.subsample_row * 1_000_000))
        used = list(range(len(features)))
        if config.subsample_col < 1:
            rng = np.random.default_rng((config.seed, tree))
            used = sorted(rng.choice(len(features), max(1, int(len(features) * config.subsample_col)), replace=False).tolist())
        splits, totals, gains, shown = _grow(seen, used, config)
        leaves = {n: _leaf(gh, config) for n, gh in totals.items()}
        value = _route(splits, leaves, 0, "_b")
        rho = 1.0
        if config.line_search:
            top, down = state.filter(~F.col("_val")).select(F.sum(g * value), F.sum(h * value * value)).first()
            rho = -top / down if down and down > 1e-10 else 1.0
        step = config.learning_rate * rho
        state = state.withColumn("_p", F.col("_p") + lit(step) * value)
        if (tree + 1) % config.checkpoint_every == 0:
            state = cut_lineage(state)
        for n in sorted(totals):
            if n in splits:
                f, b = splits[n]
                nodes.append((tree, n, f, float(bounds[features[f]][b]), 2 * n + 1, 2 * n + 2, 0.0, shown[n], gains[n], True, step))
            else:
                nodes.append((tree, n, -1, 0.0, -1, -1, leaves[n], shown[n], 0.0, True, step))
        cost, _, _ = fn(F.col("_y"), F.col("_p"))
        means = {r["_val"]: r["m"] for r in state.groupBy("_val").agg(F.avg(cost).alias("m")).collect()}
        train_losses.append(means.get(False))
        if validation and means.get(True) is not None:
            val_losses.append(means[True])
            if means[True] < best - config.tolerance:
                best, best_trees, waited = means[True], tree + 1, 0
            else:
                waited += 1
            if config.early_stopping and waited >= config.early_stopping:
                nodes = [n for n in nodes if n[0] < best_trees]
                train_losses, val_losses = train_losses[:best_trees], val_losses[:best_trees]
                break
    return Boosted(init, features, nodes, train_losses, val_losses)


def _leaf(gh: tuple[float, float], config: BoostConfig) -> float:
    g, h = gh
    den = h + config.lambda_l2
    return 0.0 if den <= 1e-20 else float(-np.sign(g) * max(abs(g) - config.lambda_l1, 0) / den)


def _grow(seen: DataFrame, used: list[int], config: BoostConfig):
    """Level by level: one histogram job per level over the rows of nodes still open."""
    splits: dict[int, tuple[int, int]] = {}
    gains: dict[int, float] = {}
    first = seen.agg(F.sum("grad"), F.sum("hess"), F.count(F.lit(1))).first()
    totals, shown = {0: (first[0] or 0.0, first[1] or 0.0)}, {0: first[2]}
    open_nodes = [0]
    place: Column = F.lit(0)
    picked = F.array(*[F.col("_b")[f] for f in used])
    for _ in range(config.max_depth):
        if not open_nodes:
            break
        level = seen.withColumn("node", place).filter(F.col("node").isin(open_nodes))
        hist = grad_histogram(level, picked).withColumn("feature", F.array(*[F.lit(f) for f in used])[F.col("feature")])
        found = best_split(hist, config.lambda_l2, config.gamma, config.monotone)
        chosen = attach(hist, found.select("node", F.col("feature").alias("_f"), F.col("bin").alias("_c"), "gain", "nl", "np"), ["node"], "inner")
        left = F.col("bin") <= F.col("_c")
        sums = chosen.filter(F.col("feature") == F.col("_f")).groupBy("node", "_f", "_c", "gain", "nl", "np").agg(
            F.sum(F.when(left, F.col("g"))).alias("gl"), F.sum(F.when(left, F.col("h"))).alias("hl")).collect()
        open_nodes = []
        for r in sums:
            n, nl, nr = r["node"], r["nl"], r["np"] - r["nl"]
            if r["gain"] <= config.min_gain or min(nl, nr) < config.min_samples_leaf:
                continue
            splits[n], gains[n] = (r["_f"], r["_c"]), r["gain"]
            g, h = totals[n]
            totals |= {2 * n + 1: (r["gl"], r["hl"]), 2 * n + 2: (g - r["gl"], h - r["hl"])}
            shown |= {2 * n + 1: nl, 2 * n + 2: nr}
            open_nodes += [2 * n + 1, 2 * n + 2]
        place = _place(splits, 0)
    return splits, totals, gains, shown


def _place(splits: dict[int, tuple[int, int]], node: int) -> Column:
    if node not in splits:
        return F.lit(node)
    f, b = splits[node]
    return F.when(F.col("_b")[f] <= b, _place(splits, 2 * node + 1)).otherwise(_place(splits, 2 * node + 2))


# ---- using a forest ------------------------------------------------------------------------------------------

Node = dict


def _trees(forest: DataFrame) -> dict[int, dict[int, Node]]:
    out: dict[int, dict[int, Node]] = {}
    for r in forest.collect():  # a model: thousands of nodes at most
        out.setdefault(r["tree_id"], {})[r["node_id"]] = r.asDict()
    return out


def _leafy(n: Node) -> bool:
    return n["left"] is None or n["left"] < 0


def forest_score(
    df: DataFrame, forest: DataFrame, features: Sequence[str], init: float = 0.0, step: float | None = None, out: str = "pred",
    inline_nodes: int = 400,
) -> DataFrame:
    """init + sum(step * leaf): NULL, NaN and x <= split go left.  Small forests become one nested
    expression; larger ones run as an Arrow function over column batches."""
    trees = _trees(forest)
    size = sum(len(t) for t in trees.values())
    step_of = lambda t: step if step is not None else next(iter(t.values())).get("step") or 1.0

    if size <= inline_nodes:
        def walk(t: dict[int, Node], n: int) -> Column:
            node = t[n]
            if _leafy(node):
                return lit(node["leaf_value"] or 0.0)
            x = F.col(features[node["feature_idx"]])
            return F.when(x.isNull() | F.isnan(x) | (x <= lit(node["split_value"])), walk(t, node["left"])).otherwise(walk(t, node["right"]))

        total: Column = lit(init)
        for t in trees.values():
            total = total + lit(step_of(t)) * walk(t, min(t))
        return df.withColumn(out, total)

    packed = [(step_of(t), t) for t in trees.values()]

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        total = np.full(len(x), init)
        for weight, t in packed:
            stack = [(min(t), np.arange(len(x)))]
            while stack:
                n, idx = stack.pop()
                node = t[n]
                if _leafy(node):
                    total[idx] += weight * (node["leaf_value"] or 0.0)
                    continue
                v = x[idx, node["feature_idx"]]
                go = np.isnan(v) | (v <= node["split_value"])
                stack += [(node["left"], idx[go]), (node["right"], idx[~go])]
        return pd.Series(total)

    return df.withColumn(out, score(*features))


def forest_importance(forest: DataFrame, normalise_frequency: bool = True, *, by: Sequence[str] = ()) -> DataFrame:
    """Split count, gain and coverage per feature, each as a share (counts raw on request)."""
    inner = forest.filter((F.col("left") >= 0) & (F.col("feature_idx") >= 0))
    per = inner.groupBy(*by, "feature_idx").agg(
        F.count(F.lit(1)).cast("double").alias("frequency"), F.sum(F.greatest("gain", lit(0))).alias("gain"),
        F.sum("num_samples").cast("double").alias("coverage"))
    names = ["frequency", "gain", "coverage"]
    total = group_stats(per, by, **{f"_t_{n}": F.sum(n) for n in names})
    share = {n: F.coalesce(F.try_divide(F.col(n), F.col(f"_t_{n}")), lit(0)) for n in names if n != "frequency" or normalise_frequency}
    return total.withColumns(share).drop(*[f"_t_{n}" for n in names])


def importance_by_window(imp: DataFrame, top_k: int = 10, *, window: str = "window") -> tuple[DataFrame, DataFrame]:
    """Top features per window by gain, and means over windows with their global rank."""
    w = Window.partitionBy(window).orderBy(F.desc("gain"), "feature_idx")
    top = imp.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top_k)
    mean = imp.groupBy("feature_idx").agg(*[F.avg(c).alias(c) for c in ("gain", "frequency", "coverage")])
    placed = ordered(mean.withColumn("_g", -F.col("gain")), (), ["_g", "feature_idx"], out="place").drop("_g")
    return top, placed.withColumn("in_top", F.col("place") <= top_k)


def path_attribution(
    df: DataFrame, forest: DataFrame, features: Sequence[str], key: Sequence[str], learning_rate: float = 1.0,
) -> DataFrame:
    """Leaf value shared equally by the distinct features on the path, summed over trees:
    one row per (key, feature)."""
    trees = list(_trees(forest).values())
    k = len(features)
    keyed = df.select(*key, *features)
    schema = T.StructType([*[f for f in keyed.schema.fields if f.name in key], T.StructField("shares", T.ArrayType(T.DoubleType()))])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(features)].to_numpy(float)
            phi = np.zeros((len(x), k))
            for t in trees:
                stack = [(min(t), np.arange(len(x)), frozenset())]
                while stack:
                    n, idx, path = stack.pop()
                    node = t[n]
                    if _leafy(node):
                        cols = sorted(path) or range(k)
                        phi[np.ix_(idx, list(cols))] += (node["leaf_value"] or 0.0) / len(cols)
                        continue
                    f = node["feature_idx"] % k
                    v = x[idx, f]
                    left_ok = node["default_left"] is not False
                    go = np.where(np.isnan(v), left_ok, v <= node["split_value"])
                    stack += [(node["left"], idx[go], path | {f}), (node["right"], idx[~go], path | {f})]
            out = pdf[list(key)].copy()
            out["shares"] = list(phi * learning_rate)
            yield out

    names = F.array(*[F.lit(f) for f in features])
    rows = keyed.mapInPandas(spread, schema)
    return rows.select(*key, F.posexplode("shares").alias("_i", "attribution")).select(*key, names[F.col("_i")].alias("feature"), "attribution")


def attribution_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))
