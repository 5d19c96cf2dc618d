"""Boosted trees of all folds, and of all points of a grid, grown together: one histogram job per level for all of them.

Rows are binned once per fold, with boundaries from the fold's training rows, and kept as blocks: the bins of some thousand rows as
bytes, with targets and one prediction per member (a fold with its settings). A job per level adds up, inside tasks, one flat array of
gradients, hessians and counts per (member, node); of two children only the smaller is counted, the other is its parent less it. The
arrays meet by (member, parent), where the best split is chosen; the driver sees splits, node totals and ``COLLECTED`` bytes of arrays.

Tasks hold members x 2^(depth - 1) arrays of 24 bytes per feature and bin, and ship them early beyond ``HELD`` bytes; small ones are added
up on the driver. The blocks and the histograms of a level are RDDs: some hundred trees have thousands of levels, and each would be
planned anew as a DataFrame. Blocks are kept with the predictions so far, which move on by one tree in the first level of the next, and
are checkpointed every ``rewrite_every`` trees. Histograms of one level are kept for the next; where an executor goes with them, the
levels above are counted again.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.grouping import ranged
from barloom.functions.sketches import CAPACITY, EVERY, PARTS, Distinct, merged, packed, unpacked
from barloom.operators.boosting import FOREST_SCHEMA, HELD, BoostConfig
from barloom.operators.portfolio import long_short_daily, long_short_summary
from barloom.operators.scoring import GBT_GRID
from barloom.session import checkpoints, shared_folder

REDUCED = 2**24
COLLECTED = 2**26
TASK_ROWS = 2**17
MASKED = 62
CELLS = 2**17
ArrayLoss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def squared(y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row loss, gradient, hessian) of the squared error; any callable of this form may be given."""
    return (p - y) ** 2, 2 * (p - y), np.full(len(y), 2.0)


def logistic(y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets in [0, 1], predictions are logits."""
    s = 1 / (1 + np.exp(-p))
    return np.maximum(p, 0) - p * y + np.log1p(np.exp(-np.abs(p))), s - y, s * (1 - s)


@dataclass(frozen=True)
class Member:
    """One forest to grow: an id, the fold whose rows it sees, and its settings."""

    name: int
    fold: int
    config: BoostConfig


@dataclass
class Growth:
    """A member's forest so far, on the driver: models only."""

    member: Member
    init: float
    trees: list[dict] = field(default_factory=list)
    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)
    totals: dict[int, tuple[float, float, int]] = field(default_factory=dict)
    losses: list[tuple[float, float | None]] = field(default_factory=list)
    open: list[int] = field(default_factory=list)
    written: int = 0
    best: float = float("inf")
    best_trees: int = 0
    waited: int = 0
    done: bool = False

    def arrays(self, tree: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature or -1, bin, value) by heap number of the node."""
        size = 2 ** (self.member.config.max_depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        for node, (f, b, _) in tree["splits"].items():
            feature[node], cut[node] = f, b
        for node, v in tree["leaves"].items():
            value[node] = v
        return feature, cut, value


@dataclass
class FoldForests:
    """Forests of all members: boundaries and starting values per fold, trees and losses per member."""

    features: list[str]
    members: list[Growth]
    edges: dict[tuple[int, int], np.ndarray]

    def forest(self, spark: SparkSession) -> DataFrame:
        """Node rows of all forests, with ``member`` and ``fold``; ``step`` is the learning rate."""
        rows = []
        for m in self.members:
            for t, tree in enumerate(m.trees):
                for node, (g, h, n) in sorted(tree["totals"].items()):
                    if node in tree["splits"]:
                        f, b, gain = tree["splits"][node]
                        rows.append((m.member.name, m.member.fold, t, node, f, float(self.edges[m.member.fold, f][b]), 2 * node + 1, 2 * node + 2,
                                     0.0, n, gain, True, m.member.config.learning_rate))
                    else:
                        rows.append((m.member.name, m.member.fold, t, node, -1, 0.0, -1, -1, tree["leaves"][node], n, 0.0, True, m.member.config.learning_rate))
        return spark.createDataFrame(rows, "member int, fold int, " + FOREST_SCHEMA)

    def history(self, spark: SparkSession) -> DataFrame:
        """(member, fold, trees, train_loss, val_loss) after each number of trees, the starting value at 0."""
        rows = [(m.member.name, m.member.fold, i, *loss) for m in self.members for i, loss in enumerate(m.losses)]
        return spark.createDataFrame(rows, "member int, fold int, trees int, train_loss double, val_loss double")


Spans = list[tuple[int, str, int, int]]


def _spans(folds: DataFrame) -> Spans:
    """The fold table on the driver: tens of rows."""
    return [(r["fold"], r["role"], r["lo"], r["hi"]) for r in folds.select("fold", "role", "lo", "hi").collect()]


def _numbers(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)])


def _in_spans(at: np.ndarray, spans: Spans, fold: int, role: str) -> np.ndarray:
    hit = np.zeros(len(at), bool)
    for f, r, lo, hi in spans:
        if f == fold and r == role:
            hit |= (at >= lo) & (at < hi)
    return hit


def grow_forests(
    df: DataFrame, folds: DataFrame, features: Sequence[str], y: str, members: Sequence[Member], loss: ArrayLoss = squared, *,
    idx: str = "date_idx", train_role: str = "train", val_role: str = "val", min_train: int = 200, min_val: int = 50,
    capacity: int = CAPACITY // 4, exact: bool = False, rewrite_every: int = 20,
) -> FoldForests:
    """Grow the forests of all ``members`` on the fold spans (fold, role, lo, hi) of the integer column ``idx``.

    Rows with a null target are left out; null and NaN features go left. The start is the mean target. A member stops when its loss on
    the validation rows has not sunk for ``early_stopping`` trees, and keeps its best ones. Folds with fewer rows than ``min_train`` or
    ``min_val`` get no forest. With ``exact`` features of more than ``capacity`` distinct values are cut at exact ranks of all of them.
    """
    if any(m.config.line_search or m.config.max_bins > 256 for m in members):
        raise ValueError("no line search and at most 256 bins")
    features, spans = list(features), _spans(folds)
    k = len(features)
    wanted = sorted({m.fold for m in members})
    rows = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, f in enumerate(features)],
                     F.col(y).cast("double").alias("y"), F.col(idx).cast("bigint").alias("at")).filter(F.col("y").isNotNull() & ~F.isnan("y"))
    used = [lo_hi for f, r, *lo_hi in spans if f in wanted and r in (train_role, val_role)]
    rows = rows.filter(reduce(lambda a, b: a | b, [(F.col("at") >= lo) & (F.col("at") < hi) for lo, hi in used], F.lit(False)))
    rows = _write(df.sparkSession, rows)  # read twice or more: what made it runs once
    edges, starts = _fold_bins(rows, spans, wanted, k, max(m.config.max_bins for m in members), capacity, train_role, val_role, exact)
    growths = [Growth(m, starts[m.fold][0]) for m in members
               if m.fold in starts and starts[m.fold][1] >= min_train and starts[m.fold][2] >= min_val]
    order = {f: [g.member.name for g in growths if g.member.fold == f] for f in wanted}
    spark = df.sparkSession
    checkpoints(spark)
    if loss is squared and all(m.config.subsample_row >= 1 for m in members) and growths and _cells(edges, order, k) <= CELLS:
        return FoldForests(features, _grown_alone(rows, growths, spans, order, edges, starts, k, train_role, val_role), edges)
    state = _write(spark, rows.mapInArrow(_blocks(spans, order, edges, starts, k, train_role, val_role), BLOCK)).rdd.map(tuple)
    work = sum(len(names) * sum(starts[f][1:]) for f, names in order.items() if names)
    state = state.coalesce(max(1, -(-work // TASK_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)
    while any(not g.done for g in growths):
        active = [g for g in growths if not g.done]
        parents = moved = None
        if any(len(g.trees) > g.written for g in active):
            before, moved = state, state.mapPartitions(_moved(_pending(active), order, k)).persist(StorageLevel.MEMORY_AND_DISK)
            state = moved
            for g in active:
                g.written = len(g.trees)
            if active[0].written % rewrite_every == 0:
                state.checkpoint()
        for depth in range(max(g.member.config.max_depth for g in active)):
            if depth == 0:
                for g in active:
                    g.splits, g.totals, g.open = {}, {}, [0]
            jobs = {g.member.name: g for g in active if g.open and depth < g.member.config.max_depth}
            if not jobs:
                break
            above = parents
            found, parents = _level(state, jobs, order, parents, depth, k, loss)
            for r in found:
                _choose(growths, r, depth)
            _dropped(above)
            if depth == 0 and moved is not None:
                before.unpersist()
            for g in active:  # those that stop now forget the tree they began
                if depth == 0 and g.done:
                    g.trees, g.open = g.trees[:g.best_trees], []
            active = [g for g in active if not g.done]
        _dropped(parents)
        for g in active:
            _finish(g)
    state.unpersist()
    return FoldForests(features, growths, edges)


# ---- few cells --------------------------------------------------------------------------------

def _bounds(edges: dict, fold: int, k: int) -> list[np.ndarray]:
    return [edges.get((fold, i), np.empty(0)) for i in range(k)]


def _cells(edges: dict, order: dict[int, list[int]], k: int) -> int:
    """The most cells, that is combinations of bins, of a fold."""
    return max([int(np.prod([len(b) + 1.0 for b in _bounds(edges, f, k)])) for f, names in order.items() if names], default=0)


def _codes(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """The cell of each row: its bins as digits."""
    code = np.zeros(len(x), np.int64)
    for i, b in enumerate(bounds):
        code = code * (len(b) + 1) + np.where(np.isnan(x[:, i]), 0, np.searchsorted(b, x[:, i], side="left"))
    return code


def _cell_bins(cells: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(cells), len(bounds)), np.int64)
    for i in reversed(range(len(bounds))):
        cells, out[:, i] = np.divmod(cells, len(bounds[i]) + 1)
    return out


def _grown_alone(rows: DataFrame, growths: list[Growth], spans: Spans, order: dict, edges: dict, starts: dict, k: int, train: str, val: str) -> list[Growth]:
    """Forests of the squared error from cells: trees see bins only, so rows of one cell always share their prediction, and their number,
    mean target and squared deviations give the sums of gradients and the losses of all of them. One pass adds them up; a fold's cells
    are few, so each member grows in one task of its own."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, y, at = _numbers(batch, k), batch.column("y").to_numpy(), batch.column("at").to_numpy(zero_copy_only=False)
            for fold, names in order.items():
                is_val = _in_spans(at, spans, fold, val) if names else np.zeros(len(at), bool)
                for role, seen in enumerate((_in_spans(at, spans, fold, train) & ~is_val, is_val) if names else ()):
                    if not seen.any():
                        continue
                    bounds = _bounds(edges, fold, k)
                    code, e = _codes(x[seen], bounds), y[seen] - starts[fold][0]
                    size = int(np.prod([len(b) + 1 for b in bounds]))
                    sums = np.stack([np.bincount(code, None, size), np.bincount(code, e, size), np.bincount(code, e * e, size)])
                    held[fold, role] = held.get((fold, role), 0) + sums
        for (fold, role), sums in held.items():
            cell = np.flatnonzero(sums[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), v), kind) for v, kind in ((fold, pa.int32()), (role, pa.int32()))] + [pa.array(cell)]
                                             + [pa.array(s[cell]) for s in sums], ["fold", "role", "cell", "n", "s", "q"])

    sums = rows.mapInArrow(fill, "fold int, role int, cell long, n double, s double, q double").groupBy("fold", "role", "cell").agg(*[F.sum(c).alias(c) for c in "nsq"])
    by_fold = sums.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("role", "cell", "n", "s", "q"))).alias("cells"))
    width = max(g.member.config.max_bins for g in growths)
    names = rows.sparkSession.createDataFrame([(g.member.fold, i) for i, g in enumerate(growths)], "fold int, number int")
    dealt = by_fold.join(F.broadcast(names), "fold").repartition(len(growths), "number")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, number, cells in zip(*[batch.column(c) for c in ("fold", "number", "cells")], strict=True):
                role, cell, n, s, q = (cells.values.field(c).to_numpy() for c in ("role", "cell", "n", "s", "q"))
                bins = _cell_bins(cell, _bounds(edges, fold.as_py(), k))
                g = _grow_cells(growths[number.as_py()], role == 0, bins, n, s, q, width)
                yield pa.RecordBatch.from_arrays([pa.array([number.as_py()], pa.int32()), pa.array([pickle.dumps(g)], pa.binary())], ["number", "body"])

    found = dealt.select("fold", "number", "cells").mapInArrow(grow, "number int, body binary").collect()  # models only
    done = {r["number"]: pickle.loads(r["body"]) for r in found}
    return [done[i] for i in range(len(growths))]


def _grow_cells(g: Growth, train: np.ndarray, bins: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, width: int) -> Growth:
    """Grow one member on its fold's cells: rows, sum and squared sum of the targets less the starting value."""
    config, k = g.member.config, bins.shape[1]
    mean, p = s / n, np.zeros(len(n))  # both less the starting value
    spread = np.maximum(q - s * mean, 0)
    total = lambda cost, here: (cost[here].sum(), n[here].sum())
    own, weight = bins[train], n[train]
    while not g.done:
        cost = spread + n * (p - mean) ** 2
        (a, a_n), (b, b_n) = total(cost, train), total(cost, ~train)
        _judge(g, float(a / a_n), float(b / b_n) if b_n else None)
        if g.done:
            g.trees = g.trees[:g.best_trees]
            break
        gradient, used = (2 * n * (p - mean))[train], _drawn_features(config, len(g.trees), k)
        g.splits, g.totals, g.open = {}, {}, [0]
        node, hists = np.zeros(len(own), np.int64), {}
        for depth in range(config.max_depth):
            if not g.open:
                break
            fresh = {}
            for parent in sorted({(m - 1) // 2 for m in g.open}) if depth else [-1]:
                a, b = 2 * parent + 1, 2 * parent + 2
                small = 0 if not depth else a if g.totals[a][2] <= g.totals[b][2] else b
                here = np.flatnonzero(node == small)
                fresh[small] = _weighted_histogram(own[here], gradient[here], weight[here], width)
                if depth:
                    fresh[a + b - small] = hists[parent] - fresh[small]
            hists = fresh
            for m in list(g.open):
                _choose([g], dict(zip(LEVEL, _best(g.member.name, m, hists[m].reshape(k, width, 3), config, used), strict=True)), depth)
            feature, cut, _ = g.arrays({"splits": g.splits, "leaves": {}})
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (own[np.arange(len(own)), np.maximum(f, 0)] > cut[node]), node)
        _finish(g)
        p = _predicted(p, bins, config.learning_rate, config.max_depth, [g.arrays(g.trees[-1])])
    return g


def _weighted_histogram(bins: np.ndarray, g: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """``_histogram`` of cells of ``n`` rows, whose hessians are 2."""
    out = np.empty((bins.shape[1], width, 3))
    for i in range(bins.shape[1]):
        b = bins[:, i]
        out[i, :, 0], out[i, :, 2] = np.bincount(b, g, width), np.bincount(b, n, width)
        out[i, :, 1] = 2 * out[i, :, 2]
    return out.ravel()


# ---- blocks -----------------------------------------------------------------------------------

BLOCK = "fold int, block bigint, val binary, bins binary, y binary, p binary"


def _write(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fold_bins(rows: DataFrame, spans: Spans, folds: list[int], k: int, num_bins: int, capacity: int, train: str, val: str, exact: bool):
    """Boundaries per (fold, feature) from sketches, and (mean target, training rows, validation rows) per fold: one pass. With ``exact``,
    those whose sketch does not hold all distinct values come from a sort of them."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Distinct] = {}
        sums: dict[int, np.ndarray] = {f: np.zeros(3) for f in folds}
        for batch in batches:
            x, y, at = _numbers(batch, k), batch.column("y").to_numpy(), batch.column("at").to_numpy(zero_copy_only=False)
            for fold in folds:
                seen = _in_spans(at, spans, fold, train)
                sums[fold] += y[seen].sum(), seen.sum(), _in_spans(at, spans, fold, val).sum()
                for i in range(k if seen.any() else 0):
                    held.setdefault(f"{fold} {i}", Distinct(capacity)).add(x[seen, i])
        if held:
            yield packed(held)
        for fold, s in sums.items():  # sums travel as bodies under names of their own; every task's differ by its number
            yield pa.RecordBatch.from_arrays([pa.array([f"sum {fold}"]), pa.array([0], pa.decimal128(20, 0)), pa.array([s.tobytes()], pa.binary())],
                                             ["name", "cut", "body"])

    parts = _write(rows.sparkSession, rows.mapInArrow(fill, PARTS))
    edges: dict[tuple[int, int], np.ndarray] = {}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bounds, whole = [], [], []
            for name, values, limit in unpacked(batch):
                names.append(name)
                bounds.append((Distinct(capacity, limit, values).boundaries(num_bins) if len(values) else np.empty(0)).tobytes())
                whole.append(limit == EVERY)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bounds, pa.binary()), pa.array(whole, pa.bool_())], ["name", "bounds", "whole"])

    is_sum = F.col("name").startswith("sum ")
    wide: dict[int, list[int]] = {}  # feature -> folds whose sketch is a sample
    for r in merged(parts.filter(~is_sum), capacity).mapInArrow(cut, "name string, bounds binary, whole boolean").collect():  # at most 255 numbers a row
        fold, i = map(int, r["name"].split())
        edges[fold, i] = np.frombuffer(r["bounds"])
        if exact and not r["whole"]:
            wide.setdefault(i, []).append(fold)
    together = sorted({f for fs in wide.values() for f in fs})
    for at in range(0, len(together), MASKED):
        some = together[at:at + MASKED]
        edges |= _exact_edges(rows, spans, {i: [f for f in fs if f in some] for i, fs in wide.items()}, some, k, num_bins, train)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, s, _ in unpacked(batch):
                held[name] = held.get(name, 0) + s
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([s.tolist() for s in held.values()], pa.list_(pa.float64()))], ["name", "s"])

    starts = {}
    for r in parts.filter(is_sum).repartition("name").mapInArrow(add, "name string, s array<double>").collect():
        total, n, n_val = r["s"]
        if n:
            starts[int(r["name"].split()[1])] = (total / n, int(n), int(n_val))
    return edges, starts


def _exact_edges(rows: DataFrame, spans: Spans, wanted: dict[int, list[int]], folds: list[int], k: int, num_bins: int, train: str) -> dict[tuple[int, int], np.ndarray]:
    """Boundaries of the wanted (feature -> folds) at exact ranks of the distinct training values.

    A value has one row with a bit per fold that holds it, however many folds overlap. The values are cut into intervals of their order;
    counts per (interval, fold) say in which interval a rank lies, and only those intervals are sorted, one in a task.
    """
    bit = {f: i for i, f in enumerate(folds)}

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _numbers(batch, k), batch.column("at").to_numpy(zero_copy_only=False)
            seen = {f: _in_spans(at, spans, f, train).astype(np.int64) << bit[f] for f in folds}
            for i, fs in wanted.items():
                mask = np.zeros(len(at), np.int64)
                for f in fs:
                    mask |= seen[f]
                kept = (mask != 0) & ~np.isnan(x[:, i])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(kept.sum()), i, np.int32)), pa.array(x[kept, i] + 0.0), pa.array(mask[kept])], ["feature", "x", "mask"])

    values = rows.mapInArrow(masks, "feature int, x double, mask long").groupBy("feature", "x").agg(F.bit_or("mask").alias("mask"))
    cells = ranged(values, ["feature"], ["x"])
    held = {(f, i): F.count_if((F.col("feature") == i) & (F.col("mask").bitwiseAND(1 << bit[f]) != 0)) for i, fs in wanted.items() for f in fs}
    counts = cells.groupBy("__cell").agg(*[c.alias(f"{f} {i}") for (f, i), c in held.items()]).orderBy("__cell").collect()
    sizes, picks = {}, {}  # distinct values of a key, and the wanted ranks inside each interval
    for f, i in held:
        below = np.concatenate([[0], np.cumsum([r[f"{f} {i}"] for r in counts])])
        sizes[f, i] = u = int(below[-1])
        ranks = np.unique(np.floor(np.arange(1, num_bins) / num_bins * (u - 1)).astype(np.int64)) if u >= num_bins else np.arange(u)
        home = np.searchsorted(below, ranks, side="right") - 1
        for c in np.unique(home):
            picks.setdefault(counts[c]["__cell"], []).append((f, i, (ranks[home == c] - below[c]).tolist()))

    def pick(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("x")
        feature, x, mask = (cell.column(c).to_numpy() for c in ("feature", "x", "mask"))
        found = [(f, i, x[(feature == i) & (mask >> bit[f] & 1 == 1)][at].tobytes()) for f, i, at in picks[cell.column("__cell")[0].as_py()]]
        return pa.Table.from_arrays([pa.array([r[j] for r in found], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["fold", "feature", "xs"])

    got: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in cells.filter(F.col("__cell").isin(list(picks))).groupBy("__cell").applyInArrow(pick, "fold int, feature int, xs binary").collect():  # at most 255 numbers a key
        got.setdefault((r["fold"], r["feature"]), []).append(np.frombuffer(r["xs"]))
    found = {key: np.sort(np.concatenate(xs)) for key, xs in got.items()}
    return {key: xs if sizes[key] >= num_bins else Distinct(values=xs).boundaries(num_bins) for key, xs in found.items()}


def _blocks(spans: Spans, order: dict[int, list[int]], edges: dict, starts: dict, k: int, train: str, val: str):
    """Rows to blocks: one per fold and batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            x, y, at = _numbers(batch, k), batch.column("y").to_numpy(), batch.column("at").to_numpy(zero_copy_only=False)
            out = []
            for fold, names in order.items():
                is_val = _in_spans(at, spans, fold, val)
                seen = _in_spans(at, spans, fold, train) | is_val
                if not names or not seen.any():
                    continue
                bins = np.zeros((int(seen.sum()), k), np.uint8)
                for i in range(k):
                    v = x[seen, i]
                    bins[:, i] = np.where(np.isnan(v), 0, np.searchsorted(edges.get((fold, i), np.empty(0)), v, side="left"))
                p = np.full((len(names), len(bins)), starts[fold][0])
                out.append((fold, number, is_val[seen].tobytes(), bins.tobytes(), y[seen].tobytes(), p.tobytes()))
            yield _block_batch(out)

    return work


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["fold", "block", "val", "bins", "y", "p"])


def _each_block(blocks: Iterator[tuple], order: dict[int, list[int]], k: int):
    for fold, block, val, bins, y, p in blocks:
        yield (fold, block, np.frombuffer(val, bool), np.frombuffer(bins, np.uint8).reshape(-1, k), np.frombuffer(y),
               dict(zip(order[fold], np.frombuffer(p).reshape(len(order[fold]), -1), strict=True)))


Trees = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _pending(growths: Sequence[Growth]) -> dict[int, tuple[float, int, Trees]]:
    """Per member, the trees that the kept predictions don't hold yet."""
    return {g.member.name: (g.member.config.learning_rate, g.member.config.max_depth, [g.arrays(t) for t in g.trees[g.written:]]) for g in growths}


def _nodes(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node where each row stands after ``depth`` levels: bins up to the cut go left."""
    node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (bins[every, np.maximum(f, 0)] > cut[node]), node)
    return node


def _predicted(p: np.ndarray, bins: np.ndarray, rate: float, depth: int, trees: Trees) -> np.ndarray:
    for feature, cut, value in trees:
        p = p + rate * value[_nodes(bins, feature, cut, depth)]
    return p


def _moved(pending: dict, order: dict[int, list[int]], k: int):
    """Blocks with the predictions of the pending trees added; those whose members are all done are left out."""
    def work(blocks: Iterator[tuple]) -> Iterator[tuple]:
        for fold, block, val, bins, y, p in _each_block(blocks, order, k):
            if any(m in pending for m in order[fold]):
                new = [_predicted(p[m], bins, *pending[m]) if m in pending else p[m] for m in order[fold]]
                yield fold, block, val.tobytes(), bins.tobytes(), y.tobytes(), np.array(new).tobytes()

    return work


LEVEL = ("member", "node", "hist", "gain", "g", "h", "gl", "hl", "n", "nl", "feature", "bin")
WHOLE, SMALL, LOSSES = 0, 1, 2


def _without_hist(r: tuple) -> dict:
    return {name: v for name, v in zip(LEVEL, r, strict=True) if name != "hist"}


Hists = RDD | dict[tuple[int, int], bytes] | None


def _dropped(hists: Hists) -> None:
    if isinstance(hists, RDD):
        hists.unpersist()


def _level(state: RDD, jobs: dict[int, Growth], order: dict, parents: Hists, depth: int, k: int, loss: ArrayLoss) -> tuple[list[dict], Hists]:
    """Best splits of all open nodes of all members, at depth 0 also the losses of the trees before (node -1), and the histograms.

    Where the arrays of all tasks take ``COLLECTED`` bytes at most, they are added up on the driver, without a shuffle.
    """
    width = max(g.member.config.max_bins for g in jobs.values())
    settings = {m: g.member.config for m, g in jobs.items()}
    growing = {m: g.arrays({"splits": g.splits, "leaves": {}})[:2] for m, g in jobs.items()}
    number = {m: len(g.trees) for m, g in jobs.items()}
    small: dict[int, dict[int, int]] = {}  # counted child -> parent
    for m, g in jobs.items():
        small[m] = {}
        for parent in {(n - 1) // 2 for n in g.open} if depth else ():
            a, b = 2 * parent + 1, 2 * parent + 2
            small[m][a if g.totals[a][2] <= g.totals[b][2] else b] = parent
    used = {m: _drawn_features(settings[m], number[m], k) for m in jobs}

    def count(blocks: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for fold, block, val, bins, y, p in _each_block(blocks, order, k):
            train = ~val
            for m in [m for m in order[fold] if m in jobs_names]:
                cost, g, h = loss(y, p[m])
                if depth == 0:
                    held[m, -1, LOSSES] = held.get((m, -1, LOSSES), 0) + np.array([cost[train].sum(), train.sum(), cost[val].sum(), val.sum()])
                rows = train if settings[m].subsample_row >= 1 else train & _drawn_rows(settings[m], number[m], block, len(y))
                own = bins[rows]
                node = _nodes(own, *growing[m], depth)
                for child, parent in (small[m] if depth else {0: -1}).items():
                    here = node == child
                    key = (m, parent, SMALL if depth else WHOLE)
                    held[key] = held.get(key, 0) + _histogram(own[here], g[rows][here], h[rows][here], width)
            if sum(a.nbytes for a in held.values()) > HELD:
                yield from _partials(held)
                held = {}
        yield from _partials(held)

    jobs_names = set(jobs)
    split = {(m, n) for m in jobs for n in small[m].values()} if depth else set()
    is_open = {(m, n) for m, g in jobs.items() for n in g.open}

    def decide(found: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for (m, parent), (kind, body) in found:
            held[m, parent, kind] = held.get((m, parent, kind), 0) + np.frombuffer(body)
        for (m, parent, kind), flat in held.items():
            if kind == LOSSES:
                yield m, -1, b"", *map(float, flat), 0.0, 0, 0, 0, 0
            elif depth == 0:
                yield _best(m, 0, flat.reshape(k, width, 3), settings[m], used[m])
            elif kind == SMALL:
                child = next(c for c, p in small[m].items() if p == parent)
                hist = flat.reshape(k, width, 3)
                rest = held[m, parent, WHOLE].reshape(k, width, 3) - hist
                sibling = child + 1 if child % 2 else child - 1
                yield from (_best(m, n, a, settings[m], used[m]) for n, a in ((child, hist), (sibling, rest)) if (m, n) in is_open)

    groups = sum(max(1, len(small[m])) for m in jobs)
    parts, size = state.mapPartitions(count), groups * k * width * 24
    if not isinstance(parents, RDD):
        kept = [(key, (WHOLE, parents[key])) for key in split]
        if size * parts.getNumPartitions() <= COLLECTED:
            out = list(decide(iter([*parts.collect(), *kept])))
            return [_without_hist(r) for r in out], {(r[0], r[1]): r[2] for r in out}
        parts = parts.union(state.context.parallelize(kept)) if kept else parts
    else:
        parts = parts.union(parents.filter(lambda r: (r[0], r[1]) in split).map(lambda r: ((r[0], r[1]), (WHOLE, r[2]))))
    tasks = max(1, min(groups, size * 3 // REDUCED))  # a parent, its child and the sibling
    dealt = parts.partitionBy(tasks, lambda key: key[0] * 8191 + key[1])
    out = dealt.mapPartitions(decide).persist(StorageLevel.MEMORY_AND_DISK)
    return out.map(_without_hist).collect(), out


def _drawn_features(config: BoostConfig, tree: int, k: int) -> np.ndarray:
    if config.subsample_col >= 1:
        return np.ones(k, bool)
    picked = np.random.default_rng((config.seed, tree)).choice(k, max(1, int(k * config.subsample_col)), replace=False)
    return np.isin(np.arange(k), picked)


def _drawn_rows(config: BoostConfig, tree: int, block: int, n: int) -> np.ndarray:
    return np.random.default_rng((config.seed, tree, block)).random(n) < config.subsample_row


def _histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Sums of g, h and rows per (feature, bin), flat."""
    out = np.empty((bins.shape[1], width, 3))
    for i in range(bins.shape[1]):
        b = bins[:, i]
        out[i, :, 0], out[i, :, 1], out[i, :, 2] = np.bincount(b, g, width), np.bincount(b, h, width), np.bincount(b, None, width)
    return out.ravel()


def _partials(held: dict[tuple[int, int, int], np.ndarray]) -> Iterator[tuple]:
    for (m, parent, kind), a in held.items():
        yield (m, parent), (kind, a.tobytes())


def _best(m: int, node: int, hist: np.ndarray, config: BoostConfig, used: np.ndarray) -> tuple:
    """The first best (feature, bin) of a node: rows in bins up to ``bin`` go left. -1 where nothing can be split."""
    left = hist.cumsum(axis=1)
    total = left[:, -1:, :]
    right = total - left
    score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + config.lambda_l2, 1e-300)
    gain = score(left) - score(total) + score(right) - config.gamma
    counts = np.rint(left[..., 2])
    ok = (left[..., 1] > 0) & (right[..., 1] > 0) & (counts > 0) & (counts < np.rint(total[..., 2])) & used[:, None]
    for f, way in config.monotone.items():
        a, b = (-s[f, :, 0] / (s[f, :, 1] + config.lambda_l2) for s in (left, right))
        ok[f] &= a <= b if way > 0 else a >= b
    gain = np.where(ok, gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    g, h, n = total[f, 0]
    if not ok[f, b]:
        return m, node, hist.tobytes(), -1.0, float(g), float(h), 0.0, 0.0, round(n), 0, -1, -1
    return m, node, hist.tobytes(), *map(float, (gain[f, b], g, h, left[f, b, 0], left[f, b, 1])), round(n), round(left[f, b, 2]), int(f), int(b)


def _choose(growths: list[Growth], r: dict, depth: int) -> None:
    """Take in one row of a level: losses of the trees so far, or the best split of a node."""
    g = next(x for x in growths if x.member.name == r["member"])
    config = g.member.config
    if r["node"] == -1:
        train, n, val, n_val = r["gain"], r["g"], r["h"], r["gl"]
        _judge(g, train / n, val / n_val if n_val else None)
        return
    node, n, nl = r["node"], r["n"], r["nl"]
    g.totals.setdefault(node, (r["g"], r["h"], n))
    g.open = [o for o in g.open if o != node]
    if r["feature"] < 0 or r["gain"] <= config.min_gain or min(nl, n - nl) < config.min_samples_leaf:
        return
    g.splits[node] = r["feature"], r["bin"], r["gain"]
    g.totals[2 * node + 1] = r["gl"], r["hl"], nl
    g.totals[2 * node + 2] = r["g"] - r["gl"], r["h"] - r["hl"], n - nl
    if depth + 1 < config.max_depth:
        g.open += [c for c in (2 * node + 1, 2 * node + 2) if g.totals[c][2] >= 2 * max(config.min_samples_leaf, 1)]


def _judge(g: Growth, train: float, val: float | None) -> None:
    config, trees = g.member.config, len(g.trees)
    g.losses.append((train, val))
    if trees == 0 and config.num_trees > 0:
        return
    if val is None or not config.early_stopping:
        g.best_trees, g.done = trees, trees >= config.num_trees
        return
    if val < g.best - config.tolerance:
        g.best, g.best_trees, g.waited = val, trees, 0
    else:
        g.waited += 1
    g.done = g.waited >= config.early_stopping or trees >= config.num_trees


def _finish(g: Growth) -> None:
    config = g.member.config
    leaves = {}
    for node, (grad, hess, _) in g.totals.items():
        if node not in g.splits:
            den = hess + config.lambda_l2
            leaves[node] = 0.0 if den <= 1e-20 else float(-np.sign(grad) * max(abs(grad) - config.lambda_l1, 0) / den)
    g.trees.append({"splits": dict(g.splits), "totals": dict(g.totals), "leaves": leaves})


def score_forests(
    df: DataFrame, forests: FoldForests, folds: DataFrame, *, idx: str = "date_idx", test_role: str = "val", out: str = "pred", by_member: bool = False,
) -> DataFrame:
    """Rows inside a test span with ``out`` and ``fold``: of overlapping spans the latest fold with a forest scores a row. With
    ``by_member`` every member scores its fold's rows: one row per (row, member), with ``member`` and ``fold``. No shuffle."""
    spans, k = _spans(folds), len(forests.features)
    packs = []
    for m in sorted(forests.members, key=lambda m: m.member.fold):
        trees = []
        for tree in m.trees:
            feature, cut, value = m.arrays(tree)
            split = np.array([forests.edges[m.member.fold, f][b] if f >= 0 else 0.0 for f, b in zip(feature, cut, strict=True)])
            trees.append((feature, split, value))
        bounds, table = _bounds(forests.edges, m.member.fold, k), None
        if _cells(forests.edges, {m.member.fold: [m.member.name]}, k) <= CELLS:  # one number per cell instead of all trees
            bins = _cell_bins(np.arange(int(np.prod([len(b) + 1 for b in bounds]))), bounds)
            table = _predicted(np.full(len(bins), m.init), bins, m.member.config.learning_rate, m.member.config.max_depth, [m.arrays(t) for t in m.trees])
            trees = []
        packs.append((m.member.name, m.member.fold, m.init, m.member.config.learning_rate, m.member.config.max_depth, trees, bounds, table))
    names = df.columns
    added = [T.StructField("member", T.IntegerType())] * by_member + [T.StructField("fold", T.IntegerType()), T.StructField(out, T.DoubleType())]
    new = {f.name for f in added}
    others = [c for c in names if c not in new]
    features = [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"_x{i}") for i, f in enumerate(forests.features)]
    rows = df.select(*features, F.col(idx).cast("bigint").alias("_at"), *others)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _numbers(batch, k), batch.column("_at").to_numpy(zero_copy_only=False)
            pred, member, fold = np.zeros(len(at)), np.full(len(at), -1), np.full(len(at), -1)
            for name, f, init, rate, depth, trees, bounds, table in packs:
                here = np.flatnonzero(_in_spans(at, spans, f, test_role))
                if not len(here):
                    continue
                pred[here], member[here], fold[here] = init if table is None else table[_codes(x[here], bounds)], name, f
                for feature, split, value in trees:
                    pred[here] += rate * value[_value_nodes(x[here], feature, split, depth)]
                if by_member:
                    yield _scored(batch, here, k, [member[here], fold[here]], pred[here], [*others, *new_order])
            if not by_member:
                here = np.flatnonzero(fold >= 0)
                yield _scored(batch, here, k, [fold[here]], pred[here], [*others, *new_order])

    new_order = [f.name for f in added]
    return rows.mapInArrow(work, T.StructType([*[df.schema[c] for c in others], *added]))


def _scored(batch: pa.RecordBatch, here: np.ndarray, k: int, ids: list[np.ndarray], pred: np.ndarray, names: list[str]) -> pa.RecordBatch:
    kept = batch.take(pa.array(here))
    return pa.RecordBatch.from_arrays([*kept.columns[k + 1:], *[pa.array(i, pa.int32()) for i in ids], pa.array(pred)], names)


def _value_nodes(x: np.ndarray, feature: np.ndarray, split: np.ndarray, depth: int) -> np.ndarray:
    """As ``_nodes``, over values: null and x <= split go left."""
    node, every = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        v = x[every, np.maximum(f, 0)]
        node = np.where(f >= 0, 2 * node + 1 + (v > split[node]), node)
    return node


#: Settings of the reference runs: trees, depth, step, and how long the validation loss may not sink.
STUDY = BoostConfig(num_trees=300, max_depth=4, learning_rate=0.03, early_stopping=30)


def walk_forward_trees(
    df: DataFrame, folds: DataFrame, features: Sequence[str], y: str, config: BoostConfig = STUDY, *, idx: str = "date_idx", test_role: str = "val",
) -> tuple[DataFrame, FoldForests]:
    """Out-of-sample predictions of boosted trees stitched from all folds, and the forests."""
    members = [Member(r["fold"], r["fold"], config) for r in folds.select("fold").distinct().orderBy("fold").collect()]
    forests = grow_forests(df, folds, features, y, members, idx=idx, val_role=test_role)
    return score_forests(df, forests, folds, idx=idx, test_role=test_role), forests


def tune_by_sharpe(
    df: DataFrame, folds: DataFrame, features: Sequence[str], y: str, grid: Sequence[tuple[int, int, float]] = GBT_GRID, early_stopping: int = 30, *,
    idx: str = "date_idx", test_role: str = "val", time: str = "date",
) -> tuple[DataFrame, FoldForests | None]:
    """The validation long-short Sharpe of each (trees, depth, step) of the grid, best first, and the forest of the best point.

    ``folds`` has one fold. All points grow together and stop early on the validation rows, which then also rank them. There is no
    forest where the fold is too short.
    """
    fold = folds.select("fold").first()["fold"]
    members = [Member(i, fold, BoostConfig(num_trees=t, max_depth=d, learning_rate=s, early_stopping=early_stopping)) for i, (t, d, s) in enumerate(grid)]
    forests = grow_forests(df, folds, features, y, members, idx=idx, val_role=test_role)
    scored = score_forests(df, forests, folds, idx=idx, test_role=test_role, by_member=True)
    scored = _write(df.sparkSession, scored.select("member", "symbol", time, y, "pred"))
    daily = long_short_daily(scored, "pred", y, by=("member",), time=time)
    points = df.sparkSession.createDataFrame([(i, t, d, s) for i, (t, d, s) in enumerate(grid)], "member int, trees int, max_depth int, step double")
    grown = df.sparkSession.createDataFrame([(g.member.name, len(g.trees)) for g in forests.members], "member int, grown int")
    table = long_short_summary(daily, by=("member",), time=time).join(F.broadcast(points.join(grown, "member")), "member").orderBy(F.desc("sharpe"), "member")
    top = table.select("member").first()  # one row
    best = [g for g in forests.members if top is not None and g.member.name == top["member"]]
    return table, FoldForests(forests.features, best, forests.edges) if best else None
