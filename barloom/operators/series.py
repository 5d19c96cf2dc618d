"""Whole-series methods: unit-root tests, wavelet denoising and volatility fits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.functions.columns import lit
from barloom.functions.grouping import along_time, attach, group_stats, longest_group, positions, quantiles
from barloom.operators.rolling import ema, ema_rows, ffd_weights, frac_diff, weighted_past
from barloom.session import rows_per_task

KEY, TIME = ("symbol",), "date"


# ---- unit roots ----------------------------------------------------------------------

# 1 %, 5 % and 10 % critical values by number of observations (constant, no trend).
ADF_SIZES = (25, 50, 100, 250, 500)
ADF_CRITICAL = ((-3.75, -3.00, -2.63), (-3.58, -2.93, -2.60), (-3.51, -2.89, -2.58),
                (-3.46, -2.88, -2.57), (-3.44, -2.87, -2.57), (-3.43, -2.86, -2.57))


def adf_p(t: float, n_obs: int) -> float:
    """p value interpolated between the critical values; 0.001 from twice the 1 % one down, 0.5 above the 10 % one."""
    c1, c5, c10 = ADF_CRITICAL[int(np.searchsorted(ADF_SIZES, n_obs))]
    return float(np.interp(t, (2 * c1, c1, c5, c10), (0.001, 0.01, 0.05, 0.10), right=0.5))


def _solve_adf(gram: np.ndarray) -> tuple[float, float]:
    """t statistic and p value from the cross products of (1, level, lags..., change)."""
    k = int(round(len(gram) ** 0.5))
    g = np.asarray(gram).reshape(k, k)
    xx, xy, yy, n = g[:-1, :-1], g[:-1, -1], g[-1, -1], int(round(g[0, 0]))
    if np.linalg.matrix_rank(xx) < k - 1:
        return 0.0, 1.0
    beta = np.linalg.solve(xx, xy)
    spread = (yy - beta @ xy) / (n - (k - 1)) * np.linalg.inv(xx)[1, 1]
    if spread < 1e-30:
        return 0.0, 0.0
    t = float(beta[1] / np.sqrt(spread))
    return t, adf_p(t, n)


def adf_test(df: DataFrame, col: str, *, by: Sequence[str] = KEY, time=TIME) -> DataFrame:
    """Augmented Dickey-Fuller t statistic and p value per key: constant, floor(cbrt(n-1)) lags.

    The regression is fitted from cross products that tasks add up locally, so no task
    needs a whole series.
    """
    rows = group_stats(df.filter(F.col(col).isNotNull()).select(*by, time, col), by, _n=F.count(F.lit(1)), _m=F.avg(col))
    lag = F.least(F.greatest(F.floor(F.cbrt((F.col("_n") - 1).cast("double")) + 1e-9), F.lit(1)), F.floor((F.col("_n") - 1) / 3)).cast("int")
    rows = rows.withColumn("_k", lag)
    usable = (F.col("_n") >= 10) & (F.col("_n") - 1 - F.col("_k") > F.col("_k") + 2)
    sizes = rows.agg(F.max("_n")).first()[0] or 0
    widest = max(1, int(np.cbrt(sizes)) + 1)
    vec = along_time(
        rows.filter(usable),
        {"_lvl": lambda t: F.lag(col).over(t.w), "_d": lambda t: F.col(col) - F.lag(col).over(t.w), "_p": lambda t: t.pos},
        {"_past": lambda t: F.reverse(F.collect_list("_d").over(t.between(-widest, -1)))},
        by=by, time=time, back=widest + 1,
    ).filter(F.col("_p") > F.col("_k"))
    # Levels around their mean: the constant takes up the shift, and sums of squares keep their digits.
    row = F.concat(F.array(lit(1), F.col("_lvl") - F.col("_m")), F.slice("_past", 1, F.col("_k")), F.array(F.col("_d")))
    keys = [f for f in df.schema.fields if f.name in by]
    schema = T.StructType([*keys, T.StructField("gram", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(list(by), sort=False):
                x = np.stack(part["v"].to_numpy())
                out.append((*key, (x.T @ x).ravel()))
            yield pd.DataFrame(out, columns=[*by, "gram"])

    parts = vec.select(*by, row.alias("v")).mapInPandas(partial, schema)
    cells = parts.select(*by, F.posexplode("gram").alias("i", "v")).groupBy(*by, "i").agg(F.sum("v").alias("v"))
    grams = cells.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("gram"))

    @F.pandas_udf("t_stat double, p_value double")
    def solve(gs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_solve_adf(g) for g in gs], columns=["t_stat", "p_value"])

    solved = grams.select(*by, solve("gram").alias("_s")).select(*by, "_s.*")
    every = rows.groupBy(*by).agg(F.max("_n").alias("n"))
    return attach(every, solved, by).withColumns({
        "t_stat": F.coalesce("t_stat", lit(0)), "p_value": F.coalesce("p_value", lit(1))})


def find_min_d(
    df: DataFrame, col: str, max_d: float = 1.0, step: float = 0.05, p_threshold: float = 0.05, threshold: float = 1e-5,
    *, by: Sequence[str] = KEY, time=TIME,
) -> DataFrame:
    """Smallest order on the grid whose fractional difference passes the unit-root test, else ``max_d``.

    Series that a task may hold stream by, each differenced and tested as an array; longer ones take ``frac_diff`` and ``adf_test``.
    """
    grid = np.linspace(0.0, max_d, int(round(max_d / step)) + 1)
    base = df.select(*by, time, F.col(col).cast("double").alias("_x"))
    longest = longest_group(base, by)
    most = rows_per_task(df.sparkSession)
    if longest <= most:
        return _streamed_min_d(positions(base, by, time, "_i", longest=longest), grid, max_d, p_threshold, threshold, by, time)
    sized = group_stats(base, by, _n=F.count(F.lit(1)))
    short = positions(sized.filter(F.col("_n") <= most).drop("_n"), by, time, "_i", longest=most)
    few = _streamed_min_d(short, grid, max_d, p_threshold, threshold, by, time)
    base = sized.filter(F.col("_n") > most).drop("_n")
    parts = [frac_diff(base, "_x", float(d), threshold, "_y", by=by, time=time).select(
        *by, time, F.lit(float(d)).alias("_order"), "_y") for d in grid]
    long = reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("_y").isNotNull())
    tests = adf_test(long, "_y", by=[*by, "_order"], time=time)
    passed = tests.filter((F.col("n") >= 20) & (F.col("p_value") < p_threshold)).groupBy(*by).agg(F.min("_order").alias("min_d"))
    return attach(base.select(*by).distinct(), passed, by).withColumn("min_d", F.coalesce("min_d", lit(max_d))).unionByName(few)


def _differenced(x: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """``weighted_past`` of one series, without the rows that have none; NaN is null."""
    if len(weights) > 128:  # its frames read null as 0
        x = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)
    y = np.convolve(x, weights, "valid") if len(x) >= len(weights) else np.empty(0)
    return y[~np.isnan(y)]


def adf_array(x: np.ndarray) -> tuple[float, float]:
    """``adf_test`` of one series without nulls."""
    n = len(x)
    k = min(max(int(np.floor(np.cbrt(float(n - 1)) + 1e-9)), 1), (n - 1) // 3) if n else 0
    if n < 10 or n - 1 - k <= k + 2:
        return 0.0, 1.0
    d = np.diff(x)
    past = np.lib.stride_tricks.sliding_window_view(d, k + 1)[:, ::-1]  # the change, then the k changes before it
    v = np.column_stack([np.ones(len(past)), x[k:-1] - x.mean(), past[:, 1:], past[:, :1]])
    return _solve_adf((v.T @ v).ravel())


def _streamed_min_d(placed: DataFrame, grid: np.ndarray, max_d: float, p_threshold: float, threshold: float, by: Sequence[str], time: str) -> DataFrame:
    keys = [f for f in placed.schema.fields if f.name in by]
    weights = [ffd_weights(float(d), threshold) if d else [1.0] for d in grid]

    def least(x: np.ndarray) -> float:
        for d, w in zip(grid, weights, strict=True):
            y = _differenced(x, w)
            if len(y) >= 20 and adf_array(y)[1] < p_threshold:
                return float(d)
        return max_d

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in _whole_keys(batches):
            x = batch.column("_x").to_numpy(zero_copy_only=False)
            unknown = _null_keys(batch, by)  # are not tested
            found = [max_d if unknown[a] else least(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            first = pa.array(cuts[:-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name).take(first) for f in keys], pa.array(found, pa.float64())], [*[f.name for f in keys], "min_d"])

    return _keys_in_order(placed, by, time).mapInArrow(work, T.StructType([*keys, T.StructField("min_d", T.DoubleType())])).select(*by, "min_d")


# ---- whole series in a task --------------------------------------------------------------

def _keys_in_order(placed: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Rows whose positions ``_i`` come from one window per key: keys one after the other, each in time order."""
    return placed.sortWithinPartitions(*by, time)


def _null_keys(batch: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    return reduce(np.logical_or, [batch.column(c).is_null().to_numpy(zero_copy_only=False) for c in by], np.zeros(batch.num_rows, bool))


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole keys, and where in them a key begins, with the end; position 0 begins a key."""
    open_: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        one = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return one, np.append(np.flatnonzero(one.column("_i").to_numpy() == 0), one.num_rows)

    for batch in batches:
        begins = np.flatnonzero(batch.column("_i").to_numpy() == 0)
        if not len(begins):
            open_ += [batch] * (batch.num_rows > 0)
            continue
        if open_ or begins[-1] > 0:  # what was open ends here, and all keys of the batch but its last are whole
            yield joined([*open_, batch.slice(0, int(begins[-1]))])
        open_ = [batch.slice(int(begins[-1]))]
    if open_:
        yield joined(open_)


# ---- wavelets ---------------------------------------------------------------------------

# The eight coefficients of the db4 scaling filter.
DB4 = (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385,
       -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278)
TAPS = len(DB4)
REC_LO = np.array(DB4)
REC_HI = np.array([(-1) ** k * DB4[TAPS - 1 - k] for k in range(TAPS)])
DEC_LO, DEC_HI = REC_LO[::-1], REC_HI[::-1]


def _split_level(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One analysis step on (key, i, x): approximation (key, i, x) and detail (key, i, d).

    Both ends are mirrored, then every second output of the two filters is kept.
    """
    edge = TAPS - 1
    sized = group_stats(df, by, _n=F.count(F.lit(1)))
    mirrored = F.array_compact(F.array(
        F.col("i"), F.when(F.col("i") < edge, -1 - F.col("i")),
        F.when(F.col("i") >= F.col("_n") - edge, 2 * F.col("_n") - 1 - F.col("i"))))
    wide = sized.select(*by, "_n", F.explode(mirrored).alias("i"), "x")
    both = along_time(
        wide,
        {"_a": lambda t: weighted_past("x", DEC_LO.tolist(), t, None), "_d": lambda t: weighted_past("x", DEC_HI.tolist(), t, None)},
        by=by, time="i", back=edge)
    kept = both.filter((F.col("i") >= 1) & (F.col("i") % 2 == 1) & (F.floor(F.col("i") / 2) < F.floor((F.col("_n") + edge) / 2)))
    half = F.floor(F.col("i") / 2).cast("long").alias("i")
    return kept.select(*by, half, F.col("_a").alias("x")), kept.select(*by, half, F.col("_d").alias("d"))


def _join_level(approx: DataFrame, detail: DataFrame, by: Sequence[str]) -> DataFrame:
    """One synthesis step: each coefficient adds its eight contributions to the output."""
    both = detail.join(approx, [*by, "i"], "left")  # a longer approximation loses its last value
    sized = group_stats(both, by, _n=F.count(F.lit(1)))
    taps = F.array(*[F.struct(F.lit(j).alias("j"), lit(a).alias("a"), lit(d).alias("d")) for j, (a, d) in enumerate(zip(REC_LO, REC_HI))])
    parts = sized.select(*by, "_n", "i", "x", "d", F.explode(taps).alias("t"))
    spot = (2 * F.col("i") - (TAPS - 2) + F.col("t.j"))
    out = parts.select(*by, "_n", spot.alias("i"), (F.col("x") * F.col("t.a") + F.col("d") * F.col("t.d")).alias("v"))
    inside = out.filter((F.col("i") >= 0) & (F.col("i") < 2 * F.col("_n") - TAPS + 2))
    return inside.groupBy(*by, "i").agg(F.sum("v").alias("x"))


def wavelet_denoise(
    df: DataFrame, col: str, level: int = 3, mode: str = "soft", out: str = "denoised", *, by: Sequence[str] = KEY, time=TIME,
) -> DataFrame:
    """db4 shrinkage of the whole series with the universal threshold (it looks ahead; see the causal form). Series that a task may hold
    stream by as arrays, longer ones are joins and aggregates over coefficients. Short series take fewer levels;
    a filter spans eight rows, so shorter ones than that are not covered."""
    rows = df.filter(F.col(col).isNotNull())
    most = rows_per_task(df.sparkSession)
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    placed = positions(rows, by, time, "_i", longest=size["most"] or 0)
    if (size["most"] or 0) <= most:
        placed = placed.withColumn("_N0", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    else:
        placed = group_stats(placed, by, _N0=F.count(F.lit(1)))
    held = (F.col("_N0") >= TAPS) & (F.col("_N0") <= most)
    whole = placed.filter(held)
    whole = whole if (size["most"] or 0) <= most else whole.repartition(*by)
    done = _streamed_whole(whole, col, level, mode, out, by, time)
    if TAPS <= (size["least"] or TAPS) and (size["most"] or 0) <= most:
        return done
    placed = placed.filter(~held)
    shallow = F.greatest(F.lit(1), F.floor(F.log2(F.col("_N0").cast("double"))) - 1)  # for series under 2^(level + 1) rows
    depth = F.when(F.col("_N0") < 2 ** (level + 1), F.least(shallow, F.lit(level))).otherwise(level)
    depths = sorted(r[0] for r in placed.select(depth.cast("int")).distinct().collect()) or [level]  # at most ``level`` numbers
    others = reduce(lambda a, b: a.unionByName(b), [_denoised(placed.filter(depth == d), col, d, mode, out, by) for d in depths])
    return done.unionByName(others)


def _streamed_whole(placed: DataFrame, col: str, level: int, mode: str, out: str, by: Sequence[str], time: str) -> DataFrame:
    kept = [f for f in placed.schema.fields if f.name not in ("_i", "_N0", "_x", out)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in _whole_keys(batches):
            x = batch.column("_x").to_numpy()
            depths = [min(level, max(1, int(np.log2(b - a)) - 1)) if b - a < 2 ** (level + 1) else level for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            value = np.concatenate([denoise_array(x[a:b], d, mode) for a, b, d in zip(cuts[:-1], cuts[1:], depths, strict=True)])
            value = pa.array(value, mask=_null_keys(batch, by))  # null keys have no value
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], value], [*[f.name for f in kept], out])

    rows = _keys_in_order(placed.withColumn("_x", F.col(col).cast("double")), by, time)
    return rows.mapInArrow(work, T.StructType([*kept, T.StructField(out, T.DoubleType())]))


def _denoised(placed: DataFrame, col: str, level: int, mode: str, out: str, by: Sequence[str]) -> DataFrame:
    """Series that all go ``level`` levels deep."""
    approx = placed.select(*by, F.col("_i").cast("long").alias("i"), F.col(col).alias("x"))
    details = []
    for _ in range(level):
        approx, detail = _split_level(approx, by)
        details.append(detail)
    finest = details[0].withColumn("d", F.abs("d"))
    sizes = placed.select(*by, "_N0").distinct()
    noise = quantiles(finest, by, "d", [0.5], "_q").join(sizes, list(by)).select(
        *by, (F.col("_q")[0] / lit(0.6745) * F.sqrt(2 * F.ln(F.col("_N0").cast("double")))).alias("_thr"))
    for detail in reversed(details):
        cut = attach(detail, noise, by)
        size = F.abs("d")
        kept = F.signum("d") * F.greatest(size - F.col("_thr"), lit(0)) if mode == "soft" else F.when(size >= F.col("_thr"), F.col("d")).otherwise(lit(0))
        approx = _join_level(approx, cut.withColumn("d", kept).drop("_thr"), by)
    side = approx.select(*by, F.col("i").alias("_i"), F.col("x").alias(out))
    return attach(placed.drop("_N0"), side, [*by, "_i"]).drop("_i")


def _analyse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = TAPS - 1
    ext = np.pad(x, edge, mode="symmetric")
    keep = slice(TAPS, None, 2)
    size = (len(x) + edge) // 2
    return np.convolve(ext, DEC_LO)[keep][:size], np.convolve(ext, DEC_HI)[keep][:size]


def _synthesise(a: np.ndarray, d: np.ndarray) -> np.ndarray:
    up = np.zeros((2, 2 * len(d)))
    up[0, ::2], up[1, ::2] = a[:len(d)], d
    full = np.convolve(up[0], REC_LO) + np.convolve(up[1], REC_HI)
    return full[TAPS - 2:TAPS - 2 + 2 * len(d) - TAPS + 2]


def denoise_array(x: np.ndarray, level: int = 3, mode: str = "soft") -> np.ndarray:
    """The same shrinkage of one bounded array."""
    n = len(x)
    if n < 2 ** (level + 1):
        level = max(1, int(np.log2(n)) - 1)
    a, details = np.asarray(x, float), []
    for _ in range(level):
        a, d = _analyse(a)
        details.append(d)
    thr = np.median(np.abs(details[0])) / 0.6745 * np.sqrt(2 * np.log(n))
    for d in reversed(details):
        shrunk = np.sign(d) * np.maximum(np.abs(d) - thr, 0) if mode == "soft" else np.where(np.abs(d) >= thr, d, 0.0)
        a = _synthesise(a, shrunk)
    return a[:n]


def _finest_linear(size: int, level: int) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """Of windows of ``size`` rows: the coefficients that their last smoothed value uses, as rows of weights, the last value as weights
    of them (finest details first, the approximation last), and the places of each. The finest details at the right edge come first."""
    rows, a = [], np.eye(size)
    both = lambda m: [np.array(v) for v in zip(*[_analyse(c) for c in m.T], strict=True)]
    details = []
    for _ in range(level):
        a, d = (v.T for v in both(a))
        details.append(d)

    def last(parts: list[np.ndarray]) -> float:
        v = parts[-1]
        for d in reversed(parts[:-1]):
            v = _synthesise(v, d)
        return v[size - 1]

    blocks, used, at = [*details, a], [], []
    for j, block in enumerate(blocks):
        weights = np.array([last([np.eye(len(p))[i] if m == j else np.zeros(len(p)) for m, p in enumerate(blocks)]) for i in range(len(block))])
        kept = np.flatnonzero(weights)
        rows.append(block[kept])
        used.append(weights[kept])
        at.append(len(kept))
    edge = details[0][size // 2:]
    ends = np.cumsum([len(edge), *at])
    return np.concatenate([edge, *rows]), np.concatenate(used), [slice(0, len(edge)), *[slice(x, y) for x, y in zip(ends[:-1], ends[1:], strict=True)]]


@lru_cache(maxsize=64)
def _window_maps(level: int) -> list[tuple[int, np.ndarray, np.ndarray, list[slice]]]:
    """Per residue of the prefix length by 2^level, (window size, maps of ``_finest_linear``). A window starts at a multiple of 2^level and
    is long enough that what the mirrored left end changes does not reach the last value."""
    step = 2 ** level
    return [(16 * step + r, *_finest_linear(16 * step + r, level)) for r in range(step)]


def last_denoised(x: np.ndarray, lo: int, level: int = 3) -> np.ndarray:
    """Last value of ``denoise_array`` of every prefix that ends at ``lo`` or later.

    Only some coefficients at the end of a prefix make its last value: they are sums over a window of fixed length. The threshold is the
    median over the whole prefix; it comes from a sorted array of the finest details that all prefixes share, of which a few neighbours
    of the middle and the details at the own edge are looked at.
    """
    x = np.asarray(x, float)
    out = np.full(len(x) - lo, np.nan)
    bad = np.flatnonzero(~np.isfinite(x))
    step, plain = 2 ** level, len(x) if len(bad) and not np.isnan(x[bad[0]]) else lo
    plain = max(plain, min(len(x), 17 * step))  # short prefixes, and all where a value is infinite
    for i in range(lo, plain):
        out[i - lo] = denoise_array(x[:i + 1], level)[-1]
    end = bad[0] if len(bad) and np.isnan(x[bad[0]]) else len(x)  # no prefix with a NaN has a value
    block = 64 if len(x) < 2**15 else 512
    shared = np.abs(_analyse(x[:end])[1][:end // 2]) if end > plain else np.empty(0)
    maps, placed = _window_maps(level) if end > plain else [], np.sort(shared[:(plain + 1) // 2])
    for at in range(max(lo, plain), end, block):
        n = np.arange(at, min(at + block, end)) + 1
        edges, parts = np.full((len(n), TAPS), np.inf), {}
        for r, (size, weights, _, where) in enumerate(maps):
            mine = np.flatnonzero(n % step == r)
            if len(mine):
                found = x[(n[mine] - size)[:, None] + np.arange(size)] @ weights.T
                edges[mine, :where[0].stop] = np.abs(found[:, where[0]])
                parts[r] = mine, found
        base, new = len(placed), shared[len(placed):n[-1] // 2]
        extra = n // 2 - base + (n + TAPS - 1) // 2 - n // 2
        count = base + extra
        r1, r2 = (count - 1) // 2, count // 2
        low, high = max(0, int((r1 - extra).min())), min(base, int(r2.max()) + 1)
        seen = np.where(np.arange(len(new)) < (n // 2 - base)[:, None], new, np.inf)
        near = np.sort(np.concatenate([np.broadcast_to(placed[low:high], (len(n), max(0, high - low))), seen, edges], axis=1), axis=1)
        every = np.arange(len(n))
        threshold = (near[every, r1 - low] + near[every, r2 - low]) / 2 / 0.6745 * np.sqrt(2 * np.log(n))
        for r, (_, _, last, where) in enumerate(maps):
            if r in parts:
                mine, found = parts[r]
                cut = where[-1].start
                details = found[:, where[0].stop:cut]
                details = np.sign(details) * np.maximum(np.abs(details) - threshold[mine, None], 0)
                out[n[mine] - 1 - lo] = np.concatenate([details, found[:, cut:]], axis=1) @ last
        placed = np.insert(placed, np.searchsorted(placed, np.sort(new)), np.sort(new))
    return out


def causal_wavelet_denoise(
    df: DataFrame, col: str, level: int = 3, min_window: int = 252, rows: int = 128, out: str = "denoised",
    *, by: Sequence[str] = KEY, time=TIME,
) -> DataFrame:
    """Last value of the shrinkage of every prefix; the exponential mean before ``min_window``.

    Series stream by in time order, a row costing the same wherever it stands. Longer ones than a task may hold are cut into groups of
    ``rows`` targets or an eighth of what a task holds, if that is more; each group is sent the prefix it needs.
    """
    longest = longest_group(df, by)
    placed = ema(positions(df, by, time, "_i", longest=longest), col, min_window, "_ema", by=by, time=time, longest=longest)
    if longest <= min(rows_per_task(df.sparkSession), ema_rows(min_window)):  # else positions or means are not from one window per key
        return _streamed_denoise(placed, col, level, min_window, out, by, time)
    early = placed.filter(F.col("_i") < min_window).withColumn(out, F.col("_ema"))
    rows = max(rows, rows_per_task(df.sparkSession) // 8)
    sized = group_stats(placed, by, _n=F.count(F.lit(1)))
    own = F.floor(F.col("_i") / rows)
    last = F.floor((F.col("_n") - 1) / rows)
    sent = sized.filter(F.col("_n") > min_window).select(
        *by, F.col("_i"), F.col(col).alias("_x"), F.explode(F.sequence(F.greatest(own, F.lit(min_window // rows)), last)).alias("_g"))
    keys = [f for f in df.schema.fields if f.name in by]
    schema = T.StructType([*keys, T.StructField("_i", T.LongType()), T.StructField(out, T.DoubleType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        x, lo = pdf["_x"].to_numpy(float), max(int(key[-1]) * rows, min_window)
        frame = pd.DataFrame({"_i": np.arange(lo, len(x)), out: last_denoised(x, lo, level)})
        for name, value in zip(by, key):
            frame[name] = value
        return frame[[*by, "_i", out]]

    late = sent.groupBy(*by, "_g").applyInPandas(run, schema)
    done = attach(placed.filter(F.col("_i") >= min_window), late, [*by, "_i"])
    return early.unionByName(done.select(*early.columns)).drop("_i", "_ema")


def _streamed_denoise(placed: DataFrame, col: str, level: int, min_window: int, out: str, by: Sequence[str], time: str) -> DataFrame:
    """Keys one after the other, each in time order, as the window of their positions leaves them; position 0 begins a key."""
    kept = [f for f in placed.schema.fields if f.name not in ("_i", "_ema", out)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0)  # the prefix of the key that the last batch ended in
        for batch in batches:
            number = lambda c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            i, x, value = batch.column("_i").to_numpy(), number("_x"), number("_ema").copy()
            if not len(i):
                continue
            late = i >= min_window
            cuts = np.unique([0, *np.flatnonzero(i == 0), len(i)])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                held = x[a:b] if i[a] == 0 else np.concatenate([held, x[a:b]])
                if i[b - 1] >= min_window:
                    lo = max(int(i[a]), min_window)
                    value[b - (int(i[b - 1]) + 1 - lo):b] = last_denoised(held, lo, level)
            none = np.where(late, np.isnan(value), batch.column("_ema").is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(value, mask=none)], [*[f.name for f in kept], out])

    rows = placed.withColumn("_x", F.col(col).cast("double")).sortWithinPartitions(*by, time)
    return rows.mapInArrow(work, T.StructType([*kept, T.StructField(out, T.DoubleType())]))


def denoised_returns(df: DataFrame, col: str, min_window: int = 252, out: str = "denoised_return", *, by: Sequence[str] = KEY, time=TIME) -> DataFrame:
    """Next change of the causally denoised series, relative to it; NULL where it is not positive."""
    smooth = causal_wavelet_denoise(df, col, min_window=min_window, out="_s", by=by, time=time)
    step: Column = F.col("_s")
    return along_time(smooth, {out: lambda t: F.when(step > 0, (F.lead("_s").over(t.w) - step) / step)},
                      by=by, time=time, ahead=1, drop=("_s",), longest=longest_group(df, by))


# ---- GARCH ------------------------------------------------------------------------------------

def _likelihoods(xs: Sequence[np.ndarray], var: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Negative log likelihood of each series for its row of parameters (omega = s * var * (1 - a - b)). Longer series come first."""
    sizes = np.array([len(x) for x in xs])
    sq = np.zeros((sizes.max(initial=0), len(xs), 1))
    for i, x in enumerate(xs):
        sq[:len(x), i, 0] = x * x
    omega, h, total = s * var[:, None] * (1 - a - b), np.repeat(var[:, None], a.shape[1], axis=1), np.zeros(a.shape)
    going = len(xs) - np.searchsorted(sizes[::-1], np.arange(len(sq)), side="right")
    for m in np.unique(going)[::-1]:
        w, p, q, g, t = omega[:m], a[:m], b[:m], h[:m].copy(), total[:m]
        for x in sq[going == m, :m]:
            t += np.log(g) + x / g
            g = w + p * x + q * g
        h[:m] = g
    return total


def fit_garch_all(xs: Sequence[np.ndarray], rounds: int = 7) -> list[tuple[float, float, float]]:
    """``fit_garch`` of several series in one loop over their rows."""
    if not len(xs):
        return []
    order = sorted(range(len(xs)), key=lambda i: -len(xs[i]))
    demeaned = [np.asarray(xs[i], float) - np.mean(xs[i]) for i in order]
    var = np.array([float(np.var(x)) for x in demeaned])
    centre, width = np.tile([0.25, 0.5, 1.0], (len(xs), 1)), np.array([0.25, 0.49, 0.5])
    for _ in range(rounds):
        grids = []
        for c0 in centre:
            grids.append([v.ravel() for v in np.meshgrid(*[np.linspace(c - w, c + w, 5) for c, w in zip(c0, width)])])
        a, b, s = (np.array(v) for v in zip(*grids))
        ok = (a >= 0) & (b >= 0) & (a + b < 0.9999) & (s > 0.05)
        # Points outside the bounds stand for the centre, which lies inside, and never win.
        a, b, s = (np.where(ok, v, centre[:, [i]]) for i, v in enumerate((a, b, s)))
        best = np.where(ok, _likelihoods(demeaned, var, a, b, s), np.inf).argmin(axis=1)
        at = np.arange(len(xs)), best
        centre, width = np.stack([a[at], b[at], s[at]], axis=1), width * 0.5
    out: list[tuple[float, float, float]] = [(0.0, 0.0, 0.0)] * len(xs)
    for i, v, (a, b, s) in zip(order, var, centre, strict=True):
        out[i] = float(s * v * (1 - a - b)), float(a), float(b)
    return out


def fit_garch(x: np.ndarray, rounds: int = 7) -> tuple[float, float, float]:
    """omega, alpha, beta by a shrinking grid over the likelihood of demeaned returns."""
    return fit_garch_all([x], rounds)[0]


AT_ONCE = 64  # series fitted in one loop
HELD_ROWS = 100_000  # rows of theirs beyond which they are fitted at once


def garch_fit(
    df: DataFrame, ret: str, *, by: Sequence[str] = ("symbol", "fold"), role: str = "role", time=TIME, min_rows: int = 100,
) -> DataFrame:
    """GARCH(1,1) per key on its training rows (a fold's training span bounds the group).

    ``degenerate`` marks keys that must fall back to the training variance.
    """
    keys = [f for f in df.schema.fields if f.name in by]
    names = ["omega", "alpha", "beta", "train_var"]
    schema = T.StructType([*keys, *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("degenerate", T.BooleanType())])

    def fitted(spans: list[tuple[tuple, np.ndarray]]) -> pa.RecordBatch:
        var = [float(np.var(x)) for _, x in spans]
        flat = [v < 1e-8 or len(x) < min_rows for v, (_, x) in zip(var, spans, strict=True)]
        models = iter(fit_garch_all([x for f, (_, x) in zip(flat, spans, strict=True) if not f]))
        rows = []
        for (span, _), v, f in zip(spans, var, flat, strict=True):
            omega, alpha, beta = (None, None, None) if f else next(models)
            rows.append((*span, omega, alpha, beta, v, f or omega < max(1e-6, v * 1e-4) or alpha < 0.005 or alpha + beta >= 1))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: list[tuple[tuple, np.ndarray]] = []
        key, parts, held = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*[batch.column(i).to_pylist() for i in range(len(by))], strict=True)) if by else [()] * batch.num_rows
            x = batch.column(len(by)).to_numpy(zero_copy_only=False).astype(float)
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if key is not None and names[lo] != key:
                    spans.append((key, np.concatenate(parts)))
                    parts = []
                    if len(spans) >= AT_ONCE or held >= HELD_ROWS:
                        yield fitted(spans)
                        spans, held = [], 0
                key = names[lo]
                parts.append(x[lo:hi])
                held += hi - lo
        if key is not None:
            yield fitted([*spans, (key, np.concatenate(parts))])

    train = df.filter((F.col(role) == "train") & F.col(ret).isNotNull()).select(*by, F.col(ret).cast("double").alias("_x"), time)
    dealt = train.repartition(*by) if by else train.repartition(1)
    kinds = to_arrow_schema(schema).types
    return dealt.sortWithinPartitions(*by, time).drop(time).mapInArrow(run, schema)


def garch_forecast(
    df: DataFrame, models: DataFrame, ret: str, *, by: Sequence[str] = ("symbol", "fold"), role: str = "role", test_role: str = "test",
    time=TIME, floor: float = 1e-8, out: str = "forecast",
) -> DataFrame:
    """Filtered one-step variance on test rows; the training variance where the fit is degenerate."""
    from barloom.operators.rolling import garch_filter

    joined = attach(df, models, by, "inner")
    fine = garch_filter(joined.filter(~F.col("degenerate")), ret, by=by, time=time, floor=floor, out=out)
    flat = joined.filter("degenerate").withColumn(out, F.greatest("train_var", lit(floor)))
    both = fine.select(*flat.columns).unionByName(flat)
    return both.filter(F.col(role) == test_role).drop("omega", "alpha", "beta", "train_var", "degenerate")
