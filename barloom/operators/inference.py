"""Statistical tests on metric series and the stability report."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import guarded_corr, lit
from barloom.functions.grouping import along_time, attach, average_rank, group_stats, ordered, positions, quantiles
from barloom.functions.stats import binomial_p, normal_p, student_p
from barloom.operators.metrics import finite_pairs
from barloom.operators.panel import finite
from barloom.session import written

TIME = "date"


def diebold_mariano(
    df: DataFrame, loss1: str, loss2: str, h: int = 1, variant: str = "bartlett", *, by: Sequence[str] = ("symbol",), time=TIME,
) -> DataFrame:
    """Mean loss differential over its autocorrelation-robust error.

    bartlett  lags 1..min(h, n/4)-1 with Bartlett weights, normal p, at least 10 rows
    simple    lags 1..h with weights (n-i)/n, t p, p = 1 under 20 rows
    """
    d = df.filter(finite(loss1) & finite(loss2)).select(*by, time, (F.col(loss1) - F.col(loss2)).alias("_d"))
    d = group_stats(d, by, _m=F.avg("_d")).withColumn("_c", F.col("_d") - F.col("_m"))
    lags = range(1, h if variant == "bartlett" else h + 1)
    if lags:
        stage = {f"_g{k}": (lambda t, k=k: F.col("_c") * F.lag("_c", k).over(t.w)) for k in lags}
        d = along_time(d, stage, by=by, time=time, back=max(lags))
    n = F.count(F.lit(1))
    var: Column = F.var_pop("_d") / n
    for k in lags:
        gamma = F.coalesce(F.avg(f"_g{k}"), lit(0))
        if variant == "bartlett":
            top = F.least(F.lit(h), F.floor(n / 4))
            var = var + F.when(F.lit(k) < top, 2 * (1 - F.lit(k) / F.nullif(top, F.lit(0))) * gamma / n).otherwise(lit(0))
        else:
            var = var + 2 * (n - k) / (n * n) * gamma
    if variant == "bartlett":
        se = F.greatest(F.sqrt(F.greatest(var, lit(0))), lit(1e-10))
        out = d.groupBy(*by).agg(n.alias("n"), F.avg("_d").alias("mean_differential"), (F.avg("_d") / se).alias("dm_statistic"))
        out = out.withColumn("dm_statistic", F.when(F.col("n") >= 10, F.col("dm_statistic")))
        return out.withColumn("p_value", normal_p(F.col("dm_statistic")))
    stat = F.avg("_d") / F.sqrt(F.greatest(var, lit(1e-12)))
    out = d.groupBy(*by).agg(n.alias("n"), F.avg("_d").alias("mean_differential"), stat.alias("dm_statistic"))
    return out.withColumn("p_value", F.when(F.col("n") < 20, lit(1)).otherwise(student_p(F.col("dm_statistic"), F.col("n") - 1)))


def t_test(df: DataFrame, col: str, against: str | None = None, *, by: Sequence[str] = ()) -> DataFrame:
    """One-sample t test against 0, or paired when ``against`` is given."""
    x = F.col(col) - F.col(against) if against else F.col(col)
    n, sd = F.count(x), F.stddev_samp(x)
    t = F.avg(x) / F.nullif(sd / F.sqrt(n.cast("double")), lit(0))
    out = df.groupBy(*by).agg(n.alias("n"), F.avg(x).alias("mean"), sd.alias("std"), t.alias("t_statistic"))
    return out.withColumn("p_value", student_p(F.col("t_statistic"), F.col("n") - 1))


def binomial_sign_test(df: DataFrame, col: str, *, by: Sequence[str] = ()) -> DataFrame:
    """P(at least this many positives) for fair signs."""
    out = df.groupBy(*by).agg(F.count(col).alias("n"), F.count_if(F.col(col) > 0).alias("n_positive"))
    return out.withColumn("p_value", binomial_p(F.col("n_positive"), F.col("n")))


def _hash_int(*parts: Column) -> Column:
    """32-bit number from an MD5 of the parts; the same in any engine with MD5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def bootstrap_ci(
    df: DataFrame, col: str, order: str, n_boot: int = 1000, seed: int = 42, probs: Sequence[float] = (0.025, 0.975),
) -> DataFrame:
    """Percentile interval of the mean over resamples of a short series (one row per fold).

    Draw i of resample b takes the row at a hashed position; the draws meet the series by
    an equi-join on the position.
    """
    series = group_stats(positions(df.filter(F.col(col).isNotNull()), (), order, "_p"), [], _n=F.count(F.lit(1)))
    draws = series.select(
        F.col("_p").alias("_i"), "_n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    draws = draws.select("rep", (_hash_int(F.lit(seed), F.col("rep"), F.col("_i")) % F.col("_n")).alias("_at"))
    picked = draws.join(series.select(F.col("_p").cast("bigint").alias("_at"), col), "_at")
    means = picked.groupBy("rep").agg(F.avg(col).alias("m"))
    cuts = quantiles(means, (), "m", probs, "_q")
    return cuts.select(F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


def loo_range(df: DataFrame, col: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Spread of the means that leave one row out: ((sum - min) - (sum - max)) / (n - 1)."""
    spread = (F.max(col) - F.min(col)) / F.nullif(F.count(col) - 1, F.lit(0))
    return df.groupBy(*by).agg(spread.alias("loo_range"))


def stability_stats(
    df: DataFrame, ic: str, train_ic: str | None = None, order: str = "fold", *, by: Sequence[str] = (), head: int = 8, tail: int = 3,
) -> DataFrame:
    """Variation, t statistic, sign share, recency and half decay, and the train/validation gap."""
    rows = group_stats(positions(df, by, order, "_p"), by, _n=F.count(F.lit(1)))
    x, mean, sd = F.col(ic), F.avg(ic), F.stddev_pop(ic)
    n = F.count(F.lit(1))
    part = lambda cond: F.avg(F.when(cond, x))
    half = F.floor(F.col("_n") / 2)
    last = F.when(n >= tail, part(F.col("_p") >= F.col("_n") - tail)).otherwise(mean)
    first = F.when(n >= head, part(F.col("_p") < head)).otherwise(mean)
    aggs = {
        "n_windows": n, "mean_ic": mean, "std_ic": sd, "cv": sd / F.greatest(F.abs(mean), lit(1e-8)),
        "t_stat": F.when(n > 1, mean / F.nullif(sd / F.sqrt(n.cast("double")), lit(0))).otherwise(lit(0)),
        "positive_share": F.avg((x > 0).cast("double")), "recency_decay": last - first,
        "half_decay": part(F.col("_p") >= half) - F.coalesce(part(F.col("_p") < half), mean)}
    if train_ic:
        gap = F.col(train_ic) - x
        aggs |= {"gap_mean": F.avg(gap), "gap_max": F.max(gap)}
    return rows.groupBy(*by).agg(*[a.alias(k) for k, a in aggs.items()])


def coef_stability(coefs: DataFrame, top: int = 10, *, feature: str = "feature", value: str = "coef") -> DataFrame:
    """Long (fold, feature, coef) -> per feature: variation over folds, mean size, rank by size,
    and the median variation over all features."""
    per = coefs.groupBy(feature).agg(
        (F.stddev_pop(value) / (F.abs(F.avg(value)) + lit(1e-10))).alias("cv"), F.avg(F.abs(value)).alias("mean_abs"))
    placed = ordered(per.withColumn("_s", -F.col("mean_abs")), (), ["_s", feature], out="size_rank").drop("_s")
    return group_stats(placed, [], median_cv=F.percentile("cv", lit(0.5))).withColumn("in_top", F.col("size_rank") <= top)


def ic_gate_verdict(checks: DataFrame, passed: str = "passed") -> DataFrame:
    """Share of passed checks: PASS from 70 %, BORDERLINE from 50 %, else FAIL."""
    share = F.avg(F.col(passed).cast("double"))
    verdict = F.when(share >= 0.7, "PASS").when(share >= 0.5, "BORDERLINE").otherwise("FAIL")
    return checks.agg(F.count_if(F.col(passed)).alias("n_pass"), F.count(F.lit(1)).alias("n_total"), verdict.alias("verdict"))


# The gate's thresholds, as (check, metric, comparison, bound).
IC_GATES = (
    ("held_out", "abs_ic", ">", 0.02), ("statistical", "p_ic", "<", 0.01), ("stability_cv", "cv", "<", 0.6),
    ("stability_binomial", "binomial_p", "<", 0.01), ("stability_recency", "recency_decay", ">", -0.03),
    ("symbol_binomial", "symbol_binomial_p", "<", 0.01), ("symbol_t_test", "symbol_p", "<", 0.01),
    ("symbol_majority", "symbol_positive_share", ">", 0.55), ("gap", "gap_mean", "<", 0.03),
    ("decay", "half_decay", ">", -0.02), ("bootstrap", "ci_low", ">", 0.02),
)


def ic_gate_checks(stats: DataFrame) -> DataFrame:
    """One row of statistics -> one row per check with its outcome."""
    cell = lambda m: F.col(m) if m in stats.columns else F.lit(None).cast("double")
    rows = [F.struct(F.lit(name).alias("check"), cell(m).cast("double").alias("value"),
                     F.coalesce(cell(m) > bound if op == ">" else cell(m) < bound, F.lit(False)).alias("passed"))
            for name, m, op, bound in IC_GATES]
    return stats.select(F.inline(F.array(*rows)))


ROUNDS, LOW = 20, 2**30 - 1


def shuffle_keys(n_perm: int, seed: int = 42) -> list[list[tuple[int, int]]]:
    """Per shuffle and round, an offset and a multiplier from a digest of (shuffle, round, seed)."""
    digest = lambda rep, i: md5(f"{rep}|{i}|{seed}".encode()).hexdigest()
    return [[(int(digest(rep, i)[:14], 16), int(digest(rep, i)[14:21], 16)) for i in range(ROUNDS)] for rep in range(1, n_perm + 1)]


def shuffled_places(k: np.ndarray, n: np.ndarray, keys: Sequence[tuple[int, int]]) -> np.ndarray:
    """A keyed permutation of 0..n-1, place by place, without a table or a sort.

    Each round pairs place k with (offset - k) mod n and swaps the pair or leaves it, by a bit that both compute alike: so every
    round, and all together, is one-to-one on any n. For one n below 2^31 numbers of 32 bits do: the bit looked at is the 30th of a
    product, which higher ones don't reach.
    """
    if np.ndim(n) == 0 and n < 2**31:
        return _small_places(k, int(n), keys)
    for offset, factor in keys:
        other = offset % n - k
        other = np.where(other < 0, other + n, other)
        bit = ((np.maximum(k, other) & LOW) * (2 * factor + 1) >> 29) & 1
        k = np.where(bit == 1, other, k)
    return k


def _small_places(k: np.ndarray, n: int, keys: Sequence[tuple[int, int]]) -> np.ndarray:
    """``shuffled_places`` in 32-bit numbers that wrap, without new arrays in a round."""
    k, size = np.asarray(k).astype(np.uint32), np.uint32(n)
    other, turn = np.empty_like(k), np.empty_like(k)
    for offset, factor in keys:
        np.subtract(np.uint32(offset % n), k, out=other)
        np.add(other, size, out=turn)
        np.minimum(other, turn, out=other)  # of both that are right modulo 2^32, the one below n
        np.maximum(k, other, out=turn)
        np.multiply(turn, np.uint32((2 * factor + 1) % 2**32), out=turn)
        np.right_shift(turn, np.uint32(29), out=turn)
        np.bitwise_and(turn, np.uint32(1), out=turn)
        np.subtract(np.uint32(0), turn, out=turn)  # all bits or none
        np.bitwise_xor(other, k, out=other)
        np.bitwise_and(other, turn, out=other)
        np.bitwise_xor(k, other, out=k)
    return k.astype(np.int64)


# Places of a key in one packed piece, packed pieces of predictions that one task holds at most, and pieces of targets it takes.
PIECE, HELD, TAKEN = 2**16, 2**9, 2**4


def _pieces(base: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., _piece, _n, _ry, _rp): the centred ranks of neighbouring places of a key, in order, as packed doubles."""
    schema = T.StructType([*base.select(*by).schema.fields, T.StructField("_piece", T.LongType()), T.StructField("_n", T.LongType()),
                           T.StructField("_ry", T.BinaryType()), T.StructField("_rp", T.BinaryType())])

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_k")
        packed = [pa.array([rows.column(c).to_numpy().tobytes()], pa.binary()) for c in ("_ry", "_rp")]
        return pa.Table.from_arrays([*[rows.column(c).slice(0, 1) for c in (*by, "_piece", "_n")], *packed], schema.names)

    return base.withColumn("_piece", F.floor(F.col("_k") / PIECE)).groupBy(*by, "_piece").applyInArrow(pack, schema)


def _null_products(pieces: DataFrame, by: Sequence[str], keys: Sequence[Sequence[tuple[int, int]]]) -> DataFrame:
    """(by..., rep, _p): the sum over a key of each target's rank by that of the prediction which a shuffle pairs it with.

    A tile is some pieces of targets beside up to HELD pieces of predictions; its places for a shuffle are computed, and those among
    the predictions it holds are counted. Only packed ranks are moved, one copy of the predictions per share of the targets.
    """
    every = F.floor((F.col("_n") - 1) / PIECE) + 1
    taken = F.greatest(F.lit(TAKEN), F.ceil(every / TAKEN))  # shares of the targets: TAKEN at most
    shares, holders = F.ceil(every / taken), F.ceil(every / HELD)
    left = pieces.select(*by, "_n", "_piece", F.floor(F.col("_piece") / taken).alias("_share"), F.explode(F.sequence(F.lit(0).cast("bigint"), holders - 1)).alias("_holder"), "_ry")
    right = pieces.select(*[F.col(c).alias(f"_right_{i}") for i, c in enumerate(by)], F.col("_piece").alias("_at"), F.col("_rp").alias("_held"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)).alias("_to"), F.floor(F.col("_piece") / HELD).alias("_from"))
    schema = T.StructType([*pieces.select(*by).schema.fields, T.StructField("rep", T.IntegerType()), T.StructField("_p", T.DoubleType())])

    def products(targets: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("_at")
        first = held.column("_at")[0].as_py() * PIECE if len(held) else 0
        other = np.concatenate([np.frombuffer(v.as_buffer(), float) for chunk in held.column("_held").chunks for v in chunk] or [np.empty(0)])
        total = np.zeros(len(keys))
        for n, piece, ry in zip(*[targets.column(c) for c in ("_n", "_piece", "_ry")], strict=True):
            own, size = np.frombuffer(ry.as_buffer(), float), n.as_py()
            at = np.arange(len(own)) + piece.as_py() * PIECE
            for rep, turns in enumerate(keys):
                to = shuffled_places(at, np.int64(size), turns) - first
                if size <= len(other):
                    total[rep] += own @ other[to]
                else:
                    mine = (to >= 0) & (to < len(other))
                    total[rep] += own[mine] @ other[to[mine]]
        kept = [pa.array([targets.column(c)[0].as_py()] * len(keys), targets.schema.field(c).type) for c in by] if len(targets) else []
        rows = len(keys) if len(targets) else 0
        kept = kept or [pa.array([], held.column(f"_right_{i}").type) for i in range(len(by))]
        return pa.Table.from_arrays([*kept, pa.array(np.arange(1, rows + 1, dtype=np.int32)), pa.array(total[:rows])], schema.names)

    dealt = right.groupBy(*[f"_right_{i}" for i in range(len(by))], "_to", "_from")
    tiles = left.groupBy(*by, "_share", "_holder").cogroup(dealt).applyInArrow(products, schema)
    return tiles.groupBy(*by, "rep").agg(F.sum("_p").alias("_p"))


def _spreads(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., _s, _o): the product of both sides' lengths, and the sum of products as the rows stand."""
    fields = [T.StructField(c, T.DoubleType()) for c in ("_yy", "_pp", "_yp")]
    schema = T.StructType([*pieces.select(*by).schema.fields, *fields])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(np.frombuffer(a.as_buffer(), float), np.frombuffer(b.as_buffer(), float)) for a, b in zip(batch.column("_ry"), batch.column("_rp"))]
            found = [[a @ a for a, _ in sides], [b @ b for _, b in sides], [a @ b for a, b in sides]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], *[pa.array(f, pa.float64()) for f in found]], schema.names)

    parts = pieces.select(*by, "_ry", "_rp").mapInArrow(sums, schema)
    return parts.groupBy(*by).agg(F.sqrt(F.sum("_yy") * F.sum("_pp")).alias("_s"), F.sum("_yp").alias("_o"))


def permutation_test(
    df: DataFrame, y: str, yhat: str, n_perm: int = 100, seed: int = 42, *, by: Sequence[str] = ("fold",),
    key: Sequence[str] = ("symbol", "date"),
) -> DataFrame:
    """Rank correlation under keyed shuffles of the predictions inside the key.

    Rows are ranked and put in hash order once. A shuffle pairs the target at place k with the prediction at a place that k, the key's
    size and the shuffle's number determine. Tasks hold packed predictions and compute all shuffles of a share of the targets, so
    no row is copied per shuffle.
    """
    pairs = written(finite_pairs(df, y, yhat).select(*dict.fromkeys([*by, *key, y, yhat])).dropna(subset=list(by)))  # null keys have no result
    ranked = average_rank(pairs, by, [y, yhat], ["_ry", "_rp"])
    tag = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    base = ordered(ranked.select(*by, "_ry", "_rp", tag.alias("_h")), by, ["_h"], out="_k", total="_n")
    middle = (F.col("_n") + 1) / 2  # of ranks that share ties
    base = base.select(*by, (F.col("_k") - 1).alias("_k"), "_n", (F.col("_ry") - middle).alias("_ry"), (F.col("_rp") - middle).alias("_rp"))
    pieces = written(_pieces(base, by))
    null = attach(_null_products(pieces, by, shuffle_keys(n_perm, seed)), _spreads(pieces, by), by)
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("_s"), lit(0)), lit(0))
    both = null.select(*by, share("_p").alias("_ic"), share("_o").alias("observed_ic"))
    return both.groupBy(*by).agg(
        F.first("observed_ic").alias("observed_ic"), F.avg("_ic").alias("null_mean"), F.stddev_pop("_ic").alias("null_std"),
        F.avg((F.col("_ic") >= F.col("observed_ic")).cast("double")).alias("p_one_sided"),
        F.avg((F.abs("_ic") >= F.abs("observed_ic")).cast("double")).alias("p_two_sided"))


# Standard normal quantiles.
Z_975, Z_80 = 1.959963984540054, 0.8416212335729143


def min_detectable_ic(ics: DataFrame, ic: str = "ic", z_alpha: float = Z_975, z_power: float = Z_80, *, by: Sequence[str] = ()) -> DataFrame:
    """Smallest rank correlation a series of this length can tell from zero (Fisher z)."""
    base = ics.groupBy(*by).agg(F.count(ic).alias("n"), F.avg(ic).alias("observed_ic"))
    se = lit(1) / F.sqrt((F.col("n") - 3).cast("double"))
    rho = F.tanh(lit(z_alpha + z_power) * se)
    return base.filter(F.col("n") > 3).withColumns({
        "se_fisher_z": se, "min_ic": rho, "ratio": F.abs("observed_ic") / rho, "r_squared": rho * rho,
        "detectable": F.abs("observed_ic") >= rho})


def naive_baselines(df: DataFrame, ret: str, seed: int = 0, *, key: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """A seeded standard-normal predictor (Box-Muller on hashes) and the negated return."""
    cols = [F.col(k) for k in key]
    unit = lambda i: (_hash_int(*cols, F.lit(seed), F.lit(i)) + 1) / lit(2.0**32 + 1)
    noise = F.sqrt(lit(-2) * F.ln(unit(0))) * F.cos(lit(6.283185307179586) * unit(1))
    return df.withColumns({"random_pred": noise, "meanrev_pred": -F.col(ret)})
