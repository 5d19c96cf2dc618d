"""Evaluation metrics: one row per key.  ``y`` is the target, ``yhat`` the prediction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import ANNUAL, guarded_corr, lit, sharpe_of, sortino_of
from barloom.functions.grouping import along_time, average_rank, frame_blocks, longest_group, quantiles, running, unblock
from barloom.operators.cross import signal_deciles
from barloom.operators.panel import finite
from barloom.session import written

FOLD, TIME = ("fold",), "date"


def finite_pairs(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.filter(finite(y) & finite(yhat))


# ---- rank correlation ---------------------------------------------------------------

def _spearman(df: DataFrame, y: str, yhat: str, by: Sequence[str], longest: int | None = None) -> DataFrame:
    """Per key: n, both sample deviations, and the correlation of average ranks."""
    pairs = written(finite_pairs(df, y, yhat).select(*dict.fromkeys([*by, y, yhat])))  # counted, then ranked
    ranked = average_rank(pairs, by, [y, yhat], ["_ry", "_rp"], longest=longest)
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), guarded_corr(F.col("_ry"), F.col("_rp")).alias("rho"),
        F.stddev_samp(y).alias("sy"), F.stddev_samp(yhat).alias("sp"))


def spearman_ic(df: DataFrame, y: str, yhat: str, mode: str = "script", *, by: Sequence[str] = FOLD) -> DataFrame:
    """Spearman correlation per key; 0 under 10 rows (script), or under 2 rows or with a
    constant side (library)."""
    stats = _spearman(df, y, yhat, by)
    ok = F.col("n") >= 10 if mode == "script" else (F.col("n") >= 2) & (F.col("sy") >= 1e-12) & (F.col("sp") >= 1e-12)
    return stats.select(*by, "n", F.when(ok, F.coalesce("rho", lit(0))).otherwise(lit(0)).alias("ic"))


def daily_ic_series(
    df: DataFrame, y: str, yhat: str, min_names: int = 3, short: str = "drop", *, by: Sequence[str] = (TIME,),
) -> DataFrame:
    """Rank correlation per date; dates with fewer names are dropped or set to 0."""
    stats = _spearman(df, y, yhat, by).withColumn("ic", F.col("rho"))
    if short == "drop":
        return stats.filter(F.col("n") >= min_names).select(*by, "n", "ic")
    return stats.select(*by, "n", F.when(F.col("n") >= min_names, F.coalesce("ic", lit(0))).otherwise(lit(0)).alias("ic"))


def _rolling_spearman(x: np.ndarray, y: np.ndarray, window: int) -> np.ndarray:
    """Rank correlation over the trailing ``window`` values of each row of two matrices; NaN before the window is full.

    The ranks of a window are kept, not taken anew: a value that enters or leaves moves the centred rank of every other one by the
    sign of their difference, and ties share their mean rank by that.
    """
    n, length = x.shape
    out = np.full((n, length), np.nan)
    if length < window or window < 3:
        return out
    held, ranks = [], []
    for v in (x, y):
        ring = v[:, :window].copy()
        held.append(ring)
        ranks.append(np.stack([np.sign(ring - ring[:, [j]]).sum(axis=1) * -1.0 for j in range(window)], axis=1))
    for t in range(window - 1, length):
        if t >= window:
            slot = (t - window) % window
            for v, ring, rank in zip((x, y), held, ranks, strict=True):
                rank -= np.sign(ring - ring[:, [slot]])
                ring[:, slot] = v[:, t]
                moves = np.sign(ring - ring[:, [slot]])
                rank += moves
                rank[:, slot] = -moves.sum(axis=1)
        rx, ry = ranks
        den = np.sqrt(np.einsum("ij,ij->i", rx, rx) * np.einsum("ij,ij->i", ry, ry))
        out[:, t] = np.divide(np.einsum("ij,ij->i", rx, ry), den, out=np.full(n, np.nan), where=den > 0)
    return out


def _block_spearman(window: int, late: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def correlate(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out: list = [None] * len(xs)
        order = sorted(range(len(xs)), key=lambda i: len(xs.iloc[i]))
        for some in (order[i:i + 64] for i in range(0, len(order), 64)):
            longest = len(xs.iloc[some[-1]])
            x, y = (np.full((len(some), longest), np.nan) for _ in range(2))
            for k, i in enumerate(some):
                x[k, :len(xs.iloc[i])], y[k, :len(ys.iloc[i])] = xs.iloc[i], ys.iloc[i]
            found = _rolling_spearman(x, y, window)
            if late:
                found = np.concatenate([np.full((len(some), late), np.nan), found[:, :-late]], axis=1)
            for k, i in enumerate(some):
                out[i] = found[k, :len(xs.iloc[i])]  # numbers, not objects: NaN becomes NULL outside of Python
        return pd.Series(out)

    return correlate


def rolling_ic(
    df: DataFrame, y: str, yhat: str, window: int = 252, out: str = "rolling_ic", exclude_current: bool = False,
    *, by: Sequence[str] = ("symbol",), time=TIME,
) -> DataFrame:
    """Spearman correlation over the trailing ``window`` rows, as if ranked anew in every frame.

    NULL until the window is full; ``exclude_current`` ends the window one row earlier. Python gets each value once per block of rows
    (and once more as an earlier row of the next block), not once per frame.
    """
    late = int(exclude_current)
    blocks = frame_blocks(finite_pairs(df, y, yhat), window - 1 + late, by, time, max(2048, 4 * window))
    values = lambda c: F.transform("__rows", lambda r: r["row"][c].cast("double"))
    found = F.transform(_block_spearman(window, late)(values(y), values(yhat)), lambda v: F.when(~F.isnan(v), v))
    return unblock(blocks.withColumn("__ic", found), F.col("__ic"), out)


def ic_summary(df: DataFrame, ic: str = "ic", *, by: Sequence[str] = (), time=TIME) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(ic).alias("n_days"), F.avg(ic).alias("ic_mean"), F.stddev_samp(ic).alias("ic_std"),
        F.max_by(ic, time).alias("ic_last"), F.avg((F.col(ic) > 0).cast("double")).alias("positive_share"))


# ---- pointwise errors -----------------------------------------------------------------

def direction_accuracy(df: DataFrame, y: str, yhat: str, mode: str = "sign", *, by: Sequence[str] = FOLD) -> DataFrame:
    """sign: equal signs, 0.5 under 10 rows.  both: equal signs or both zero.
    band: agreement outside a dead band of 0.005."""
    a, b, eps = F.col(y), F.col(yhat), 0.005
    if mode == "sign":
        hit = F.signum(a) == F.signum(b)
    elif mode == "both":
        hit = (F.signum(a) == F.signum(b)) | ((a == 0) & (b == 0))
    elif mode == "band":
        hit = ((b < -eps) == (a < -eps)) | ((b > eps) == (a > eps))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    share = F.avg(hit.cast("double"))
    value = F.when(F.count(F.lit(1)) < 10, lit(0.5)).otherwise(share) if mode == "sign" else share
    return finite_pairs(df, y, yhat).groupBy(*by).agg(value.alias("direction_accuracy"))


def mse_mae(df: DataFrame, y: str, yhat: str, min_rows: int = 5, *, by: Sequence[str] = FOLD) -> DataFrame:
    e = F.col(y) - F.col(yhat)
    n = F.count(F.lit(1))
    return finite_pairs(df, y, yhat).groupBy(*by).agg(
        n.alias("n"), F.when(n >= min_rows, F.avg(e * e)).alias("mse"), F.when(n >= min_rows, F.avg(F.abs(e))).alias("mae"))


def qlike_of(y: Column, p: Column, mode: str) -> Column:
    """Row loss: ratio form, form on volatilities, or form on variances."""
    if mode == "ratio":
        r = y / F.greatest(p, lit(1e-10))
        return F.ln(r) + lit(1) / F.greatest(r, lit(1e-10))
    if mode == "vol":
        h = F.greatest(p * p, lit(1e-8))
        return F.ln(h) + y * y / h
    if mode == "variance":
        h = F.greatest(p, lit(1e-8))
        return F.ln(h) + F.greatest(y, lit(1e-8)) / h
    raise ValueError(f"unknown mode {mode!r}")


def qlike(df: DataFrame, y: str, yhat: str, mode: str = "variance", *, by: Sequence[str] = FOLD) -> DataFrame:
    return finite_pairs(df, y, yhat).groupBy(*by).agg(F.avg(qlike_of(F.col(y), F.col(yhat), mode)).alias("qlike"))


def loss_metrics(
    df: DataFrame, y: str, yhat: str, delta: float = 1.0, tau: float = 0.5, alpha: float = 0.5, *, by: Sequence[str] = FOLD,
) -> DataFrame:
    """MSE, MAE, Huber, pinball (target minus prediction), logistic loss on logits, and the
    direction-weighted absolute error."""
    a, b = F.col(y), F.col(yhat)
    e, size = b - a, F.abs(b - a)
    huber = F.when(size <= delta, lit(0.5) * e * e).otherwise(lit(delta) * (size - lit(0.5 * delta)))
    pinball = F.greatest(lit(tau) * (a - b), lit(tau - 1) * (a - b))
    up = (a > 0).cast("double")
    logloss = F.greatest(b, lit(0)) - b * up + F.log1p(F.exp(-F.abs(b)))
    weight = F.exp(F.when(F.signum(a) == F.signum(b), lit(-alpha)).otherwise(lit(alpha)))
    return finite_pairs(df, y, yhat).groupBy(*by).agg(
        F.avg(e * e).alias("mse"), F.avg(size).alias("mae"), F.avg(huber).alias("huber"), F.avg(pinball).alias("pinball"),
        F.avg(logloss).alias("logloss"), F.avg(size * weight).alias("gmadl"))


def composite_loss_value(
    df: DataFrame, y: str, yhat: str, w_mse: float = 1.0, w_pinball: float = 0.1, w_direction: float = 1.0,
    w_l2: float = 0.0, w_sharpe: float = 0.0, tau: float = 0.05, *, by: Sequence[str] = FOLD,
) -> DataFrame:
    """Weighted MSE + pinball + direction cross-entropy + L2 - Sharpe of tanh positions."""
    losses = loss_metrics(df, y, yhat, tau=tau, by=by).select(*by, "mse", "pinball", "logloss")
    more = finite_pairs(df, y, yhat).groupBy(*by).agg(
        F.avg(F.col(yhat) * F.col(yhat)).alias("l2"), damped_sharpe(F.tanh(yhat) * F.col(y)).alias("sharpe"))
    value = (lit(w_mse) * F.col("mse") + lit(w_pinball) * F.col("pinball") + lit(w_direction) * F.col("logloss")
             + lit(w_l2) * F.col("l2") - lit(w_sharpe) * F.col("sharpe"))
    return losses.join(more, list(by)).select(*by, value.alias("loss"))


def rank_composite_value(
    df: DataFrame, y: str, yhat: str, previous: str | None = None, alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.2,
    temperature: float = 0.1, *, by: Sequence[str] = FOLD,
) -> DataFrame:
    """alpha * MSE + beta * (1 - soft rank IC) + gamma * turnover; turnover is the squared
    change from ``previous``, or the squared prediction without it."""
    from barloom.operators.scoring import rankic_value

    ic = rankic_value(df, y, yhat, temperature, by=by)
    moved = F.col(yhat) - (F.col(previous) if previous else lit(0))
    e = F.col(yhat) - F.col(y)
    means = df.groupBy(*by).agg(F.avg(e * e).alias("_mse"), F.avg(moved * moved).alias("_move"))
    value = lit(alpha) * F.col("_mse") + lit(beta) * F.col("rankic_loss") + lit(gamma) * F.coalesce("_move", lit(0))
    return means.join(ic, list(by)).select(*by, value.alias("loss"))


# ---- return series -----------------------------------------------------------------------

def damped_sharpe(r: Column) -> Column:
    """Sharpe with 1e-6 added to the sample variance; 0 under two rows or without variance."""
    v = F.var_samp(r)
    return F.when((F.count(r) < 2) | (v < 1e-12), lit(0)).otherwise(F.sqrt(lit(ANNUAL)) * F.avg(r) / F.sqrt(v + lit(1e-6)))


def sharpe(df: DataFrame, ret: str, mode: str = "pop", rf: float = 0.0, *, by: Sequence[str] = ("strategy",)) -> DataFrame:
    value = damped_sharpe(F.col(ret)) if mode == "damped" else sharpe_of(F.col(ret), mode, rf)
    return df.groupBy(*by).agg(value.alias("sharpe"))


def sortino(df: DataFrame, ret: str, *, by: Sequence[str] = ("strategy",)) -> DataFrame:
    return df.groupBy(*by).agg(sortino_of(F.col(ret)).alias("sortino"))


def win_rate(df: DataFrame, ret: str, *, by: Sequence[str] = ("strategy",)) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"))


def equity_curve(df: DataFrame, ret: str, out: str = "equity", *, by: Sequence[str] = ("strategy",), time=TIME, longest: int | None = None) -> DataFrame:
    """Running product of 1 + r as the exponential of summed logs, with the sign and zeros
    carried beside it."""
    g = lit(1) + F.coalesce(F.col(ret), lit(0))
    parts = {
        "_ln": ("sum", F.when(g == 0, lit(0)).otherwise(F.ln(F.abs(g)))),
        "_neg": ("sum", (g < 0).cast("int")), "_zero": ("max", (g == 0).cast("int"))}
    run = running(df, parts, by=by, time=time, longest=longest)
    sign = F.when(F.col("_neg") % 2 == 1, lit(-1)).otherwise(lit(1))
    return run.withColumn(out, F.when(F.col("_zero") == 1, lit(0)).otherwise(sign * F.exp("_ln"))).drop(*parts)


def returns_from_equity(df: DataFrame, equity: str = "equity", out: str = "ret", *, by: Sequence[str] = ("strategy",), time=TIME) -> DataFrame:
    prev = lambda t: F.coalesce(F.lag(equity).over(t.w), lit(1))
    return along_time(df, {out: lambda t: F.try_divide(F.col(equity), prev(t)) - 1}, by=by, time=time, back=1)


def drawdowns(df: DataFrame, equity: str = "equity", *, by: Sequence[str] = ("strategy",), time=TIME, longest: int | None = None) -> DataFrame:
    """Running peak and relative distance from it."""
    run = running(df, {"peak": ("max", F.col(equity))}, by=by, time=time, longest=longest)
    return run.withColumn("drawdown", F.try_divide(F.col(equity) - F.col("peak"), F.col("peak")))


def max_drawdown(df: DataFrame, equity: str = "equity", mode: str = "signed", *, by: Sequence[str] = ("strategy",), time=TIME) -> DataFrame:
    """Deepest drawdown and the time of its trough; ``magnitude`` gives a positive size and
    also the time of the peak before it."""
    dd = drawdowns(df, equity, by=by, time=time)
    low = F.min_by(F.struct(F.col("drawdown").alias("d"), F.col(time).alias("t"), F.col("peak").alias("p")),
                   F.struct("drawdown", time))
    out = dd.groupBy(*by).agg(low.alias("_l"))
    if mode == "signed":
        return out.select(*by, F.col("_l.d").alias("max_drawdown"), F.col("_l.t").alias("trough"))
    whole = dd.join(out, list(by)) if by else dd.withColumn("_l", out.select("_l").scalar())
    peak = whole.groupBy(*by).agg(
        F.first("_l").alias("_l"),
        F.min(F.when((F.col(equity) == F.col("_l.p")) & (F.col(time) <= F.col("_l.t")), F.col(time))).alias("peak_at"))
    return peak.select(*by, F.abs("_l.d").alias("max_drawdown"), "peak_at", F.col("_l.t").alias("trough"))


def rolling_sharpe(df: DataFrame, ret: str, window: int = 252, out: str = "rolling_sharpe", *, by: Sequence[str] = ("strategy",), time=TIME, longest: int | None = None) -> DataFrame:
    r = F.col(ret)

    def value(t):
        w = t.last(window)
        sd = F.stddev_pop(r).over(w)
        flat = (F.count(r).over(w) < 20) | (sd < 1e-10)
        v = F.when(flat, lit(0)).otherwise(F.avg(r).over(w) / F.nullif(sd, lit(0)) * F.sqrt(lit(ANNUAL)))
        return F.when(t.pos >= window - 1, v)

    return along_time(df, {out: value}, by=by, time=time, back=window - 1, longest=longest)


def performance_table(
    df: DataFrame, equity: str = "equity", ret: str = "ret", window: int = 252, min_rows: int = 20,
    oos_start=None, *, by: Sequence[str] = ("strategy",), time=TIME,
) -> DataFrame:
    """Total, annual and rolling statistics per strategy, over the full and the
    out-of-sample period.  Input is one row per (strategy, date)."""
    periods = [F.lit("full")] + ([] if oos_start is None else [F.when(F.col(time) >= F.lit(oos_start), F.lit("oos"))])
    rows = df.withColumn("period", F.explode(F.array_compact(F.array(*periods))))
    keys, size = [*by, "period"], longest_group(df, by)
    rows = drawdowns(rows, equity, by=keys, time=time, longest=size)
    rows = rolling_sharpe(rows, ret, window, "_rs", by=keys, time=time, longest=size)
    first, last = F.min_by(equity, time), F.max_by(equity, time)
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), (last / first - 1).alias("total_return"),
        (F.pow(last / first, lit(ANNUAL) / F.count(F.lit(1))) - 1).alias("annual_return"),
        (F.stddev_pop(ret) * F.sqrt(lit(ANNUAL))).alias("annual_volatility"),
        sharpe_of(F.col(ret), "strict").alias("sharpe_ratio"), F.abs(F.min("drawdown")).alias("max_drawdown"),
        *[F.coalesce(f("_rs"), lit(0)).alias(f"rolling_sharpe_{n}")
          for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])
    calmar = F.when(F.col("max_drawdown") < 1e-8, lit(0)).otherwise(
        F.col("annual_return") / F.nullif(F.col("max_drawdown"), lit(0)))
    return base.filter(F.col("n_days") >= min_rows).withColumn("calmar_ratio", calmar)


def performance_deltas(table: DataFrame, strategy: str, benchmark: str) -> DataFrame:
    """Strategy less benchmark per period."""
    pick = lambda c, s: F.max(F.when(F.col("strategy") == s, F.col(c)))
    names = {"sharpe_ratio": "sharpe_delta", "annual_return": "return_delta", "annual_volatility": "vol_delta", "max_drawdown": "mdd_delta"}
    return table.groupBy("period").agg(*[(pick(c, strategy) - pick(c, benchmark)).alias(n) for c, n in names.items()])


def strategy_sharpe_of_positions(df: DataFrame, pred: str, actual: str, form: str = "tanh", *, by: Sequence[str] = FOLD) -> DataFrame:
    """Sharpe of tanh(pred) * actual or sign(pred) * actual."""
    pos = F.tanh(pred) if form == "tanh" else F.signum(pred)
    return df.groupBy(*by).agg(damped_sharpe(pos * F.col(actual)).alias("sharpe"))


def portfolio_sharpe(df: DataFrame, weight: str, ret: str, risk_free: float = 0.02, freq: int = 252, *, by: Sequence[str] = FOLD, time=TIME) -> DataFrame:
    """(mean of sum(w * r) per date less rf / freq) over (population deviation + 1e-8)."""
    daily = df.groupBy(*by, time).agg(F.sum(F.col(weight) * F.col(ret)).alias("_p"))
    return daily.groupBy(*by).agg(((F.avg("_p") - lit(risk_free / freq)) / (F.stddev_pop("_p") + lit(1e-8))).alias("sharpe"))


# ---- tables over folds, models, symbols ---------------------------------------------------

def hit_rate_by_decile(df: DataFrame, signal: str, ref: str, *, by: Sequence[str] = ()) -> DataFrame:
    binned = signal_deciles(df, signal, by=by)
    hit = (F.signum(signal) == F.signum(ref)).cast("double")
    return binned.filter("decile is not null").groupBy(*by, "decile").agg(
        F.avg(hit).alias("hit_rate"), F.count(F.lit(1)).alias("count"), F.avg(signal).alias("mean_signal"),
        (F.avg(hit) * 100).alias("hit_rate_pct"))


def fold_summary(df: DataFrame, metrics: Sequence[str], *, by: Sequence[str] = ("model", "horizon")) -> DataFrame:
    """mean / population deviation / min / max of fold metrics per group."""
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), *aggs)


def cross_seed_summary(df: DataFrame, metric: str, *, by: Sequence[str] = ("model", "horizon"), seed: str = "seed") -> DataFrame:
    """Mean over folds per seed first, then mean and deviation over seeds."""
    per_seed = df.groupBy(*by, seed).agg(F.avg(metric).alias("_m"))
    return per_seed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("_m").alias(f"{metric}_mean"), F.stddev_pop("_m").alias(f"{metric}_std"))


def per_symbol_ic_distribution(df: DataFrame, ic: str = "ic", probs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9), *, by: Sequence[str] = ()) -> DataFrame:
    base = df.groupBy(*by).agg(
        F.count(ic).alias("n_symbols"), F.count_if(F.col(ic) > 0).alias("n_positive"), F.avg(ic).alias("ic_mean"),
        F.stddev_pop(ic).alias("ic_std"), F.min(ic).alias("ic_min"), F.max(ic).alias("ic_max"),
        F.avg((F.col(ic) > 0).cast("double")).alias("positive_share"))
    cuts = quantiles(df, by, ic, probs, "_q")
    both = base.join(cuts, list(by)) if by else base.withColumn("_q", cuts.scalar())
    return both.withColumns({f"p{int(round(p * 100))}": F.col("_q")[i] for i, p in enumerate(probs)}).drop("_q")


def predictor_ranks(df: DataFrame, predictors: Sequence[str], a: str, b: str, *, by: str = "symbol") -> DataFrame:
    """Wide table of losses per symbol -> per predictor: mean rank (0 best), mean, median and
    deviation of the loss, and the share of symbols where ``a`` beats ``b``."""
    ok = df.filter(finite(a) & finite(b))
    better = ok.agg(F.avg((F.col(a) < F.col(b)).cast("double"))).scalar()
    cells = F.array_sort(F.array(*[F.struct(F.col(p).alias("loss"), F.lit(i).alias("i"), F.lit(p).alias("predictor")) for i, p in enumerate(predictors)]))
    ranks = ok.select(F.posexplode(cells).alias("place", "c")).groupBy(F.col("c.predictor").alias("predictor")).agg(F.avg("place").alias("mean_rank"))
    long = df.unpivot([by], list(predictors), "predictor", "loss").filter(finite("loss"))
    stats = long.groupBy("predictor").agg(
        F.avg("loss").alias("mean_loss"), F.stddev_pop("loss").alias("std_loss"), F.count(F.lit(1)).alias("n_valid"))
    middle = quantiles(long, ["predictor"], "loss", [0.5], "_q").select("predictor", F.col("_q")[0].alias("median_loss"))
    return stats.join(middle, "predictor").join(ranks, "predictor").withColumn("share_a_beats_b", better)


def model_comparison(
    df: DataFrame, models: Sequence[str], ret: str, top_k: int = 10, bottom_k: int = 10, *, time=TIME,
) -> DataFrame:
    """Total return, Sharpe, drawdown and win rate of the rank positions of each model."""
    from barloom.operators.portfolio import rank_positions

    keep = list(dict.fromkeys([time, "symbol", ret]))
    source = df.select(*keep, *models) if ret not in models else df.withColumn("_ret", F.col(ret)).select(time, "symbol", "_ret", *models)
    ret = ret if ret not in models else "_ret"
    long = source.unpivot([time, "symbol", ret], list(models), "strategy", "signal")
    held = rank_positions(long, "signal", top_k, bottom_k, by=("strategy", time))
    pnl = held.groupBy("strategy", time).agg(F.avg(F.when(F.col("position") != 0, F.col("position") * F.col(ret))).alias("r"))
    pnl = pnl.withColumn("r", F.coalesce("r", lit(0)))
    size = df.select(time).distinct().count()
    eq = drawdowns(equity_curve(pnl, "r", time=time, longest=size), time=time, longest=size)
    return eq.groupBy("strategy").agg(
        (F.max_by("equity", time) - 1).alias("total_return"), sharpe_of(F.col("r"), "eps").alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"))


