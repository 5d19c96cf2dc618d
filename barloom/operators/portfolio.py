"""Positions, weights and backtests on long (date, symbol) tables.

Selections that need a total order break ties by symbol; NULL signals are left out first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ANNUAL, lit, sharpe_of, sortino_of
from barloom.functions.grouping import (
    along_time, attach, average_rank, group_stats, longest_group, ordered, positions,
)
from barloom.operators.metrics import drawdowns, equity_curve
from barloom.operators.panel import date_index, finite

TIME = "date"


def rank_positions(
    df: DataFrame, signal: str, top_k: int = 10, bottom_k: int = 10, out: str = "position", *, by: Sequence[str] = (TIME,),
) -> DataFrame:
    """+1 for average rank <= k from the top, -1 for rank > n - k, else 0; k is at most n // 2."""
    rows = df.filter(F.col(signal).isNotNull())
    low = average_rank(rows, by, [signal], ["_r"], counts=True)
    rank = F.col("_r_n") + 1 - F.col("_r")  # descending average rank
    half = F.floor(F.col("_r_n") / 2)
    tk, bk = F.least(F.lit(top_k), half), F.least(F.lit(bottom_k), half)
    pos = F.when(rank > F.col("_r_n") - bk, -1).when(rank <= tk, 1).otherwise(0)
    return low.withColumn(out, pos).drop("_r", "_r_n")


def long_short_pooled(df: DataFrame, pred: str, y: str, frac: float = 0.2, *, by: Sequence[str] = ("fold",), tie: Sequence[str] = ("symbol", TIME)) -> DataFrame:
    """Sharpe of the bag of negated bottom and plain top returns of the pooled fold."""
    rows = df.filter(finite(pred) & finite(y))
    placed = ordered(rows, by, [pred, *tie], out="_k", total="_n")
    cut = F.greatest(F.floor(F.col("_n") * lit(frac)), F.lit(1))
    legs = F.array_compact(F.array(F.when(F.col("_k") <= cut, -F.col(y)), F.when(F.col("_k") > F.col("_n") - cut, F.col(y))))
    bag = placed.select(*by, F.explode(legs).alias("_r"))
    return bag.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trades"), sharpe_of(F.col("_r"), "pop").alias("sharpe"))


def long_short_daily(
    df: DataFrame, pred: str, y: str, frac: float = 0.2, n_names: int | None = None, *, by: Sequence[str] = (), time=TIME,
) -> DataFrame:
    """Per date mean of the top K less mean of the bottom K, K = max(1, int(frac * N)); 0 when
    fewer than 2K names are valid.  N is ``n_names`` or the number of rows on the date."""
    keys = [*by, time]
    sized = df.withColumn("_all", F.lit(n_names)) if n_names else group_stats(df, keys, _all=F.count(F.lit(1)))
    cut = F.greatest(F.floor(F.col("_all") * lit(frac)), F.lit(1))
    ok = sized.filter(finite(pred) & finite(y)).withColumn("_cut", cut)
    placed = ordered(ok, keys, [pred, "symbol"], out="_k", total="_n")
    top = F.avg(F.when(F.col("_k") > F.col("_n") - F.col("_cut"), F.col(y)))
    low = F.avg(F.when(F.col("_k") <= F.col("_cut"), F.col(y)))
    daily = placed.groupBy(*keys).agg(F.when(F.max("_n") >= 2 * F.max("_cut"), top - low).otherwise(lit(0)).alias("ret"))
    return attach(df.select(*keys).distinct(), daily, keys).withColumn("ret", F.coalesce("ret", lit(0)))


def long_short_summary(daily: DataFrame, ret: str = "ret", min_days: int = 20, *, by: Sequence[str] = (), time=TIME) -> DataFrame:
    """Sharpe, Sortino, drawdown, mean and deviation of a daily series; zeros for a short one."""
    size = longest_group(daily, by)
    eq = drawdowns(equity_curve(daily, ret, by=by, time=time, longest=size), by=by, time=time, longest=size)
    n, r = F.count(F.lit(1)), F.col(ret)
    aggs = {"sharpe": sharpe_of(r, "sample"), "sortino": sortino_of(r), "max_dd": F.min("drawdown"), "mean_ret": F.avg(r), "vol": F.stddev_samp(r)}
    return eq.groupBy(*by).agg(n.alias("n_days"), *[F.when(n < min_days, lit(0)).otherwise(a).alias(c) for c, a in aggs.items()])


def top_picks(df: DataFrame, signal: str, n: int = 20, *, time=TIME, latest_only: bool = True) -> DataFrame:
    """The n strongest names, on the last date of the table."""
    rows = df.filter(F.col(signal).isNotNull())
    if latest_only:
        rows = rows.filter(F.col(time) == rows.agg(F.max(time)).scalar())
    return rows.orderBy(F.desc(signal), "symbol").limit(n)


def weights_equal_or_signal(df: DataFrame, signal: str, weighting: str = "equal", *, by: Sequence[str] = (TIME,), out: str = "weight") -> DataFrame:
    """1 / n, or (s - min + 0.01) normalised."""
    if weighting != "signal":
        return group_stats(df, by, _n=F.count(F.lit(1))).withColumn(out, lit(1) / F.col("_n")).drop("_n")
    sums = group_stats(df, by, _n=F.count(signal), _lo=F.min(signal), _s=F.sum(signal))
    total = F.col("_s") - F.col("_n") * F.col("_lo") + F.col("_n") * lit(0.01)
    return sums.withColumn(out, (F.col(signal) - F.col("_lo") + lit(0.01)) / total).drop("_n", "_lo", "_s")


def softmax_weights(df: DataFrame, pred: str, temperature: float = 1.0, out: str = "weight", *, by: Sequence[str] = (TIME,)) -> DataFrame:
    """softmax(pred / temperature) - 1 / N per date (weights sum to zero)."""
    temp = temperature if temperature > 0 else 1.0
    peak = group_stats(df, by, _hi=F.max(pred), _n=F.count(F.lit(1)))
    scaled = peak.withColumn("_e", F.exp((F.col(pred) - F.col("_hi")) / lit(temp)))
    total = group_stats(scaled, by, _s=F.sum("_e"))
    return total.withColumn(out, F.col("_e") / F.col("_s") - lit(1) / F.col("_n")).drop("_hi", "_n", "_e", "_s")


def softmax_portfolio_sharpe(
    df: DataFrame, pred: str, y: str, temperature: float = 1.0, min_days: int = 10, *, by: Sequence[str] = (), time=TIME,
) -> DataFrame:
    """mean / (deviation + 1e-8) of the softmax portfolio; dates with a missing return are dropped."""
    keys = [*by, time]
    weighted = softmax_weights(df, pred, temperature, "_w", by=keys)
    daily = weighted.groupBy(*keys).agg(F.sum(F.col("_w") * F.col(y)).alias("_p"), F.count_if(F.col(y).isNull()).alias("_miss"))
    daily = daily.filter(F.col("_miss") == 0)
    value = F.when(F.count(F.lit(1)) < min_days, lit(0)).otherwise(sharpe_of(F.col("_p"), "raw"))
    return daily.groupBy(*by).agg(F.count(F.lit(1)).alias("n_days"), value.alias("sharpe"))


def inverse_vol_weights(df: DataFrame, vol: str, floor: float = 1e-8, out: str = "weight", *, by: Sequence[str] = (TIME,)) -> DataFrame:
    """1 / |vol| normalised over the selected names; names without a usable volatility get 0,
    and all get 1 / n when none has one."""
    inv = F.when(F.abs(F.col(vol)) >= floor, lit(1) / F.abs(F.col(vol)))
    sums = group_stats(df.withColumn("_i", inv), by, _s=F.sum("_i"), _n=F.count(F.lit(1)))
    some = F.coalesce(F.col("_s"), lit(0)) > 1e-10
    return sums.withColumn(out, F.when(some, F.coalesce("_i", lit(0)) / F.col("_s")).otherwise(lit(1) / F.col("_n"))).drop("_i", "_s", "_n")


# ---- regimes -----------------------------------------------------------------------------

def regime_classify(df: DataFrame, ret: str = "market_return", vol_lookback: int = 63, trend_lookback: int = 126, out: str = "regime", *, by: Sequence[str] = (), time=TIME, longest: int | None = None) -> DataFrame:
    """Regime of each date from the market returns before it."""
    sd = lambda t, n: F.stddev_pop(ret).over(t.between(-n, -1))
    mean = lambda t, n: F.avg(ret).over(t.between(-n, -1))

    def value(t):
        ratio = sd(t, vol_lookback) / F.greatest(sd(t, trend_lookback), lit(1e-6))
        trend = mean(t, 63) - mean(t, trend_lookback)
        return F.when(t.pos < trend_lookback, "normal").when(ratio > 1.3, "high_vol").when(
            trend > 0, "low_vol_trending").otherwise("low_vol_mean_reverting")

    return along_time(df, {out: value}, by=by, time=time, back=max(trend_lookback, vol_lookback, 63), longest=longest)


def regime_backtest(
    df: DataFrame, pred: str, price: str = "close", rebalance: int = 5, top_k: int = 100, *, time=TIME,
) -> DataFrame:
    """Daily strategy and benchmark returns of the regime-adaptive top-k portfolio.

    Weights are set every ``rebalance`` dates after the 126th from the signals of the date
    before, scaled by the regime, and held; before that, and for the benchmark, every name
    weighs 1 / N.  A name without a bar on a date earns nothing that day.
    """
    per_key, n_days = longest_group(df, ["symbol"]), df.select(time).distinct().count()
    rows = date_index(df, "_d", time=time, longest=n_days)
    rows = along_time(
        rows,
        {"_r": lambda t: F.coalesce(F.try_divide(F.col(price), F.lag(price).over(t.w)) - 1, lit(0))},
        {"_hv": lambda t: F.greatest(F.stddev_pop("_r").over(t.last(63)), lit(1e-6))},
        time=time, back=63, longest=per_key)
    market = rows.groupBy(time, "_d").agg(F.avg("_r").alias("_m"), F.sum("_r").alias("_sum"))
    days = regime_classify(market, "_m", time=time, longest=n_days)
    n = df.agg(F.count_distinct("symbol")).scalar()
    start = 126 // rebalance * rebalance + rebalance
    # Signals of date d-1 rank the names for the rebalance on d.
    eve = rows.withColumn("_reb", F.col("_d") + 1).filter((F.col("_reb") % rebalance == 0) & (F.col("_reb") >= start))
    sized = group_stats(eve, ["_reb"], _valid=F.count(pred))
    best = Window.partitionBy("_reb").orderBy(F.desc_nulls_last(pred), "symbol")
    enough = F.col("_valid") >= top_k
    top = sized.filter(enough).withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= top_k).drop("_k")
    picks = top.unionByName(sized.filter(~enough))
    regimes = days.select(F.col("_d").alias("_reb"), "regime")
    held = attach(picks, regimes, ["_reb"])
    base = F.when(enough, lit(1) / lit(top_k)).otherwise(lit(1) / n)
    held = group_stats(held, ["_reb"], _inv=F.sum(lit(1) / F.col("_hv")))
    weight = F.when(F.col("regime") == "high_vol", lit(1) / F.col("_hv") / F.col("_inv")).when(
        F.col("regime") == "low_vol_mean_reverting", base * lit(0.5)).otherwise(base)
    weights = held.select(F.col("_reb"), "symbol", weight.alias("_w"))
    live = F.floor(F.col("_d") / rebalance) * rebalance
    traded = attach(rows.filter(F.col("_d") >= start).withColumn("_reb", live.cast("int")), weights, ["_reb", "symbol"], "inner")
    strat = traded.groupBy("_d").agg(F.sum(F.col("_w") * F.col("_r")).alias("_s"))
    out = attach(days, strat, ["_d"])
    bench = F.col("_sum") / n
    early = F.col("_d") < start
    return out.filter(F.col("_d") > 0).select(
        time, F.col("_d").alias("day"), "regime", ((F.col("_d") % rebalance == 0) & ~early).alias("rebalanced"),
        F.when(early, bench).otherwise(F.coalesce("_s", lit(0))).alias("strategy_return"), bench.alias("benchmark_return"))


def regime_performance(returns: DataFrame, ret: str = "strategy_return", rebalance: int = 5) -> DataFrame:
    """Sharpe, count and annualised mean of the days held after each rebalance, per regime of
    that rebalance, and how often the regime was drawn."""
    first = returns.filter("rebalanced").select((F.col("day")).alias("_reb"), F.col("regime").alias("_g"))
    held = returns.withColumn("_reb", (F.floor(F.col("day") / rebalance) * rebalance).cast("int")).filter(F.col("day") != F.col("_reb"))
    joined = attach(held, first, ["_reb"], "inner")
    perf = joined.groupBy(F.col("_g").alias("regime")).agg(
        sharpe_of(F.col(ret), "pop").alias("sharpe"), F.count(F.lit(1)).alias("n_periods"), (F.avg(ret) * lit(ANNUAL)).alias("mean_return"))
    counts = first.groupBy(F.col("_g").alias("regime")).agg(F.count(F.lit(1)).alias("n_rebalances"))
    return counts.join(perf, "regime", "left")


# ---- liquidity / volatility strategy ----------------------------------------------------------

def liquidity_vol_weights(
    df: DataFrame, pred_vol: str, liquidity: str, top_k: int = 50, rebalance: int = 5, *, time=TIME,
    n_days: int | None = None,
) -> DataFrame:
    """(rebalance day, symbol) weights: the most liquid names, by inverse predicted volatility
    or equally where no name has a prediction."""
    rows = date_index(df, "_d", time=time, longest=n_days)
    last = rows.agg(F.max("_d")).scalar()
    at = rows.filter((F.col("_d") % rebalance == 0) & (F.col("_d") < last) & (F.col(liquidity) > 0))
    w = Window.partitionBy("_d").orderBy(F.desc(liquidity), "symbol")
    top = at.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= top_k)
    weighted = inverse_vol_weights(top, pred_vol, by=["_d"])
    return group_stats(weighted, ["_d"], _n=F.count(F.lit(1))).select(
        F.col("_d").alias("reb"), "symbol", "weight", (lit(1) / F.col("_n")).alias("bench_weight"))


def turnover(weights: DataFrame, *, reb: str = "reb", weight: str = "weight", longest: int | None = None) -> DataFrame:
    """Half the absolute change of weights from the rebalance before; 0 for the first one."""
    seq = attach(weights, positions(weights.select(reb).distinct(), (), reb, "_i", longest=longest), [reb])
    old = seq.select((F.col("_i") + 1).alias("_i"), "symbol", F.col(weight).alias("_old"))
    both = seq.select("_i", "symbol", F.col(weight).alias("_new")).join(old, ["_i", "symbol"], "full")
    sums = both.groupBy("_i").agg((F.sum(F.abs(F.coalesce("_new", lit(0)) - F.coalesce("_old", lit(0)))) / 2).alias("_t"))
    index = seq.select(reb, "_i").distinct()
    return attach(index, sums, ["_i"]).select(reb, F.when(F.col("_i") == 0, lit(0)).otherwise(F.col("_t")).alias("turnover"))


def vol_target_overlay(
    df: DataFrame, ret: str = "benchmark_return", target: float = 0.15, lookback: int = 63, min_obs: int = 21,
    floor: float = 0.25, cap: float = 2.0, out: str = "vol_target_return", *, by: Sequence[str] = (), time=TIME,
    longest: int | None = None,
) -> DataFrame:
    """Return scaled by target over realised volatility (today included), inside [floor, cap]."""

    def value(t):
        vol = F.stddev_pop(ret).over(t.last(lookback)) * F.sqrt(lit(ANNUAL))
        lever = F.least(F.greatest(lit(target) / F.greatest(vol, lit(1e-10)), lit(floor)), lit(cap))
        return F.when(t.pos >= min_obs - 1, F.col(ret) * lever).otherwise(F.col(ret))

    return along_time(df, {out: value}, by=by, time=time, back=lookback - 1, longest=longest)


def liquidity_vol_backtest(
    df: DataFrame, pred_vol: str, liquidity: str, price: str = "close", top_k: int = 50, rebalance: int = 5, cost: float = 0.0,
    *, time=TIME,
) -> DataFrame:
    """Daily returns of the strategy, its equal-weight benchmark and the volatility-targeted
    benchmark.  Each day the weights are renormalised over the names that have a return to
    the next date; the cost is charged on rebalance days."""
    per_key, n_days = longest_group(df, ["symbol"]), df.select(time).distinct().count()
    rows = date_index(df.select(time, "symbol", price, liquidity, pred_vol), "_d", time=time, longest=n_days)
    days = rows.select(time, "_d").distinct()
    weights = liquidity_vol_weights(df, pred_vol, liquidity, top_k, rebalance, time=time, n_days=n_days)
    steps = along_time(
        rows, {"_r": lambda t: F.when(F.lead("_d").over(t.w) == F.col("_d") + 1, F.lead(price).over(t.w) / F.col(price) - 1)},
        time=time, ahead=1, longest=per_key)
    live = steps.withColumn("reb", (F.floor(F.col("_d") / rebalance) * rebalance).cast("int"))
    held = attach(live.filter(F.col("_r").isNotNull()), weights, ["reb", "symbol"], "inner")
    on = F.col("weight") > 0
    daily = held.groupBy("_d").agg(
        F.try_divide(F.sum(F.when(on, F.col("weight") * F.col("_r"))), F.sum(F.when(on, F.col("weight")))).alias("_s"),
        F.avg("_r").alias("_b"))
    charge = turnover(weights, longest=n_days).select(F.col("reb").alias("_d"), "turnover")
    line = attach(attach(days, daily, ["_d"]), charge, ["_d"])
    after = days.select((F.col("_d") - 1).alias("_d"), F.col(time).alias("_next"))
    line = attach(line, after, ["_d"], "inner")  # the last date has no return
    out = line.select(
        F.col("_next").alias(time), F.col("_d").alias("day"),
        (F.coalesce("_s", lit(0)) - lit(cost) * F.coalesce("turnover", lit(0))).alias("strategy_return"),
        F.coalesce("_b", lit(0)).alias("benchmark_return"))
    return vol_target_overlay(out, time=time, longest=n_days)


# ---- signal tables -----------------------------------------------------------------------------

def signal_table(
    df: DataFrame, models: Sequence[str], features: Sequence[str], min_rows: int = 130, *, time=TIME,
) -> DataFrame:
    """Per symbol on its last date: each model's prediction, their mean, the share of features
    present and the history length, with the cross-sectional z-score of the mean."""
    last = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_history"), F.max_by(F.struct(*df.columns), time).alias("_l"))
    rows = last.filter(F.col("n_history") >= min_rows)
    here = sum((F.col(f"_l.{f}").isNotNull().cast("double") for f in features), lit(0)) / lit(len(features))
    mean = sum((F.col(f"_l.{m}") for m in models), lit(0)) / lit(len(models))
    table = rows.select(
        "symbol", F.col(f"_l.{time}").alias(time), *[F.col(f"_l.{m}").alias(m) for m in models],
        mean.alias("ensemble"), here.alias("confidence"), "n_history")
    scored = group_stats(table, [], _m=F.avg("ensemble"), _s=F.stddev_samp("ensemble"))
    return scored.withColumn("cs_zscore", (F.col("ensemble") - F.col("_m")) / F.greatest("_s", lit(1e-8))).drop("_m", "_s")


def ensemble_signal_output(df: DataFrame, signal: str = "fused_signal", *, by: Sequence[str] = (TIME,)) -> DataFrame:
    """confidence = |signal| and the descending ordinal rank."""
    neg = df.withColumn("_s", -F.col(signal))
    return ordered(neg, by, ["_s", "symbol"], out="rank").withColumn("confidence", F.abs(signal)).drop("_s")
