"""Scalar projections and targets: returns, forward targets, class labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import lit, ratio
from barloom.functions.grouping import along_time, group_stats

KEY, TIME = ("symbol",), "date"


def simple_return_of(price: str, t) -> Column:
    return F.coalesce(ratio(F.col(price), F.lag(price).over(t.w)) - 1, lit(0))


def log_return_of(price: str, t, scale: float = 1.0) -> Column:
    return F.coalesce(F.ln(ratio(F.col(price), F.lag(price).over(t.w))), lit(0)) * lit(scale)


def change_of(price: str, t, periods: int) -> Column:
    return ratio(F.col(price), F.lag(price, periods).over(t.w)) - 1


def forward_of(price: str, t, horizon: int) -> Column:
    return ratio(F.lead(price, horizon).over(t.w), F.col(price)) - 1


def simple_return(df: DataFrame, price: str = "close", out: str = "simple_return", *, by=KEY, time=TIME) -> DataFrame:
    """p_t / p_{t-1} - 1; the first row of a key is 0."""
    return along_time(df, {out: lambda t: simple_return_of(price, t)}, by=by, time=time, back=1)


def log_return(
    df: DataFrame, price: str = "close", scale: float = 1.0, out: str = "log_return", *, by=KEY, time=TIME,
) -> DataFrame:
    """ln(p_t / p_{t-1}) times ``scale``; the first row of a key is 0."""
    return along_time(df, {out: lambda t: log_return_of(price, t, scale)}, by=by, time=time, back=1)


def forward_return(
    df: DataFrame, price: str = "close", periods: int = 1, tail: str = "null", out: str = "forward_return",
    *, by=KEY, time=TIME,
) -> DataFrame:
    """p_{t+h} / p_t - 1; the last h rows are NULL, or 0 with ``tail='zero'``."""
    fill = (lambda c: F.coalesce(c, lit(0))) if tail == "zero" else (lambda c: c)
    return along_time(df, {out: lambda t: fill(forward_of(price, t, periods))}, by=by, time=time, ahead=periods)


def multi_horizon_targets(
    df: DataFrame, price: str = "close", horizons: Sequence[int] = (1, 5, 21), prefix: str = "target_",
    *, by=KEY, time=TIME,
) -> DataFrame:
    stage = {f"{prefix}{h}": (lambda t, h=h: forward_of(price, t, h)) for h in horizons}
    return along_time(df, stage, by=by, time=time, ahead=max(horizons))


def backward_return_target(
    df: DataFrame, price: str = "close", periods: int = 5, out: str = "backward_return", *, by=KEY, time=TIME,
) -> DataFrame:
    """p_t / p_{t-k} - 1 used as a target (it looks backward)."""
    return along_time(df, {out: lambda t: change_of(price, t, periods)}, by=by, time=time, back=periods)


def vol_adjusted_return(
    df: DataFrame, price: str = "close", horizon: int = 5, vol_period: int = 21, out: str = "vol_adjusted_return",
    *, by=KEY, time=TIME,
) -> DataFrame:
    """Forward return over the trailing population deviation of one-row returns."""
    return along_time(
        df,
        {"_r": lambda t: simple_return_of(price, t)},
        {"_rv": lambda t: F.when(t.pos >= vol_period, F.stddev_pop("_r").over(t.last(vol_period)))},
        {out: lambda t: forward_of(price, t, horizon) / F.when(
            F.col("_rv").isNotNull(), F.greatest(F.col("_rv"), lit(1e-6)))},
        by=by, time=time, back=vol_period, ahead=horizon, drop=("_r", "_rv"),
    )


def forward_realized_vol(
    df: DataFrame, price: str = "close", horizon: int = 21, out: str = "forward_vol", *, by=KEY, time=TIME,
) -> DataFrame:
    """Sample deviation of the next ``horizon`` returns; NULL unless all are present."""
    ahead = lambda t: t.between(1, horizon)
    return along_time(
        df,
        {"_r": lambda t: change_of(price, t, 1)},
        {out: lambda t: F.when(F.count("_r").over(ahead(t)) == horizon, F.stddev_samp("_r").over(ahead(t)))},
        by=by, time=time, back=1, ahead=horizon, drop=("_r",),
    )


# The pairs multiplied, and the names of the products.
INTERACTIONS = (
    ("rsi_14", "volume_ratio", "rsi_x_volratio"),
    ("sma_5", "rsi_14", "sma5_x_rsi"),
    ("bollinger_position", "rsi_14", "bollinger_x_rsi"),
)


def feature_interactions(df: DataFrame, pairs: Sequence[tuple[str, str, str]] = INTERACTIONS) -> DataFrame:
    return df.withColumns({out: F.col(a) * F.col(b) for a, b, out in pairs})


def demean_target_by_date(df: DataFrame, y: str, out: str = "y_demeaned", *, time=TIME) -> DataFrame:
    return group_stats(df, [time], _m=F.avg(y)).withColumn(out, F.col(y) - F.col("_m")).drop("_m")


def direction_class(df: DataFrame, y: str, out: str = "direction") -> DataFrame:
    """0 down, 1 flat, 2 up."""
    return df.withColumn(out, (F.signum(y) + 1).cast("int"))


def class_weights(df: DataFrame, label: str = "direction", classes: int = 3, eps: float = 1e-6) -> DataFrame:
    """total / (classes * (count + eps)) per class; empty when only one class is present."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = group_stats(counts, [], total=F.sum("n"), kinds=F.count(F.lit(1)))
    weight = F.col("total") / (lit(classes) * (F.col("n") + lit(eps)))
    return whole.filter("kinds > 1").select(label, "n", weight.alias("weight"))


def log_target_floor(df: DataFrame, squared: str, floor: float = 1e-8, out: str = "log_target") -> DataFrame:
    return df.withColumn(out, F.ln(F.greatest(F.col(squared), lit(floor))))


def exp_clipped(df: DataFrame, log_value: str, out: str = "variance", bound: float = 50.0) -> DataFrame:
    """Inverse of the log target, clipped before exponentiation."""
    return df.withColumn(out, F.exp(F.least(F.greatest(F.col(log_value), lit(-bound)), lit(bound))))
