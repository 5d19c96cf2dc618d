"""Cross-sectional (by-date) features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import lit
from barloom.functions.grouping import attach, average_rank, group_stats, quantiles

TIME = "date"


def cs_zscore(
    df: DataFrame, cols: Sequence[str], prefix: str = "cs_z_", keep_means: dict[str, str] | None = None, *, time=TIME,
) -> DataFrame:
    """(x - mean) / max(population deviation, 1e-8) on the date; NULL becomes 0.

    ``keep_means`` also keeps the date mean of a column under another name.
    """
    aggs = {}
    for c in cols:
        aggs[f"_m_{c}"], aggs[f"_s_{c}"] = F.avg(c), F.stddev_pop(c)
    out = group_stats(df, [time], **aggs)
    return out.withColumns({
        f"{prefix}{c}": F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), lit(1e-8)), lit(0))
        for c in cols
    } | {name: F.col(f"_m_{c}") for c, name in (keep_means or {}).items()}).drop(*aggs)


def params_zscore(df: DataFrame, params: DataFrame, cols: Sequence[str], prefix: str = "cs_z_") -> DataFrame:
    """The same score from fitted pooled parameters (feature, mean, std), a table of one row per feature."""
    packed = params.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std"))))).scalar()
    fitted = df.withColumn("_p", packed)
    return fitted.withColumns({
        f"{prefix}{c}": F.coalesce(
            (F.col(c) - F.col("_p")[c]["mean"]) / F.greatest(F.col("_p")[c]["std"], lit(1e-8)), lit(0))
        for c in cols
    }).drop("_p")


def cs_pct_rank(
    df: DataFrame, cols: Sequence[str], prefix: str = "cs_rank_", fill: float | None = 0.0, *, time=TIME,
    longest: int | None = None,
) -> DataFrame:
    """Average-tie rank over the number of valid names on the date; 0 where NULL or alone."""
    names = [f"_rk_{c}" for c in cols]
    out = average_rank(df, [time], cols, names, counts=True, longest=longest)
    value = lambda n: F.when(F.col(f"{n}_n") > 1, F.col(n) / F.col(f"{n}_n"))
    filled = (lambda c: c) if fill is None else (lambda c: F.coalesce(c, lit(fill)))
    return out.withColumns({f"{prefix}{c}": filled(value(n)) for c, n in zip(cols, names)}).drop(
        *names, *[f"{n}_n" for n in names])


def market_return(df: DataFrame, ret: str = "simple_return", out: str = "market_return", *, time=TIME) -> DataFrame:
    """Equal-weight mean return per date."""
    return df.groupBy(time).agg(F.avg(ret).alias(out))


def fit_pooled_params(df: DataFrame, cols: Sequence[str], where=None) -> DataFrame:
    """Pooled mean and population deviation per feature, deviation floored at 1e-8."""
    source = df if where is None else df.filter(where)
    aggs = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"),
                     F.greatest(F.stddev_pop(c), lit(1e-8)).alias("std")) for c in cols]
    return source.agg(F.array(*aggs).alias("p")).select(F.inline("p"))


def signal_zscore(df: DataFrame, signal: str, out: str = "signal_z", *, time=TIME) -> DataFrame:
    """z-score across names with the sample deviation."""
    scored = group_stats(df, [time], _m=F.avg(signal), _s=F.stddev_samp(signal))
    return scored.withColumn(out, F.try_divide(F.col(signal) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def group_quantile_labels(
    df: DataFrame, y: str, n_bins: int = 5, out: str = "relevance", *, by: Sequence[str] = (TIME,),
) -> DataFrame:
    """Relevance label 0..n_bins-1 by interpolated quantiles of the group; -1 when NULL or
    the group has fewer than ``n_bins`` values."""
    cuts = quantiles(df.filter(F.col(y).isNotNull()), by, y, [i / n_bins for i in range(n_bins + 1)], "_cuts")
    sizes = df.groupBy(*by).agg(F.count(y).alias("_n"))
    joined = attach(attach(df, sizes, by), cuts, by)
    edges = F.array_distinct("_cuts")
    lower = F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(1)))
    label = F.size(F.filter(lower, lambda e: e <= F.col(y))) - 1
    label = F.least(F.greatest(label, F.lit(0)), F.lit(n_bins - 1))
    ok = F.col(y).isNotNull() & (F.col("_n") >= n_bins)
    return joined.withColumn(out, F.when(ok, label).otherwise(-1)).drop("_n", "_cuts")


def signal_deciles(
    df: DataFrame, signal: str, n: int = 10, out: str = "decile", *, by: Sequence[str] = (),
) -> DataFrame:
    """Quantile bin 1..n with right-closed edges (the first bin includes its lower edge)."""
    cuts = quantiles(df.filter(F.col(signal).isNotNull()), by, signal, [i / n for i in range(1, n)], "_cuts")
    if by:
        joined = attach(df, cuts, by)
    else:
        joined = df.withColumn("_cuts", cuts.scalar())
    bin_ = F.size(F.filter("_cuts", lambda e: e < F.col(signal))) + 1
    return joined.withColumn(out, F.when(F.col(signal).isNotNull(), bin_)).drop("_cuts")
