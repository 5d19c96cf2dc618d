"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANNUAL = 252.0


def lit(x: float) -> Column:
    return F.lit(float(x))


def clean(col: Column) -> Column:
    """NaN and infinities become NULL; every operator assumes this was done at ingest."""
    return F.when(~F.isnan(col) & (F.abs(col) < lit("inf")), col)


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def guarded_corr(x: Column, y: Column, w=None) -> Column:
    """Pearson correlation; NULL instead of an error when a side is constant."""
    on = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    spread = on(F.stddev_pop(px)) * on(F.stddev_pop(py))
    return on(F.covar_pop(px, py)) / F.nullif(spread, lit(0))


def sharpe_of(r: Column, mode: str = "pop", rf: float = 0.0) -> Column:
    """Annualised mean over deviation, as an aggregate.

    pop      population deviation floored at 1e-10, 0 under two rows
    sample   sample deviation, 0 under two rows or when it is below 1e-12
    eps      sample deviation plus 1e-10
    strict   population deviation of r - rf/252, 0 under twenty rows or below 1e-10
    raw      mean / (sample deviation + 1e-8), not annualised
    """
    n, root = F.count(r), F.sqrt(lit(ANNUAL))
    mean, pop, samp = F.avg(r), F.stddev_pop(r), F.stddev_samp(r)
    if mode == "pop":
        return F.when(n < 2, lit(0)).otherwise(mean / F.greatest(pop, lit(1e-10)) * root)
    if mode == "sample":
        return F.when((n < 2) | (samp < 1e-12), lit(0)).otherwise(mean / F.nullif(samp, lit(0)) * root)
    if mode == "eps":
        return mean / (samp + lit(1e-10)) * root
    if mode == "strict":
        return F.when((n < 20) | (pop < 1e-10), lit(0)).otherwise(
            (mean - lit(rf / ANNUAL)) / F.nullif(pop, lit(0)) * root
        )
    if mode == "raw":
        return mean / (samp + lit(1e-8))
    raise ValueError(f"unknown sharpe mode {mode!r}")


def sortino_of(r: Column) -> Column:
    down = F.when(r < 0, r)
    few = F.when(F.avg(r) > 0, lit("inf")).otherwise(lit(0))
    spread = F.stddev_samp(down)
    return (
        F.when(F.count(r) < 2, lit(0))
        .when(F.count(down) < 2, few)
        .when(spread < 1e-12, lit(0))
        .otherwise(F.avg(r) / F.nullif(spread, lit(0)) * F.sqrt(lit(ANNUAL)))
    )
