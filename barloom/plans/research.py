"""The research run as one plan: bars -> features -> folds -> ridge -> metrics per fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.panel import date_index, valid_row_filter
from barloom.operators.returns import forward_return
from barloom.operators.rolling import momentum
from barloom.operators.cross import cs_pct_rank
from barloom.operators.scoring import evaluate_folds, linear_score, ridge_fit
from barloom.operators.splits import fold_expand, walk_forward_windows
from barloom.session import cut_lineage


def momentum_features(bars: DataFrame, periods: Sequence[int] = (5, 21)) -> tuple[DataFrame, list[str]]:
    """Momentum and its cross-sectional rank for each look-back."""
    mom = momentum(bars, periods=periods)
    names = [f"mom_{k}" for k in periods]
    return cs_pct_rank(mom, names), [*names, *[f"cs_rank_{n}" for n in names]]


def walk_forward_study(
    featured: DataFrame, features: Sequence[str], horizon: int = 5, train: int = 1008, val: int = 252, purge: int = 126, step: int = 126,
    alpha: float = 1.0,
) -> DataFrame:
    """IC, direction accuracy, long-short Sharpe and mean daily IC of every validation window."""
    rows = date_index(forward_return(featured, periods=horizon, out="target")).select(
        "symbol", "date", "date_idx", "target", *features)
    folds = walk_forward_windows(rows.select("date").distinct(), train, val, purge, step)
    expanded = valid_row_filter(fold_expand(rows, folds, roles=["train", "val"]), features, "target")
    # One small model per fold: with it sent to all tasks, the copies of rows are scored where they are made.
    models = F.broadcast(ridge_fit(expanded.filter(F.col("role") == "train"), features, "target", alpha))
    scored = linear_score(expanded.filter(F.col("role") == "val"), models, features)
    # Four metrics read the predictions: keep them once instead of scoring four times.
    kept = cut_lineage(scored.select("symbol", "date", "fold", "target", "pred"))
    return evaluate_folds(kept, "target")
