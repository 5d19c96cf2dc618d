"""Times the headline queries on $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barloom.registry import load_all  # noqa: E402
from barloom.session import local_session  # noqa: E402

HEADLINE = (
    "win08_base_features", "xs06_enhanced_feature_set", "prj06_vol_adjusted_return", "win03_rsi_wilder", "win09_ewm_vol",
    "win13_amihud_illiquidity", "xs02_cs_pct_rank", "lab01_triple_barrier_events", "lab05_avg_uniqueness", "spl08_fold_expand",
    "fit01_ridge_fit", "fit02_ridge_per_symbol", "fit05_walk_forward_score", "fit10_grad_histogram", "eval01_spearman_ic",
    "eval02_daily_ic_series", "pf02_long_short_pooled", "pf03_long_short_daily", "pf10_regime_backtest", "led01_fills_to_positions",
    "eval03_rolling_ic", "fit20_blend_rolling_ic", "win30_garch_filter", "eval27_permutation_test",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    cases = load_all()
    cases["prj01_simple_return"].query(spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in HEADLINE:
        start = time.time()
        cases[name].query(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
