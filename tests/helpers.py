import datetime as dt

import numpy as np
import pandas as pd


def walk(n_symbols=4, n_days=120, seed=1, hot=0):
    """Random-walk bars with gaps; symbol S0 has ``hot`` more days than the others."""
    rng = np.random.default_rng(seed)
    frames = []
    for i in range(n_symbols):
        n = n_days + (hot if i == 0 else 0)
        days = np.sort(rng.choice(np.arange(n * 2), n, replace=False))
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        frames.append(pd.DataFrame({
            "symbol": f"S{i}", "date": [dt.date(2020, 1, 1) + dt.timedelta(days=int(d)) for d in days],
            "close": close, "volume": rng.integers(1, 50, n).astype(float)}))
    return pd.concat(frames, ignore_index=True)


def table(df, keys=("symbol", "date")):
    pdf = df.toPandas() if hasattr(df, "toPandas") else df
    return pdf.sort_values(list(keys)).reset_index(drop=True)


def same(a, b, keys=("symbol", "date"), tol=1e-9):
    a, b = table(a, keys), table(b, keys)
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(a.columns)], check_dtype=False, rtol=tol, atol=tol)
