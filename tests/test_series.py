import numpy as np
import pandas as pd

from barloom.operators import series as S


def frame(spark, arrays):
    return spark.createDataFrame(pd.concat([
        pd.DataFrame({"symbol": k, "date": np.arange(len(v)), "x": v}) for k, v in arrays.items()], ignore_index=True))


def plain_adf(y):
    n = len(y)
    k = min(max(1, int(np.floor(np.cbrt(n - 1)))), (n - 1) // 3)
    d = np.diff(y)
    x = np.array([[1, y[m], *d[m - k:m][::-1]] for m in range(k, len(d))])
    t = d[k:]
    beta = np.linalg.lstsq(x, t, rcond=None)[0]
    res = t - x @ beta
    se = np.sqrt(res @ res / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    return beta[1] / se, S.adf_p(beta[1] / se, len(t))


def test_adf_matches_regression(spark):
    rng = np.random.default_rng(42)
    data = {"walk": np.cumsum(rng.normal(size=500)), "noise": rng.normal(size=200), "short": rng.normal(size=8)}
    got = {r["symbol"]: r for r in S.adf_test(frame(spark, data), "x").collect()}
    for k in ("walk", "noise"):
        t, p = plain_adf(data[k])
        assert abs(got[k]["t_stat"] - t) < 1e-6 and abs(got[k]["p_value"] - p) < 1e-6
    assert got["noise"]["p_value"] < 0.05 < got["walk"]["p_value"] and got["short"]["p_value"] == 1


def test_min_d(spark):
    rng = np.random.default_rng(42)
    data = {"walk": np.cumsum(rng.normal(size=500)), "noise": rng.normal(size=300)}
    got = {r["symbol"]: r["min_d"] for r in S.find_min_d(frame(spark, data), "x", step=0.25, threshold=1e-2).collect()}
    assert got["noise"] == 0.0 and 0 < got["walk"] <= 1.0


def test_filter_bank_reconstructs():
    for n in (64, 65, 101, 256):
        x = np.random.default_rng(n).normal(size=n)
        a, d = S._analyse(x)
        assert len(a) == (n + 7) // 2 and np.allclose(S._synthesise(a, d)[:n], x)


def test_wavelet_jobs_equal_arrays(spark):
    rng = np.random.default_rng(7)
    data = {f"s{n}": np.cumsum(rng.normal(size=n)) for n in (100, 129, 257)}
    for mode in ("soft", "hard"):
        got = S.wavelet_denoise(frame(spark, data), "x", mode=mode).toPandas().sort_values("date")
        for k, v in data.items():
            assert np.allclose(got[got.symbol == k]["denoised"], S.denoise_array(v, mode=mode), atol=1e-9)


def test_causal_wavelet(spark):
    x = 50 + np.cumsum(np.random.default_rng(9).normal(size=90))
    got = S.causal_wavelet_denoise(frame(spark, {"a": x}), "x", min_window=40, rows=16).toPandas().sort_values("date")["denoised"].to_numpy()
    alpha, ema, want = 2 / 41, x[0], []
    for t in range(90):
        ema = alpha * x[t] + (1 - alpha) * ema
        want.append(ema if t < 40 else S.denoise_array(x[:t + 1])[-1])
    assert np.allclose(got, want, atol=1e-9)


def test_garch_recovers_parameters():
    rng = np.random.default_rng(11)
    h, out = 1.0, []
    for _ in range(4000):
        out.append(np.sqrt(h) * rng.normal())
        h = 0.1 + 0.1 * out[-1] ** 2 + 0.8 * h
    omega, alpha, beta = S.fit_garch(np.array(out))
    assert abs(alpha - 0.1) < 0.04 and abs(beta - 0.8) < 0.1 and abs(omega - 0.1) < 0.08


def test_garch_fallback(spark):
    from pyspark.sql import functions as F

    d = frame(spark, {"flat": np.zeros(150), "few": np.random.default_rng(1).normal(size=50)}).withColumns(
        {"fold": F.lit(0), "role": F.when(F.col("date") < 40, "train").otherwise("test")})
    fits = S.garch_fit(d, "x")
    assert all(r["degenerate"] for r in fits.collect())
    out = S.garch_forecast(d, fits, "x")
    assert out.count() == 120 and out.filter("forecast <= 0").count() == 0


def test_short_series_take_fewer_levels(spark):
    rng = np.random.default_rng(11)
    data = {k: rng.normal(size=n).cumsum() for k, n in (("b", 9), ("c", 12), ("d", 15), ("e", 16), ("f", 40))}
    got = S.wavelet_denoise(frame(spark, data), "x").toPandas().sort_values("date")
    for k, v in data.items():
        assert np.allclose(got[got.symbol == k]["denoised"], S.denoise_array(v), atol=1e-9), k


def test_garch_fits_together_as_alone(spark):
    """Many spans of several lengths, short and flat ones among them and a null key: each as if it were fitted alone."""
    def alone(x, rounds=7):
        x = x - x.mean()
        var, centre, width = float(np.var(x)), np.array([0.25, 0.5, 1.0]), np.array([0.25, 0.49, 0.5])
        for _ in range(rounds):
            a, b, s = (v.ravel() for v in np.meshgrid(*[np.linspace(c - w, c + w, 5) for c, w in zip(centre, width)]))
            ok = (a >= 0) & (b >= 0) & (a + b < 0.9999) & (s > 0.05)
            a, b, s = a[ok], b[ok], s[ok]
            omega, h, total = s * var * (1 - a - b), np.full(len(a), var), np.zeros(len(a))
            for v in x * x:
                total += np.log(h) + v / h
                h = omega + a * v + b * h
            best = int(np.argmin(total))
            centre, width = np.array([a[best], b[best], s[best]]), width * 0.5
        return centre[2] * var * (1 - centre[0] - centre[1]), centre[0], centre[1]

    rng, frames, want = np.random.default_rng(5), [], {}
    for i, n in enumerate([100, 173, 173, 40, 240, 101, 300] * 10):
        x = rng.normal(0, 0.02 * (1 + i % 3), n) if i != 4 else np.zeros(n)
        name = None if i == 8 else f"S{i:02d}"
        frames.append(pd.DataFrame({"symbol": name, "fold": 0, "date": np.arange(n), "role": "train", "x": x}))
        want[name] = alone(x) if n >= 100 and i != 4 else None
    rows = spark.createDataFrame(pd.concat(frames, ignore_index=True)).repartition(3)
    assert "FlatMapGroups" not in S.garch_fit(rows, "x")._jdf.queryExecution().executedPlan().toString()
    got = {r["symbol"]: r for r in S.garch_fit(rows, "x").collect()}
    assert got.keys() == want.keys()
    for name, w in want.items():
        if w is None:
            assert got[name]["omega"] is None and got[name]["degenerate"]
        else:
            assert np.allclose([got[name]["omega"], got[name]["alpha"], got[name]["beta"]], w, rtol=1e-12)


def test_last_values_of_all_prefixes():
    """From windows of fixed length and a shared median, without a pass over each prefix."""
    rng = np.random.default_rng(3)
    for n, lo, level in ((533, 252, 3), (533, 253, 3), (400, 319, 3), (300, 130, 3), (90, 40, 3), (260, 70, 2), (260, 71, 2), (300, 140, 4)):
        for x in (np.cumsum(rng.normal(size=n)), np.round(rng.normal(size=n)), np.zeros(n)):
            assert np.allclose(S.last_denoised(x, lo, level), [S.denoise_array(x[:i + 1], level)[-1] for i in range(lo, n)], atol=1e-9)
    x = rng.normal(size=300)
    x[200] = np.nan
    got = S.last_denoised(x, 150)
    assert np.isfinite(got[:50]).all() and np.isnan(got[50:]).all()


def test_causal_wavelet_streams_keys(spark, monkeypatch):
    """Keys over several batches, a null key, a null value and short keys; whole prefixes are not sent or denoised again."""
    rng = np.random.default_rng(13)
    data = {k: np.cumsum(rng.normal(size=n)) for k, n in (("a", 400), ("b", 30), ("c", 533), ("d", 200))}
    rows = frame(spark, data).selectExpr("nullif(symbol, 'd') AS symbol", "date", "if(symbol = 'c' AND date = 500, NULL, x) AS x").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        for most in ("1000000", "300"):  # the second sends prefixes in groups
            spark.conf.set("barloom.rows.per.task", most)
            plan = S.causal_wavelet_denoise(rows, "x", min_window=150)
            got = plan.toPandas().sort_values("date")
            assert ("FlatMapGroups" in plan._jdf.queryExecution().executedPlan().toString()) == (most == "300")
            for k, v in data.items():
                one = got[got.symbol == k if k != "d" else got.symbol.isna()]["denoised"].to_numpy(float)
                v = v.copy()
                v[500:501] = np.nan if k == "c" else v[500:501]
                want = [S.denoise_array(v[:i + 1])[-1] for i in range(150, len(v))]
                assert np.allclose(one[150:], want, atol=1e-9, equal_nan=True), (k, most)
                assert np.allclose(one[:3], pd.Series(v).ewm(span=150, adjust=False).mean()[:3])
    finally:
        spark.conf.unset("barloom.rows.per.task")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_whole_series_stream_as_arrays(spark):
    """Keys over several batches, null keys and values, and keys too long for a task give what the joined plans give."""
    rng = np.random.default_rng(17)
    data = {f"s{i}": np.cumsum(rng.normal(size=n)) if i % 2 else rng.normal(size=n) for i, n in enumerate((150, 9, 5, 61, 40, 260))}
    rows = frame(spark, data).selectExpr("nullif(symbol, 's4') AS symbol", "date", "if(symbol = 's0' AND date = 70, NULL, x) AS x").repartition(3)
    key = lambda df: df.toPandas().sort_values(["symbol", *(["date"] if "date" in df.columns else [])]).reset_index(drop=True)
    found = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for most in ("1000000", "100", "7"):  # all, some and no keys stream
            spark.conf.set("barloom.rows.per.task", most)
            smooth, order = S.wavelet_denoise(rows, "x"), S.find_min_d(rows, "x", step=0.25, threshold=1e-2)
            if most == "1000000":
                assert "FlatMap" not in order._jdf.queryExecution().executedPlan().toString() and "Join" not in order._jdf.queryExecution().executedPlan().toString()
            found.append((key(smooth), key(order)))
    finally:
        spark.conf.unset("barloom.rows.per.task")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for smooth, order in found[1:]:
        pd.testing.assert_frame_equal(found[0][0], smooth[found[0][0].columns], atol=1e-9)
        pd.testing.assert_frame_equal(found[0][1], order)
