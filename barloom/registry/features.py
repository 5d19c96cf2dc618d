"""Queries of time-window and cross-sectional features."""

from pyspark.sql import functions as F

from barloom.operators import cross as C
from barloom.operators import returns as R
from barloom.operators import rolling as G
from barloom.registry import case
from barloom.registry import tables as X

W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"
KEY = ("symbol", "date")


def _r(s, sf):
    return R.simple_return(X.px(s, sf))


@case("win01_sma", f"SELECT symbol, date, avg(close) OVER (w ROWS 19 PRECEDING) AS sma FROM bars {W}", "bars", "sma")
def _(s, sf):
    return G.sma(X.px(s, sf)).select(*KEY, "sma")


@case("win02_sma_deviation", f"""SELECT symbol, date, close / (avg(close) OVER (w ROWS 4 PRECEDING) + 1e-8) - 1 AS sma_5,
      close / (avg(close) OVER (w ROWS 19 PRECEDING) + 1e-8) - 1 AS sma_20,
      (close - avg(close) OVER (w ROWS 19 PRECEDING)) / (avg(close) OVER (w ROWS 19 PRECEDING) + 1e-8) AS bias FROM bars {W}""",
      "bars", "sma_5 sma_20 bias")
def _(s, sf):
    return G.sma_deviation(X.px(s, sf)).drop("close", "volume")


# Wilder's recursion written out step by step.
_RSI = [
    ("chg", "SELECT symbol, date, rn - 1 AS p, greatest(close - prev, 0) AS g, greatest(prev - close, 0) AS l FROM px"),
    ("seed", "SELECT symbol, avg(g) AS ag, avg(l) AS al FROM chg WHERE p BETWEEN 1 AND 14 GROUP BY 1 HAVING count(*) = 14"),
    ("walk(symbol, p, ag, al)", """SELECT symbol, CAST(14 AS BIGINT), ag, al FROM seed
        UNION ALL SELECT c.symbol, c.p, k.ag + (c.g - k.ag) / 14, k.al + (c.l - k.al) / 14
        FROM walk k JOIN chg c ON c.symbol = k.symbol AND c.p = k.p + 1"""),
    ("rsi", """SELECT c.symbol, c.date, CASE WHEN k.p IS NULL THEN 0.0 ELSE 100 - 100 / (k.ag / (k.al + 1e-8) + 1) END AS rsi
        FROM chg c LEFT JOIN walk k ON c.symbol = k.symbol AND c.p = k.p"""),
]


@case("win03_rsi_wilder", "SELECT symbol, date, rsi FROM rsi", "px", "rsi", _RSI)
def _(s, sf):
    return G.rsi_wilder(X.px(s, sf)).select(*KEY, "rsi")


_BB = "avg(close) OVER (w ROWS 19 PRECEDING)"
_SD = "stddev_pop(close) OVER (w ROWS 19 PRECEDING)"


@case("win04_bollinger_bands", f"""SELECT symbol, date, {_BB} AS bb_mid, {_BB} + 2 * {_SD} AS bb_upper, {_BB} - 2 * {_SD} AS bb_lower
      FROM bars {W}""", "bars", "bb_mid bb_upper bb_lower")
def _(s, sf):
    return G.bollinger_bands(X.px(s, sf)).drop("close", "volume")


@case("win05_bollinger_position", f"""SELECT symbol, date, CASE WHEN 2 * {_SD} > 1e-12 THEN (close - {_BB}) / ({_SD} + 1e-8) END
      AS bollinger_position FROM bars {W}""", "bars", "bollinger_position")
def _(s, sf):
    return G.bollinger_position(X.px(s, sf)).drop("close", "volume")


@case("win06_volume_ratio", f"SELECT symbol, date, volume / (avg(volume) OVER (w ROWS 19 PRECEDING) + 1e-8) AS volume_ratio FROM bars {W}",
      "bars", "volume_ratio")
def _(s, sf):
    return G.volume_ratio(X.px(s, sf)).drop("close", "volume")


@case("win07_realized_vol", f"SELECT symbol, date, coalesce(stddev_samp(r) OVER (w ROWS 20 PRECEDING), 0) AS realized_vol FROM ret {W}",
      "ret", "realized_vol")
def _(s, sf):
    return G.realized_vol(_r(s, sf)).select(*KEY, "realized_vol")


BASE_CTES = [*_RSI, ("base", f"""SELECT symbol, date, close, volume, r AS simple_return, coalesce(ln(close / prev), 0) AS log_return,
      close / (avg(close) OVER (w ROWS 4 PRECEDING) + 1e-8) - 1 AS sma_5, close / ({_BB} + 1e-8) - 1 AS sma_20, rsi AS rsi_14,
      CASE WHEN 2 * {_SD} > 1e-12 THEN (close - {_BB}) / ({_SD} + 1e-8) END AS bollinger_position,
      volume / (avg(volume) OVER (w ROWS 19 PRECEDING) + 1e-8) AS volume_ratio,
      coalesce(stddev_samp(r) OVER (w ROWS 20 PRECEDING), 0) AS realized_vol_21, (close - {_BB}) / ({_BB} + 1e-8) AS bias
      FROM ret JOIN rsi USING (symbol, date) {W}""")]
BASE = " ".join(G.BASE_FEATURES)


@case("win08_base_features", "SELECT * EXCLUDE (close, volume) FROM base", "ret", BASE, BASE_CTES)
def _(s, sf):
    return G.base_features(X.px(s, sf)).drop("close", "volume")


@case("prj08_feature_interactions", """SELECT symbol, date, rsi_14 * volume_ratio AS rsi_x_volratio, sma_5 * rsi_14 AS sma5_x_rsi,
      bollinger_position * rsi_14 AS bollinger_x_rsi FROM base""", "ret", "rsi_x_volratio sma5_x_rsi bollinger_x_rsi", BASE_CTES)
def _(s, sf):
    return R.feature_interactions(G.base_features(X.px(s, sf))).select(*KEY, "rsi_x_volratio", "sma5_x_rsi", "bollinger_x_rsi")


@case("win09_ewm_vol", """SELECT p.symbol, p.date, CASE WHEN k >= 2 THEN greatest(sqrt(greatest(
      (s2 / s0 - (s1 / s0) * (s1 / s0)) * s0 * s0 / (s0 * s0 - q0), 0)), 1e-8) END AS ewm_vol
      FROM px p JOIN (SELECT a.symbol, a.rn, count(b.x) AS k, sum(pow(1 - 2.0 / 101, a.rn - b.rn)) FILTER (b.x IS NOT NULL) AS s0,
        sum(pow(1 - 2.0 / 101, 2 * (a.rn - b.rn))) FILTER (b.x IS NOT NULL) AS q0, sum(b.x * pow(1 - 2.0 / 101, a.rn - b.rn)) AS s1,
        sum(b.x * b.x * pow(1 - 2.0 / 101, a.rn - b.rn)) AS s2
        FROM px a JOIN (SELECT symbol, rn, close / prev - 1 AS x FROM px) b ON a.symbol = b.symbol AND b.rn <= a.rn GROUP BY 1, 2) t
      ON p.symbol = t.symbol AND p.rn = t.rn""", "px", "ewm_vol")
def _(s, sf):
    return G.ewm_vol(X.px(s, sf)).select(*KEY, "ewm_vol")


@case("win10_rolling_zscore", f"""SELECT symbol, date, CASE WHEN rn = 1 THEN 0 ELSE (close - avg(close) OVER (w ROWS 251 PRECEDING))
      / (stddev_pop(close) OVER (w ROWS 251 PRECEDING) + 1e-12) END AS z_close FROM px {W}""", "px", "z_close")
def _(s, sf):
    return G.rolling_zscore(X.px(s, sf), ["close"]).select(*KEY, "z_close")


@case("win11_expanding_zscore", """SELECT symbol, date, (m - a) / (sqrt(greatest(q - a * a, 1e-12)) + 1e-8) AS z_m FROM (
      SELECT symbol, date, m, sum(coalesce(m, 0)) OVER w / rn AS a, sum(coalesce(m * m, 0)) OVER w / rn AS q
      FROM (SELECT symbol, date, rn, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date) - 1 AS m FROM px)
      WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))""", "px", "z_m")
def _(s, sf):
    d = G.momentum(X.px(s, sf), periods=[5]).withColumnRenamed("mom_5", "m")
    return G.expanding_zscore(d, ["m"]).select(*KEY, "z_m")


@case("win12_momentum", f"""SELECT symbol, date, close / lag(close, 5) OVER w - 1 AS mom_5, close / lag(close, 21) OVER w - 1 AS mom_21,
      close / lag(close, 63) OVER w - 1 AS mom_63, close / lag(close, 126) OVER w - 1 AS mom_126 FROM bars {W}""",
      "bars", "mom_5 mom_21 mom_63 mom_126")
def _(s, sf):
    return G.momentum(X.px(s, sf)).drop("close", "volume")


_ILLIQ = ("illiq", """SELECT symbol, date, CASE WHEN rn > 21 THEN quantile_cont(i, 0.5) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) END AS illiq
      FROM (SELECT *, abs(r) / greatest(close * greatest(volume, 1), 1e-12) * 1e6 AS i FROM ret)""")


@case("win13_amihud_illiquidity", "SELECT symbol, date, illiq FROM illiq", "ret", "illiq", [_ILLIQ])
def _(s, sf):
    return G.amihud_illiquidity(X.px(s, sf)).select(*KEY, (F.col("illiq") * 1e6).alias("illiq"))


_IDIO = ("idio", """SELECT symbol, date, CASE WHEN rn > 63 AND count(*) OVER f > 20 THEN
      sqrt(greatest(var_pop(r) OVER f - pow(covar_pop(r, m) OVER f, 2) / nullif(var_pop(m) OVER f, 0), 0)) END AS idio_vol
      FROM (SELECT *, avg(r) OVER (PARTITION BY date) AS m FROM ret)
      WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING)""")


@case("win14_idiosyncratic_vol", "SELECT symbol, date, idio_vol FROM idio", "ret", "idio_vol", [_IDIO])
def _(s, sf):
    return G.idiosyncratic_vol(_r(s, sf)).select(*KEY, "idio_vol")


@case("win15_short_term_reversal", "SELECT symbol, date, -r AS reversal FROM ret", "ret", "reversal")
def _(s, sf):
    return G.short_term_reversal(X.px(s, sf)).select(*KEY, "reversal")


@case("win16_rolling_liquidity", f"""SELECT symbol, date, CASE WHEN rn >= 20 THEN avg(volume) OVER (w ROWS 19 PRECEDING) END AS liquidity
      FROM px {W}""", "px", "liquidity")
def _(s, sf):
    return G.rolling_liquidity(X.px(s, sf)).select(*KEY, "liquidity")


@case("win18_frac_diff", """SELECT a.symbol, a.date, CASE WHEN count(*) = (SELECT count(*) FROM omega) THEN sum(w.w * ln(b.close)) END AS frac_diff
      FROM px a JOIN px b ON a.symbol = b.symbol AND b.rn <= a.rn AND a.rn - b.rn < (SELECT count(*) FROM omega)
      JOIN omega w ON w.k = a.rn - b.rn GROUP BY 1, 2""", "px", "frac_diff",
      [("omega(k, w)", """SELECT 0, CAST(1 AS DOUBLE) UNION ALL SELECT k + 1, w * (k - 0.4) / (k + 1) FROM omega
         WHERE abs(w * (k - 0.4) / (k + 1)) >= 0.002""")])
def _(s, sf):
    return G.frac_diff(X.px(s, sf).withColumn("lp", F.ln("close")), "lp", 0.4, 0.002).select(*KEY, "frac_diff")


@case("win23_trend_seasonal_split", f"""SELECT symbol, date, sum(close) OVER (w ROWS 24 PRECEDING) / 25 AS trend,
      close - sum(close) OVER (w ROWS 24 PRECEDING) / 25 AS seasonal FROM bars {W}""", "bars", "trend seasonal")
def _(s, sf):
    return G.trend_seasonal_split(X.px(s, sf), "close").select(*KEY, "trend", "seasonal")


@case("win24_causal_fir", f"""SELECT symbol, date, 0.5 * close + 0.3 * coalesce(lag(close) OVER w, 0) + 0.2 * coalesce(lag(close, 2) OVER w, 0) + 0.1 AS fir
      FROM bars {W}""", "bars", "fir")
def _(s, sf):
    return G.causal_fir(X.px(s, sf), "close", [0.5, 0.3, 0.2], 0.1).select(*KEY, "fir")


@case("win25_sequence_windows", """SELECT symbol, date, step, volume, r, target FROM (
      SELECT b.symbol, b.date, b.rn - a.rn AS back, 9 - (b.rn - a.rn) AS step, a.volume, a.r, lead1 AS target
      FROM (SELECT *, lead(r) OVER (PARTITION BY symbol ORDER BY date) AS lead1 FROM ret) b
      JOIN ret a ON a.symbol = b.symbol AND b.rn - a.rn BETWEEN 0 AND 9 WHERE b.rn >= 10 AND lead1 IS NOT NULL)""",
      "ret", "volume r target")
def _(s, sf):
    d = _r(s, sf).withColumnRenamed("simple_return", "r")
    seq = G.sequence_windows(d, ["volume", "r"], 10, target="r")
    return seq.select(*KEY, F.posexplode("sequence").alias("step", "x"), "target").select(
        *KEY, "step", "x.volume", "x.r", "target")


@case("win26_sequence_aggregates", """SELECT symbol, date, r AS r_last, avg(r) OVER f AS r_mean, stddev_samp(r) OVER f AS r_std,
      min(r) OVER f AS r_min, max(r) OVER f AS r_max, regr_slope(r, rn) OVER f AS r_slope FROM ret
      WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) QUALIFY rn >= 20""", "ret", "r_last r_mean r_std r_min r_max r_slope")
def _(s, sf):
    d = _r(s, sf).withColumnRenamed("simple_return", "r")
    return G.sequence_aggregates(d, ["r"], 20)


@case("win27_hidden_state_pool", """SELECT vec_id, i AS dim, CAST(embedding[56 + i] AS DOUBLE) AS last,
      list_avg([CAST(embedding[8 * k + i] AS DOUBLE) FOR k IN range(8)]) AS mean
      FROM embeddings, (SELECT unnest(range(1, 9)) AS i)""", "", "last mean")
def _(s, sf):
    v = s.read.parquet(f"{sf}/embeddings.parquet")
    steps = v.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8))).alias("h"))
    both = G.hidden_state_pool(G.hidden_state_pool(steps, "h", "last", "a"), "h", "mean", "b")
    return both.select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("d", "v")).select(
        "vec_id", (F.col("d") + 1).cast("bigint").alias("dim"), F.col("v.a").alias("last"), F.col("v.b").alias("mean"))


@case("win28_persistence_forecast", f"SELECT symbol, date, CASE WHEN rn > 1 THEN greatest(lag(r * r) OVER w, 1e-8) END AS forecast FROM ret {W}", "ret", "forecast")
def _(s, sf):
    d = _r(s, sf).withColumn("sq", F.pow("simple_return", F.lit(2.0)))
    return G.persistence_forecast(d, "sq").select(*KEY, "forecast")


def year_folds(d):
    """Fold = year, the first eight months train, the rest test."""
    return d.withColumns({"fold": F.year("date") - 1995, "role": F.when(F.month("date") <= 8, "train").otherwise("test")})


@case("win29_historical_mean_forecast", """SELECT r.symbol, r.date, m.m AS forecast FROM ret r JOIN (
      SELECT symbol, year(date) AS yr, avg(r * r) AS m FROM ret WHERE month(date) <= 8 GROUP BY 1, 2) m
      ON r.symbol = m.symbol AND year(r.date) = m.yr WHERE month(r.date) > 8""", "ret", "forecast")
def _(s, sf):
    d = year_folds(_r(s, sf)).withColumn("sq", F.pow("simple_return", F.lit(2.0)))
    return G.historical_mean_forecast(d, "sq").select(*KEY, "forecast")


@case("win30_garch_filter", """SELECT w.symbol, t.date, least(greatest(w.h, 1e-8), v.tv * 10) AS variance FROM walk w
      JOIN ret t ON t.symbol = w.symbol AND t.rn = w.rn JOIN v ON v.symbol = w.symbol""", "ret", "variance",
      [("v", "SELECT symbol, var_pop(r) AS tv FROM ret GROUP BY 1"),
       ("walk(symbol, rn, h)", """SELECT symbol, CAST(1 AS BIGINT), CAST(0.02 / (1 - 0.1 - 0.8) AS DOUBLE) FROM v UNION ALL
        SELECT w.symbol, w.rn + 1, 0.02 + 0.1 * t.r * t.r + 0.8 * w.h FROM walk w JOIN ret t ON t.symbol = w.symbol AND t.rn = w.rn
        JOIN ret n ON n.symbol = w.symbol AND n.rn = w.rn + 1""")])
def _(s, sf):
    from barloom.functions.grouping import group_stats

    d = group_stats(_r(s, sf), ["symbol"], train_var=F.var_pop("simple_return")).withColumns(
        {"omega": F.lit(0.02), "alpha": F.lit(0.1), "beta": F.lit(0.8)})
    return G.garch_filter(d, "simple_return", by=("symbol",)).select(*KEY, "variance")


# ---- cross sections ---------------------------------------------------------------

@case("xs01_cs_zscore", """SELECT symbol, date, coalesce((pred_a - avg(pred_a) OVER d) / greatest(stddev_pop(pred_a) OVER d, 1e-8), 0) AS cs_z_pred_a
      FROM scores WINDOW d AS (PARTITION BY date)""", "scores", "cs_z_pred_a")
def _(s, sf):
    return C.cs_zscore(X.scores(s, sf), ["pred_a"]).select(*KEY, "cs_z_pred_a")


@case("xs01_params_zscore", """SELECT symbol, date, (pred_a - m) / greatest(sd, 1e-8) AS cs_z_pred_a FROM scores,
      (SELECT avg(pred_a) AS m, stddev_pop(pred_a) AS sd FROM scores)""", "scores", "cs_z_pred_a")
def _(s, sf):
    d = X.scores(s, sf)
    return C.params_zscore(d, C.fit_pooled_params(d, ["pred_a", "pred_b"]), ["pred_a"]).select(*KEY, "cs_z_pred_a")


def pct_rank_sql(col: str, table: str, keep: str = "TRUE") -> str:
    return f"""SELECT symbol, date, coalesce(CASE WHEN n > 1 AND {col} IS NOT NULL THEN (lower_ + (same + 1) / 2.0) / n END, 0) AS {col}_rank FROM (
      SELECT a.*, (SELECT count(*) FROM {table} b WHERE b.date = a.date AND b.{col} < a.{col}) AS lower_,
        (SELECT count(*) FROM {table} b WHERE b.date = a.date AND b.{col} = a.{col}) AS same,
        (SELECT count({col}) FROM {table} b WHERE b.date = a.date) AS n FROM {table} a)"""


def _rank_sql(col: str) -> str:
    return f"""coalesce(CASE WHEN count({col}) OVER d > 1 AND {col} IS NOT NULL THEN
       (rank() OVER (PARTITION BY date ORDER BY {col} NULLS LAST) + (count(*) OVER (PARTITION BY date, {col}) - 1) / 2.0)
       / count({col}) OVER d END, 0)"""


@case("xs02_cs_pct_rank", pct_rank_sql("pred_a", "scores"), "scores", "pred_a_rank")
def _(s, sf):
    return C.cs_pct_rank(X.scores(s, sf), ["pred_a"]).select(*KEY, F.col("cs_rank_pred_a").alias("pred_a_rank"))


_MOM = ("mom", f"""SELECT symbol, date, {', '.join(f'close / lag(close, {k}) OVER w - 1 AS m{k}' for k in (5, 21, 63, 126))}
      FROM bars {W}""")


@case("xs03_momentum_rank", f"SELECT symbol, date, {', '.join(f'{_rank_sql(f'm{k}')} AS mom_rank_{k}' for k in (5, 21, 63, 126))} FROM mom WINDOW d AS (PARTITION BY date)",
      "bars", "mom_rank_5 mom_rank_21 mom_rank_63 mom_rank_126", [_MOM])
def _(s, sf):
    from barloom.plans.features import momentum_rank

    return momentum_rank(X.px(s, sf)).drop("close", "volume")


@case("xs04_illiquidity_rank", f"SELECT symbol, date, {_rank_sql('illiq')} AS illiq_rank FROM illiq WINDOW d AS (PARTITION BY date)",
      "ret", "illiq_rank", [_ILLIQ])
def _(s, sf):
    from barloom.plans.features import illiquidity_rank

    return illiquidity_rank(X.px(s, sf)).select(*KEY, "illiq_rank")


@case("xs05_idio_and_reversal_rank", f"""SELECT symbol, date, {_rank_sql('idio_vol')} AS idio_rank, {_rank_sql('rev')} AS reversal_rank
      FROM idio JOIN (SELECT symbol, date, CASE WHEN rn > 1 THEN -r END AS rev FROM ret) USING (symbol, date) WINDOW d AS (PARTITION BY date)""",
      "ret", "idio_rank reversal_rank", [_IDIO])
def _(s, sf):
    from barloom.plans.features import risk_ranks

    return risk_ranks(X.px(s, sf)).select(*KEY, "idio_rank", "reversal_rank")


def _enhanced_sql() -> str:
    z = ", ".join(f"coalesce(({c} - avg({c}) OVER d) / greatest(stddev_pop({c}) OVER d, 1e-8), 0) AS cs_z_{c}" for c in G.BASE_FEATURES)
    k = ", ".join(f"{_rank_sql(c)} AS cs_rank_{c}" for c in G.BASE_FEATURES)
    m = ", ".join(f"{_rank_sql(f'm{p}')} AS mom_rank_{p}" for p in (5, 21, 63, 126))
    return f"""SELECT symbol, date, {', '.join(G.BASE_FEATURES)}, {z}, {k}, rsi_14 * volume_ratio AS rsi_x_volratio, sma_5 * rsi_14 AS sma5_x_rsi,
      bollinger_position * rsi_14 AS bollinger_x_rsi, {m}, {_rank_sql('illiq')} AS illiq_rank, {_rank_sql('rev')} AS reversal_rank,
      {_rank_sql('idio_vol')} AS idio_rank
      FROM base JOIN mom USING (symbol, date) JOIN illiq USING (symbol, date) JOIN idio USING (symbol, date)
      JOIN (SELECT symbol, date, CASE WHEN rn > 1 THEN -r END AS rev FROM ret) USING (symbol, date) WINDOW d AS (PARTITION BY date)"""


@case("xs06_enhanced_feature_set", _enhanced_sql(), "ret",
      BASE + " " + " ".join(f"cs_z_{c} cs_rank_{c}" for c in G.BASE_FEATURES)
      + " rsi_x_volratio sma5_x_rsi bollinger_x_rsi mom_rank_5 mom_rank_21 mom_rank_63 mom_rank_126 illiq_rank reversal_rank idio_rank",
      [*BASE_CTES, _MOM, _ILLIQ, _IDIO])
def _(s, sf):
    from barloom.plans.features import enhanced_feature_set

    return enhanced_feature_set(X.px(s, sf)).drop("close", "volume")


@case("xs07_fit_pooled_params", """SELECT 'pred_a' AS feature, avg(pred_a) AS mean, greatest(stddev_pop(pred_a), 1e-8) AS std FROM scores
      UNION ALL SELECT 'pred_b', avg(pred_b), greatest(stddev_pop(pred_b), 1e-8) FROM scores""", "scores", "mean std")
def _(s, sf):
    return C.fit_pooled_params(X.scores(s, sf), ["pred_a", "pred_b"])


@case("xs08_market_return", "SELECT date, r AS market_return FROM daily", "daily", "market_return")
def _(s, sf):
    return C.market_return(_r(s, sf))


@case("xs09_signal_zscore", """SELECT symbol, date, (pred_a - avg(pred_a) OVER d) / nullif(stddev_samp(pred_a) OVER d, 0) AS signal_z
      FROM scores WINDOW d AS (PARTITION BY date)""", "scores", "signal_z")
def _(s, sf):
    return C.signal_zscore(X.scores(s, sf), "pred_a").select(*KEY, "signal_z")


@case("xs10_group_quantile_labels", """SELECT symbol, date, CASE WHEN n < 5 THEN -1 ELSE least(greatest(
      CAST(len(list_filter(list_distinct(list_filter(q, lambda e: e < q[6])), lambda e: e <= y)) AS INT) - 1, 0), 4) END AS relevance
      FROM scores JOIN (SELECT date, count(*) AS n, quantile_cont(y, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM scores GROUP BY 1) USING (date)""",
      "scores")
def _(s, sf):
    return C.group_quantile_labels(X.scores(s, sf), "y").select(*KEY, "relevance")


@case("xs11_signal_deciles", """SELECT symbol, date, CAST(len(list_filter(q, lambda e: e < pred_a)) + 1 AS INT) AS decile FROM scores,
      (SELECT quantile_cont(pred_a, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM scores)""", "scores")
def _(s, sf):
    return C.signal_deciles(X.scores(s, sf), "pred_a").select(*KEY, "decile")
