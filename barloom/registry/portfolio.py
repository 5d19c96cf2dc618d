"""Queries of positions, weights and backtests."""

from pyspark.sql import functions as F

from barloom.operators import portfolio as P
from barloom.operators import rolling as G
from barloom.registry import case
from barloom.registry import tables as X

KEY = ("symbol", "date")


@case("pf01_rank_positions", """SELECT symbol, date, CASE WHEN k > n - least(3, n // 2) THEN -1 WHEN k <= least(3, n // 2) THEN 1 ELSE 0 END AS position FROM (
      SELECT *, rank() OVER (PARTITION BY date ORDER BY pred_a DESC) + (count(*) OVER (PARTITION BY date, pred_a) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY date) AS n FROM scores)""", "scores")
def _(s, sf):
    return P.rank_positions(X.scores(s, sf), "pred_a", 3, 3).select(*KEY, "position")


@case("pf02_long_short_pooled", """SELECT fold, count(*) AS n_trades, avg(r) / greatest(stddev_pop(r), 1e-10) * sqrt(252) AS sharpe FROM (
      SELECT fold, -y AS r FROM o WHERE k <= c UNION ALL SELECT fold, y FROM o WHERE k > n - c) GROUP BY 1""", "scores", "sharpe",
      [("o", "SELECT *, greatest(floor(n * 0.2), 1) AS c FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY pred_a, symbol, date) AS k, count(*) OVER (PARTITION BY fold) AS n FROM scores)")])
def _(s, sf):
    return P.long_short_pooled(X.scores(s, sf), "pred_a", "y")


LSD = [("o", "SELECT *, greatest(floor(n * 0.2), 1) AS c FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred_a, symbol) AS k, count(*) OVER (PARTITION BY date) AS n FROM scores)"),
       ("ls", "SELECT date, CASE WHEN max(n) >= 2 * max(c) THEN avg(y) FILTER (k > n - c) - avg(y) FILTER (k <= c) ELSE 0 END AS ret FROM o GROUP BY 1")]


@case("pf03_long_short_daily", "SELECT * FROM ls", "scores", "ret", LSD)
def _(s, sf):
    return P.long_short_daily(X.scores(s, sf), "pred_a", "y")


@case("pf03_long_short_summary", """SELECT count(*) AS n_days, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, avg(ret) / (stddev_samp(ret) FILTER (ret < 0)) * sqrt(252) AS sortino,
      min(eq / pk - 1) AS max_dd, avg(ret) AS mean_ret, stddev_samp(ret) AS vol FROM (SELECT *, max(eq) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk FROM (
        SELECT date, r AS ret, product(1 + r) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM (SELECT date, -ret / 1000 AS r FROM ls)))""", "scores", "sharpe sortino max_dd mean_ret vol", LSD)
def _(s, sf):
    d = P.long_short_daily(X.scores(s, sf), "pred_a", "y")
    return P.long_short_summary(d.withColumn("ret", -F.col("ret") / 1000))


@case("pf04_top_picks", "SELECT symbol, date, pred_a FROM scores WHERE date = (SELECT max(date) FROM scores) ORDER BY pred_a DESC, symbol LIMIT 10", "scores", "pred_a")
def _(s, sf):
    return P.top_picks(X.scores(s, sf), "pred_a", 10).select(*KEY, "pred_a")


@case("pf05_weights_equal_or_signal", """SELECT symbol, date, 1.0 / count(*) OVER d AS equal, (pred_a - min(pred_a) OVER d + 0.01) / (sum(pred_a) OVER d - count(*) OVER d * min(pred_a) OVER d + 0.01 * count(*) OVER d) AS signal
      FROM scores WINDOW d AS (PARTITION BY date)""", "scores", "equal signal")
def _(s, sf):
    d = P.weights_equal_or_signal(X.scores(s, sf), "pred_a", out="equal")
    return P.weights_equal_or_signal(d, "pred_a", "signal", out="signal").select(*KEY, "equal", "signal")


SM = [("sm", "SELECT *, exp(pred_a - max(pred_a) OVER d) / sum(exp(pred_a - m)) OVER d - 1.0 / count(*) OVER d AS weight FROM (SELECT *, max(pred_a) OVER (PARTITION BY date) AS m FROM scores) WINDOW d AS (PARTITION BY date)")]


@case("pf06_softmax_weights", "SELECT symbol, date, weight FROM sm", "scores", "weight", SM)
def _(s, sf):
    return P.softmax_weights(X.scores(s, sf), "pred_a").select(*KEY, "weight")


@case("pf07_softmax_portfolio_sharpe", "SELECT count(*) AS n_days, avg(p) / (stddev_samp(p) + 1e-8) AS sharpe FROM (SELECT date, sum(weight * y) AS p FROM sm GROUP BY 1)", "scores", "sharpe", SM)
def _(s, sf):
    return P.softmax_portfolio_sharpe(X.scores(s, sf), "pred_a", "y")


@case("pf08_inverse_vol_weights", """SELECT symbol, date, CASE WHEN coalesce(t, 0) > 1e-10 THEN coalesce(i, 0) / t ELSE 1.0 / n END AS weight FROM (
      SELECT *, sum(i) OVER (PARTITION BY date) AS t, count(*) OVER (PARTITION BY date) AS n FROM (SELECT *, CASE WHEN abs(pred_b) >= 1e-8 THEN 1 / abs(pred_b) END AS i FROM scores))""", "scores", "weight")
def _(s, sf):
    return P.inverse_vol_weights(X.scores(s, sf), "pred_b").select(*KEY, "weight")


REG = [("reg", """SELECT date, r, rn - 1 AS day, CASE WHEN rn <= 126 THEN 'normal' WHEN s63 / greatest(s126, 1e-6) > 1.3 THEN 'high_vol' WHEN m63 - m126 > 0 THEN 'low_vol_trending' ELSE 'low_vol_mean_reverting' END AS regime
   FROM (SELECT date, r, row_number() OVER (ORDER BY date) AS rn, stddev_pop(r) OVER a AS s63, avg(r) OVER a AS m63, stddev_pop(r) OVER b AS s126, avg(r) OVER b AS m126 FROM daily
     WINDOW a AS (ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING), b AS (ORDER BY date ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING))""")]


@case("pf09_regime_classify", "SELECT date, regime FROM reg", "daily", "", REG)
def _(s, sf):
    return P.regime_classify(X.daily(s, sf), "r").select("date", "regime")


# The signal of the backtest is the negated five-row change.
SIG = [("sig", "SELECT b.symbol, b.date, i.date_idx AS d, b.close, b.r, -(close / lag(close, 5) OVER w - 1) AS pred, greatest(stddev_pop(r) OVER (w ROWS 62 PRECEDING), 1e-6) AS hv FROM ret b JOIN days i USING (date) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.date)"),
       ("nn", "SELECT count(DISTINCT symbol) AS n FROM bars"),
       ("eve", """SELECT *, count(pred) OVER (PARTITION BY d) AS valid, row_number() OVER (PARTITION BY d ORDER BY pred DESC NULLS LAST, symbol) AS k FROM sig WHERE (d + 1) % 5 = 0 AND d + 1 >= 130"""),
       ("held", """SELECT e.d + 1 AS reb, e.symbol, CASE g.regime WHEN 'high_vol' THEN (1 / hv) / sum(1 / hv) OVER (PARTITION BY e.d) WHEN 'low_vol_mean_reverting' THEN 0.5 * base ELSE base END AS w
          FROM (SELECT *, CASE WHEN valid >= 10 THEN 0.1 ELSE 1.0 / (SELECT n FROM nn) END AS base FROM eve WHERE valid < 10 OR k <= 10) e JOIN reg g ON g.day = e.d + 1"""),
       ("bt", """SELECT g.date, g.day, g.regime, g.day >= 130 AND g.day % 5 = 0 AS rebalanced, CASE WHEN g.day < 130 THEN t.s / (SELECT n FROM nn) ELSE coalesce(x.s, 0) END AS strategy_return, t.s / (SELECT n FROM nn) AS benchmark_return
          FROM reg g JOIN (SELECT d, sum(r) AS s FROM sig GROUP BY 1) t ON t.d = g.day
          LEFT JOIN (SELECT s.d, sum(h.w * s.r) AS s FROM sig s JOIN held h ON h.symbol = s.symbol AND h.reb = s.d // 5 * 5 GROUP BY 1) x ON x.d = g.day WHERE g.day > 0""")]


def backtest(s, sf):
    d = G.momentum(X.px(s, sf), periods=[5]).withColumn("pred", -F.col("mom_5"))
    return P.regime_backtest(d, "pred", top_k=10)


@case("pf10_regime_backtest", "SELECT * FROM bt", "ret days daily", "strategy_return benchmark_return", [*REG, *SIG])
def _(s, sf):
    return backtest(s, sf)


@case("pf11_regime_performance", """SELECT c.regime, c.n AS n_rebalances, p.sharpe, p.n_periods, p.mean_return FROM (SELECT regime, count(*) AS n FROM bt WHERE rebalanced GROUP BY 1) c LEFT JOIN (
      SELECT b.regime, avg(a.strategy_return) / greatest(stddev_pop(a.strategy_return), 1e-10) * sqrt(252) AS sharpe, count(*) AS n_periods, avg(a.strategy_return) * 252 AS mean_return
      FROM bt a JOIN bt b ON b.rebalanced AND b.day = a.day // 5 * 5 AND a.day <> b.day GROUP BY 1) p USING (regime)""", "ret days daily", "sharpe mean_return", [*REG, *SIG])
def _(s, sf):
    return P.regime_performance(backtest(s, sf))


LIQ = [("lq", """SELECT p.symbol, p.date, i.date_idx AS d, close, CASE WHEN rn >= 20 THEN avg(volume) OVER (w ROWS 19 PRECEDING) END AS liq, CASE WHEN rn > 60 THEN stddev_samp(r) OVER (w ROWS 20 PRECEDING) END AS vol,
          CASE WHEN lead(i.date_idx) OVER w = i.date_idx + 1 THEN lead(close) OVER w / close - 1 END AS f FROM ret p JOIN days i USING (date) WINDOW w AS (PARTITION BY p.symbol ORDER BY p.date)"""),
       ("topl", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY liq DESC, symbol) AS k FROM lq WHERE d % 5 = 0 AND d < (SELECT max(d) FROM lq) AND liq > 0) WHERE k <= 8"),
       ("wts", """SELECT d AS reb, symbol, CASE WHEN coalesce(t, 0) > 1e-10 THEN coalesce(i, 0) / t ELSE 1.0 / n END AS weight, 1.0 / n AS bench_weight FROM (
          SELECT *, sum(i) OVER (PARTITION BY d) AS t, count(*) OVER (PARTITION BY d) AS n FROM (SELECT *, CASE WHEN abs(vol) >= 1e-8 THEN 1 / abs(vol) END AS i FROM topl))"""),
       ("sq", "SELECT w.*, dense_rank() OVER (ORDER BY reb) AS i FROM wts w"),
       ("tov", """SELECT x.reb, CASE WHEN x.i = 1 THEN 0 ELSE t END AS turnover FROM (SELECT DISTINCT reb, i FROM sq) x JOIN (
          SELECT coalesce(a.i, b.i + 1) AS i, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) / 2 AS t FROM sq a FULL JOIN sq b ON a.symbol = b.symbol AND a.i = b.i + 1 GROUP BY 1) y USING (i)"""),
       ("lv", """SELECT n.date, c.d AS day, coalesce(s, 0) - 0.001 * coalesce(turnover, 0) AS strategy_return, coalesce(b, 0) AS benchmark_return
          FROM (SELECT DISTINCT d FROM lq) c JOIN (SELECT DISTINCT d - 1 AS d, date FROM lq) n ON n.d = c.d LEFT JOIN (
            SELECT l.d, sum(w.weight * l.f) FILTER (w.weight > 0) / nullif(sum(w.weight) FILTER (w.weight > 0), 0) AS s, avg(l.f) AS b FROM lq l JOIN wts w ON w.symbol = l.symbol AND w.reb = l.d // 5 * 5 WHERE l.f IS NOT NULL GROUP BY 1) x ON x.d = c.d
          LEFT JOIN tov ON tov.reb = c.d"""),
       ("vt", """SELECT *, CASE WHEN row_number() OVER (ORDER BY date) >= 21 THEN benchmark_return * least(greatest(0.15 / greatest(stddev_pop(benchmark_return) OVER (ORDER BY date ROWS 62 PRECEDING) * sqrt(252), 1e-10), 0.25), 2)
          ELSE benchmark_return END AS vol_target_return FROM lv""")]


def _liq(s, sf):
    from barloom.operators.returns import simple_return

    d = G.rolling_liquidity(simple_return(X.px(s, sf)), out="liq")
    from barloom.functions.grouping import along_time

    return along_time(d, {"vol": lambda t: F.when(t.pos >= 60, F.stddev_samp("simple_return").over(t.last(21)))}, back=20)


@case("pf12_liquidity_vol_backtest", "SELECT * FROM vt", "ret days", "strategy_return benchmark_return vol_target_return", LIQ)
def _(s, sf):
    return P.liquidity_vol_backtest(_liq(s, sf), "vol", "liq", top_k=8, cost=0.001)


@case("pf13_turnover", "SELECT * FROM tov", "ret days", "turnover", LIQ)
def _(s, sf):
    return P.turnover(P.liquidity_vol_weights(_liq(s, sf), "vol", "liq", 8))


@case("pf14_vol_target_overlay", """SELECT date, CASE WHEN row_number() OVER (ORDER BY date) >= 21 THEN r * least(greatest(0.15 / greatest(stddev_pop(r) OVER (ORDER BY date ROWS 62 PRECEDING) * sqrt(252), 1e-10), 0.25), 2) ELSE r END AS vol_target_return
      FROM (SELECT date, r / 50 AS r FROM daily)""", "daily", "vol_target_return")
def _(s, sf):
    d = X.daily(s, sf).withColumn("r", F.col("r") / 50)
    return P.vol_target_overlay(d, "r").select("date", "vol_target_return")


@case("pf16_signal_table", """SELECT symbol, date, pred_a, pred_b, e AS ensemble, 1.0 AS confidence, n AS n_history, (e - avg(e) OVER ()) / greatest(stddev_samp(e) OVER (), 1e-8) AS cs_zscore FROM (
      SELECT *, (pred_a + pred_b) / 2 AS e FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM scores) WHERE k = 1 AND n >= 130)""",
      "scores", "pred_a pred_b ensemble confidence cs_zscore")
def _(s, sf):
    return P.signal_table(X.scores(s, sf), ["pred_a", "pred_b"], ["pred_a", "pred_b"])


@case("pf17_ensemble_signal_output", "SELECT symbol, date, pred_a AS fused_signal, abs(pred_a) AS confidence, CAST(row_number() OVER (PARTITION BY date ORDER BY pred_a DESC, symbol) AS INT) AS rank FROM scores",
      "scores", "fused_signal confidence")
def _(s, sf):
    d = X.scores(s, sf).select(*KEY, F.col("pred_a").alias("fused_signal"))
    return P.ensemble_signal_output(d)
