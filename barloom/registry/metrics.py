"""Queries of evaluation metrics and statistical tests."""

from pyspark.sql import functions as F

from barloom.operators import inference as I
from barloom.operators import metrics as M
from barloom.registry import case
from barloom.registry import tables as X

RANKS = lambda by, n="pred_a": (
    f"""SELECT *, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry,
        rank() OVER (PARTITION BY {by} ORDER BY {n}) + (count(*) OVER (PARTITION BY {by}, {n}) - 1) / 2.0 AS rp FROM scores""")
RHO = "coalesce(covar_pop(ry, rp) / nullif(stddev_pop(ry) * stddev_pop(rp), 0), 0)"

FOLD_IC = [("ranked", RANKS("fold")), ("fic", f"SELECT fold, count(*) AS n, {RHO} AS ic FROM ranked GROUP BY 1")]
SYM_IC = [("sranked", RANKS("symbol")), ("sic", f"SELECT symbol, count(*) AS n, {RHO} AS ic FROM sranked GROUP BY 1")]
DAY_IC = [("dranked", RANKS("date")), ("dic", f"SELECT date, count(*) AS n, {RHO} AS ic FROM dranked GROUP BY 1 HAVING count(*) >= 10")]


def fold_ic(s, sf, pred="pred_a"):
    return M.spearman_ic(X.scores(s, sf), "y", pred)


def day_ic(s, sf):
    return M.daily_ic_series(X.scores(s, sf), "y", "pred_a", 10)


@case("eval01_spearman_ic", "SELECT * FROM fic", "scores", "ic", FOLD_IC)
def _(s, sf):
    return fold_ic(s, sf)


@case("eval01_spearman_ic_library", "SELECT symbol, n, CASE WHEN n < 2 THEN 0 ELSE ic END AS ic FROM sic", "scores", "ic", SYM_IC)
def _(s, sf):
    return M.spearman_ic(X.scores(s, sf), "y", "pred_a", "library", by=["symbol"])


@case("eval02_daily_ic_series", "SELECT * FROM dic", "scores", "ic", DAY_IC)
def _(s, sf):
    return day_ic(s, sf)


def rolling_sql(pred: str, lo: int, hi: int) -> list:
    n = hi - lo + 1
    return [("seq", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM scores"),
            (f"pairs_{pred}", f"""SELECT a.symbol, a.rn, rank() OVER (PARTITION BY a.symbol, a.rn ORDER BY b.y) + (count(*) OVER (PARTITION BY a.symbol, a.rn, b.y) - 1) / 2.0 AS ry,
              rank() OVER (PARTITION BY a.symbol, a.rn ORDER BY b.{pred}) + (count(*) OVER (PARTITION BY a.symbol, a.rn, b.{pred}) - 1) / 2.0 AS rp
              FROM seq a JOIN seq b ON a.symbol = b.symbol AND b.rn - a.rn BETWEEN {lo} AND {hi}"""),
            (f"roll_{pred}", f"SELECT symbol, rn, {RHO.replace('coalesce(', '(').replace(', 0), 0)', ', 0))')} AS ic FROM pairs_{pred} GROUP BY 1, 2 HAVING count(*) = {n}")]


@case("eval03_rolling_ic", "SELECT s.symbol, s.date, r.ic AS rolling_ic FROM seq s LEFT JOIN roll_pred_a r USING (symbol, rn)", "scores", "rolling_ic",
      rolling_sql("pred_a", -251, 0))
def _(s, sf):
    return M.rolling_ic(X.scores(s, sf), "y", "pred_a").select("symbol", "date", "rolling_ic")


@case("eval04_ic_summary", """SELECT count(*) AS n_days, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, max_by(ic, date) AS ic_last,
      avg(CASE WHEN ic > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS positive_share FROM dic""", "scores", "ic_mean ic_std ic_last positive_share", DAY_IC)
def _(s, sf):
    return M.ic_summary(day_ic(s, sf))


@case("eval05_direction_accuracy", """SELECT fold, avg(CASE WHEN sign(y) = sign(pred_a) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS sign_,
      avg(CASE WHEN (y < -0.005) = (pred_a < -0.005) OR (y > 0.005) = (pred_a > 0.005) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS band FROM scores GROUP BY 1""",
      "scores", "sign_ band")
def _(s, sf):
    d = X.scores(s, sf)
    a = M.direction_accuracy(d, "y", "pred_a").withColumnRenamed("direction_accuracy", "sign_")
    return a.join(M.direction_accuracy(d, "y", "pred_a", "band").withColumnRenamed("direction_accuracy", "band"), "fold")


@case("eval06_mse_mae", "SELECT fold, count(*) AS n, avg((y - pred_a) * (y - pred_a)) AS mse, avg(abs(y - pred_a)) AS mae FROM scores GROUP BY 1", "scores", "mse mae")
def _(s, sf):
    return M.mse_mae(X.scores(s, sf), "y", "pred_a")


_Q = """avg(ln((1 + y * y) / greatest(v, 1e-10)) + 1 / greatest((1 + y * y) / greatest(v, 1e-10), 1e-10)) AS ratio,
   avg(ln(greatest(v * v, 1e-8)) + y * y / greatest(v * v, 1e-8)) AS vol, avg(ln(greatest(v, 1e-8)) + greatest(y * y, 1e-8) / greatest(v, 1e-8)) AS variance"""


@case("eval07_qlike", f"SELECT fold, {_Q} FROM (SELECT *, 0.1 + abs(pred_a) AS v FROM scores) GROUP BY 1", "scores", "ratio vol variance")
def _(s, sf):
    d = X.scores(s, sf).withColumns({"v": F.abs("pred_a") + 0.1, "y2": F.col("y") * F.col("y"), "y3": F.col("y") * F.col("y") + 1})
    out = None
    for target, mode in (("y3", "ratio"), ("y", "vol"), ("y2", "variance")):
        one = M.qlike(d, target, "v", mode).withColumnRenamed("qlike", mode)
        out = one if out is None else out.join(one, "fold")
    return out


# ---- return series: three strategies of the daily market return --------------------------------

STRAT = ("strat", """SELECT date, unnest(['market', 'half', 'short']) AS strategy, unnest([r / 5000, r / 10000 - 0.00002, -r / 5000]) AS r FROM daily""")
EQ = ("eq", """SELECT *, product(1 + r) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM strat""")
DD = ("dd", """SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak,
   equity / max(equity) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq""")


def strategies(s, sf):
    r = F.col("r") / 5000
    return X.daily(s, sf).select("date", F.inline(F.array(*[
        F.struct(F.lit(n).alias("strategy"), e.alias("r")) for n, e in (("market", r), ("half", r / 2 - 0.00002), ("short", -r))])))


@case("eval08_sharpe", """SELECT strategy, avg(r) / greatest(stddev_pop(r), 1e-10) * sqrt(252) AS pop, avg(r) / stddev_samp(r) * sqrt(252) AS sample,
      avg(r) / (stddev_samp(r) + 1e-10) * sqrt(252) AS eps, (avg(r) - 0.02 / 252) / stddev_pop(r) * sqrt(252) AS strict,
      sqrt(252) * avg(r) / sqrt(var_samp(r) + 1e-6) AS damped FROM strat GROUP BY 1""", "daily", "pop sample eps strict damped", [STRAT])
def _(s, sf):
    d, out = strategies(s, sf), None
    for mode, rf in (("pop", 0.0), ("sample", 0.0), ("eps", 0.0), ("strict", 0.02), ("damped", 0.0)):
        one = M.sharpe(d, "r", mode, rf).withColumnRenamed("sharpe", mode)
        out = one if out is None else out.join(one, "strategy")
    return out


@case("eval09_sortino", "SELECT strategy, avg(r) / (stddev_samp(r) FILTER (r < 0)) * sqrt(252) AS sortino FROM strat GROUP BY 1", "daily", "sortino", [STRAT])
def _(s, sf):
    return M.sortino(strategies(s, sf), "r")


@case("eval10_max_drawdown", """SELECT strategy, -min(drawdown) AS max_drawdown, min(date) FILTER (equity = p AND date <= trough) AS peak_at, any_value(trough) AS trough
      FROM dd JOIN (SELECT strategy, min_by(date, drawdown) AS trough, min_by(peak, drawdown) AS p FROM dd GROUP BY 1) USING (strategy) GROUP BY 1""",
      "daily", "max_drawdown", [STRAT, EQ, DD])
def _(s, sf):
    return M.max_drawdown(M.equity_curve(strategies(s, sf), "r"), mode="magnitude")


_RS = ("rs", """SELECT *, CASE WHEN row_number() OVER (PARTITION BY strategy ORDER BY date) >= 252 THEN avg(r) OVER w / stddev_pop(r) OVER w * sqrt(252) END AS rs
   FROM dd WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS 251 PRECEDING)""")
_PERF = ("perf", """SELECT *, CASE WHEN max_drawdown < 1e-8 THEN 0 ELSE annual_return / max_drawdown END AS calmar_ratio FROM (
   SELECT strategy, 'full' AS period, count(*) AS n_days, max_by(equity, date) / min_by(equity, date) - 1 AS total_return,
     pow(max_by(equity, date) / min_by(equity, date), 252.0 / count(*)) - 1 AS annual_return, stddev_pop(r) * sqrt(252) AS annual_volatility,
     avg(r) / stddev_pop(r) * sqrt(252) AS sharpe_ratio, -min(drawdown) AS max_drawdown, avg(rs) AS rolling_sharpe_mean, stddev_pop(rs) AS rolling_sharpe_std,
     min(rs) AS rolling_sharpe_min, max(rs) AS rolling_sharpe_max FROM rs GROUP BY 1)""")


def _perf(s, sf):
    return M.performance_table(M.equity_curve(strategies(s, sf), "r"), ret="r")


@case("eval11_performance_table", "SELECT * FROM perf", "daily", """total_return annual_return annual_volatility sharpe_ratio max_drawdown
      rolling_sharpe_mean rolling_sharpe_std rolling_sharpe_min rolling_sharpe_max calmar_ratio""", [STRAT, EQ, DD, _RS, _PERF])
def _(s, sf):
    return _perf(s, sf)


@case("eval11_performance_deltas", """SELECT 'full' AS period, a.sharpe_ratio - b.sharpe_ratio AS sharpe_delta, a.annual_return - b.annual_return AS return_delta,
      a.annual_volatility - b.annual_volatility AS vol_delta, a.max_drawdown - b.max_drawdown AS mdd_delta
      FROM perf a, perf b WHERE a.strategy = 'half' AND b.strategy = 'market'""", "daily", "sharpe_delta return_delta vol_delta mdd_delta",
      [STRAT, EQ, DD, _RS, _PERF])
def _(s, sf):
    return M.performance_deltas(_perf(s, sf), "half", "market")


@case("eval12_rolling_sharpe", "SELECT strategy, date, rs AS rolling_sharpe FROM rs", "daily", "rolling_sharpe", [STRAT, EQ, DD, _RS])
def _(s, sf):
    return M.rolling_sharpe(strategies(s, sf), "r").select("strategy", "date", "rolling_sharpe")


@case("eval13_win_rate", "SELECT strategy, avg(CASE WHEN r > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS win_rate FROM strat GROUP BY 1", "daily", "win_rate", [STRAT])
def _(s, sf):
    return M.win_rate(strategies(s, sf), "r")


@case("pf15_equity_curve", "SELECT strategy, date, equity, r AS ret FROM eq", "daily", "equity ret", [STRAT, EQ])
def _(s, sf):
    return M.returns_from_equity(M.equity_curve(strategies(s, sf), "r")).drop("r")


@case("eval14_hit_rate_by_decile", """SELECT decile, avg(hit) AS hit_rate, count(*) AS count, avg(pred_a) AS mean_signal, avg(hit) * 100 AS hit_rate_pct FROM (
      SELECT CAST(len(list_filter(q, lambda e: e < pred_a)) + 1 AS INT) AS decile, CASE WHEN sign(pred_a) = sign(y) THEN CAST(1 AS DOUBLE) ELSE 0 END AS hit, pred_a
      FROM scores, (SELECT quantile_cont(pred_a, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM scores)) GROUP BY 1""",
      "scores", "hit_rate mean_signal hit_rate_pct")
def _(s, sf):
    return M.hit_rate_by_decile(X.scores(s, sf), "pred_a", "y")


def _pos(pred: str) -> str:
    return f"""SELECT '{pred}' AS strategy, date, coalesce(avg(CASE WHEN p <> 0 THEN p * y / 100 END), 0) AS r FROM (
      SELECT date, y, CASE WHEN k > n - least(3, n // 2) THEN -1 WHEN k <= least(3, n // 2) THEN 1 ELSE 0 END AS p FROM (
        SELECT *, rank() OVER (PARTITION BY date ORDER BY {pred} DESC) + (count(*) OVER (PARTITION BY date, {pred}) - 1) / 2.0 AS k,
          count(*) OVER (PARTITION BY date) AS n FROM scores)) GROUP BY 2"""


@case("eval15_model_comparison", """SELECT strategy, max_by(equity, date) - 1 AS total_return, sqrt(252) * avg(r) / (stddev_samp(r) + 1e-10) AS sharpe,
      min(drawdown) AS max_drawdown, avg(CASE WHEN r > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS win_rate FROM dd GROUP BY 1""", "scores",
      "total_return sharpe max_drawdown win_rate", [("strat", f"{_pos('pred_a')} UNION ALL {_pos('pred_b')}"), EQ, DD])
def _(s, sf):
    d = X.scores(s, sf).withColumn("yy", F.col("y") / 100)
    return M.model_comparison(d, ["pred_a", "pred_b"], "yy", 3, 3)


@case("eval16_fold_summary", """SELECT model, 5 AS horizon, count(*) AS n_windows, avg(ic) AS ic_mean, stddev_pop(ic) AS ic_std, min(ic) AS ic_min, max(ic) AS ic_max
      FROM (SELECT 'pred_a' AS model, ic FROM fic UNION ALL SELECT 'pred_b', ic FROM ficb) GROUP BY 1""", "scores", "ic_mean ic_std ic_min ic_max",
      [*FOLD_IC, ("rankedb", RANKS("fold", "pred_b")), ("ficb", f"SELECT fold, {RHO} AS ic FROM rankedb GROUP BY 1")])
def _(s, sf):
    both = [fold_ic(s, sf, p).withColumns({"model": F.lit(p), "horizon": F.lit(5)}) for p in ("pred_a", "pred_b")]
    return M.fold_summary(both[0].unionByName(both[1]), ["ic"])


@case("eval16_cross_seed_summary", """SELECT 'm' AS model, 5 AS horizon, count(*) AS n_seeds, avg(m) AS ic_mean, stddev_pop(m) AS ic_std
      FROM (SELECT CAST(symbol AS INT) % 3 AS seed, avg(ic) AS m FROM sic GROUP BY 1)""", "scores", "ic_mean ic_std", SYM_IC)
def _(s, sf):
    d = M.spearman_ic(X.scores(s, sf), "y", "pred_a", by=["symbol"])
    d = d.withColumns({"seed": F.col("symbol").cast("int") % 3, "model": F.lit("m"), "horizon": F.lit(5)})
    return M.cross_seed_summary(d, "ic")


def _losses(s, sf):
    d = X.scores(s, sf)
    return d.withColumns({"l1": F.pow(F.col("y") - F.col("pred_a"), F.lit(2.0)), "l2": F.pow(F.col("y") + 0.5 * F.col("pred_b"), F.lit(2.0))})


_D = [("dl", """SELECT symbol, date, d - avg(d) OVER (PARTITION BY symbol) AS c, d FROM (
        SELECT symbol, date, pow(y - pred_a, 2) - pow(y + 0.5 * pred_b, 2) AS d FROM scores)"""),
      ("dg", f"""SELECT *, {', '.join(f'c * lag(c, {k}) OVER w AS g{k}' for k in range(1, 6))} FROM dl WINDOW w AS (PARTITION BY symbol ORDER BY date)""")]


@case("eval17_diebold_mariano", f"""SELECT symbol, count(*) AS n, avg(d) AS mean_differential,
      avg(d) / greatest(sqrt(greatest(var_pop(d) / count(*) + {' + '.join(f'2 * (1 - {k} / 5.0) * avg(g{k}) / count(*)' for k in range(1, 5))}, 0)), 1e-10) AS dm_statistic
      FROM dg GROUP BY 1""", "scores", "mean_differential dm_statistic", _D)
def _(s, sf):
    return I.diebold_mariano(_losses(s, sf), "l1", "l2", h=5).drop("p_value")


@case("eval17_diebold_mariano_simple", f"""SELECT symbol, count(*) AS n, avg(d) AS mean_differential,
      avg(d) / sqrt(greatest(var_pop(d) / count(*) + {' + '.join(f'2.0 * (count(*) - {k}) / (count(*) * count(*)) * avg(g{k})' for k in range(1, 3))}, 1e-12)) AS dm_statistic
      FROM dg GROUP BY 1""", "scores", "mean_differential dm_statistic", _D)
def _(s, sf):
    return I.diebold_mariano(_losses(s, sf), "l1", "l2", h=2, variant="simple").drop("p_value")


@case("eval17_diebold_mariano_p")
def _(s, sf):
    return I.diebold_mariano(_losses(s, sf), "l1", "l2", h=5).select("symbol", "p_value")


@case("eval18_t_tests", """SELECT count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t_statistic FROM sic""",
      "scores", "mean std t_statistic", SYM_IC)
def _(s, sf):
    return I.t_test(M.spearman_ic(X.scores(s, sf), "y", "pred_a", by=["symbol"]), "ic").drop("p_value")


@case("eval19_binomial_sign_test", """SELECT n, n_positive, (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))
      FROM (SELECT unnest(range(n_positive, n + 1)) AS k)) AS p_value FROM (SELECT count(*) AS n, count(*) FILTER (ic > -0.44) AS n_positive FROM sic)""",
      "scores", "p_value", SYM_IC)
def _(s, sf):
    d = M.spearman_ic(X.scores(s, sf), "y", "pred_a", by=["symbol"])
    return I.binomial_sign_test(d.withColumn("x", F.col("ic") + 0.44), "x")


_BOOT = [*FOLD_IC, ("series", "SELECT ic, row_number() OVER (ORDER BY fold) - 1 AS p, count(*) OVER () AS n FROM fic"),
         ("draws", """SELECT rep, CAST('0x' || substr(md5('42|' || rep || '|' || p), 1, 8) AS BIGINT) % n AS pick FROM series, (SELECT unnest(range(0, 1000)) AS rep)""")]


@case("eval20_bootstrap_ci", """SELECT quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (
      SELECT rep, avg(ic) AS m FROM draws JOIN series ON p = pick GROUP BY 1)""", "scores", "ci_low ci_high", _BOOT)
def _(s, sf):
    return I.bootstrap_ci(fold_ic(s, sf), "ic", "fold")


@case("eval21_loo_range", """SELECT max(m) - min(m) AS loo_range FROM (SELECT (sum(ic) OVER () - ic) / (count(*) OVER () - 1) AS m FROM fic)""", "scores", "loo_range", FOLD_IC)
def _(s, sf):
    return I.loo_range(fold_ic(s, sf), "ic")


@case("eval22_stability_stats", """SELECT count(*) AS n_windows, avg(ic) AS mean_ic, stddev_pop(ic) AS std_ic, stddev_pop(ic) / greatest(abs(avg(ic)), 1e-8) AS cv,
      avg(ic) / (stddev_pop(ic) / sqrt(count(*))) AS t_stat, avg(CASE WHEN ic > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS positive_share,
      avg(ic) FILTER (p >= n - 3) - CASE WHEN count(*) >= 8 THEN avg(ic) FILTER (p < 8) ELSE avg(ic) END AS recency_decay,
      avg(ic) FILTER (p >= n // 2) - avg(ic) FILTER (p < n // 2) AS half_decay, avg(b - ic) AS gap_mean, max(b - ic) AS gap_max
      FROM (SELECT f.ic, g.ic AS b, row_number() OVER (ORDER BY fold) - 1 AS p, count(*) OVER () AS n FROM fic f JOIN ficb g USING (fold))""",
      "scores", "mean_ic std_ic cv t_stat positive_share recency_decay half_decay gap_mean gap_max",
      [*FOLD_IC, ("rankedb", RANKS("fold", "pred_b")), ("ficb", f"SELECT fold, {RHO} AS ic FROM rankedb GROUP BY 1")])
def _(s, sf):
    both = fold_ic(s, sf).join(fold_ic(s, sf, "pred_b").select("fold", F.col("ic").alias("train_ic")), "fold")
    return I.stability_stats(both, "ic", "train_ic")


@case("eval24_per_symbol_ic_distribution", """SELECT count(*) AS n_symbols, count(*) FILTER (ic > 0) AS n_positive, avg(ic) AS ic_mean, stddev_pop(ic) AS ic_std, min(ic) AS ic_min,
      max(ic) AS ic_max, avg(CASE WHEN ic > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS positive_share, quantile_cont(ic, 0.1) AS p10, quantile_cont(ic, 0.25) AS p25,
      quantile_cont(ic, 0.5) AS p50, quantile_cont(ic, 0.75) AS p75, quantile_cont(ic, 0.9) AS p90 FROM sic""", "scores",
      "ic_mean ic_std ic_min ic_max positive_share p10 p25 p50 p75 p90", SYM_IC)
def _(s, sf):
    return M.per_symbol_ic_distribution(M.spearman_ic(X.scores(s, sf), "y", "pred_a", by=["symbol"]))


@case("eval25_ic_gate_verdict", """SELECT count(*) FILTER (passed) AS n_pass, count(*) AS n_total,
      CASE WHEN count(*) FILTER (passed) >= 0.7 * count(*) THEN 'PASS' WHEN count(*) FILTER (passed) >= 0.5 * count(*) THEN 'BORDERLINE' ELSE 'FAIL' END AS verdict
      FROM (SELECT unnest([abs(m) > 0.02, cv < 0.6, decay > -0.03, half > -0.02, false, false, false, false, false, false, false]) AS passed FROM (
        SELECT avg(ic) AS m, stddev_pop(ic) / abs(avg(ic)) AS cv, avg(ic) FILTER (p >= n - 3) - avg(ic) AS decay,
          avg(ic) FILTER (p >= n // 2) - avg(ic) FILTER (p < n // 2) AS half
        FROM (SELECT ic, row_number() OVER (ORDER BY fold) - 1 AS p, count(*) OVER () AS n FROM fic)))""", "scores", "", FOLD_IC)
def _(s, sf):
    stats = I.stability_stats(fold_ic(s, sf), "ic").withColumn("abs_ic", F.abs("mean_ic"))
    return I.ic_gate_verdict(I.ic_gate_checks(stats))


_PR = [("wide", """SELECT symbol, avg(pow(y - pred_a, 2)) AS a, avg(pow(y - pred_b, 2)) AS b, avg(y * y) AS zero, avg(pow(y - 0.1, 2)) AS tenth FROM scores GROUP BY 1"""),
       ("long", "SELECT symbol, unnest(['a', 'b', 'zero', 'tenth']) AS predictor, unnest([a, b, zero, tenth]) AS loss FROM wide")]


@case("eval26_predictor_ranks", """SELECT predictor, avg(loss) AS mean_loss, median(loss) AS median_loss, stddev_pop(loss) AS std_loss, count(*) AS n_valid, avg(k - 1) AS mean_rank,
      (SELECT avg(CASE WHEN b < a THEN CAST(1 AS DOUBLE) ELSE 0 END) FROM wide) AS share_a_beats_b
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY loss) AS k FROM long) GROUP BY 1""", "scores",
      "mean_loss median_loss std_loss mean_rank share_a_beats_b", _PR)
def _(s, sf):
    y, sq = F.col("y"), lambda e: F.avg(F.pow(e, F.lit(2.0)))
    wide = X.scores(s, sf).groupBy("symbol").agg(
        sq(y - F.col("pred_a")).alias("a"), sq(y - F.col("pred_b")).alias("b"), sq(y).alias("zero"), sq(y - 0.1).alias("tenth"))
    return M.predictor_ranks(wide, ["a", "b", "zero", "tenth"], "b", "a")


def _rounds(source: str, rounds: int = I.ROUNDS) -> str:
    """Nested queries, one a round: swap place k with (offset - k) mod n where the pair's bit is set."""
    for i in range(rounds):
        pair = f"SELECT *, pmod_n AS other, ((greatest(k, pmod_n) & {I.LOW}) * (2 * f{i} + 1) >> 29) & 1 AS bit FROM (SELECT *, ((o{i} - k) % n + n) % n AS pmod_n FROM {source})"
        source = f"(SELECT * EXCLUDE (k, other, bit, pmod_n), CASE WHEN bit = 1 THEN other ELSE k END AS k FROM ({pair}))"
    return source


_KEYS = "SELECT rep, " + ", ".join(
    f"('0x' || substr(md5(rep || '|{i}|42'), 1, 14))::BIGINT AS o{i}, ('0x' || substr(md5(rep || '|{i}|42'), 15, 7))::BIGINT AS f{i}" for i in range(I.ROUNDS)) + \
    " FROM (SELECT unnest(range(1, 101)) AS rep)"
_PERM = [("ranked", RANKS("fold")), ("base", """SELECT fold, ry, rp, row_number() OVER (PARTITION BY fold ORDER BY md5(symbol || '|' || date)) - 1 AS k,
            count(*) OVER (PARTITION BY fold) AS n FROM ranked"""),
         ("rk", _KEYS),
         ("mixed", f"SELECT fold, rep, ry, k FROM {_rounds('(SELECT fold, ry, k, n, rk.* FROM base, rk)')}"),
         ("nul", f"SELECT m.fold, m.rep, {RHO} AS ic FROM (SELECT m.fold, m.rep, m.ry, b.rp FROM mixed m JOIN base b ON b.fold = m.fold AND b.k = m.k) m GROUP BY 1, 2"),
         ("obs", f"SELECT fold, {RHO} AS o FROM base GROUP BY 1")]


@case("eval27_permutation_test", """SELECT fold, any_value(o) AS observed_ic, avg(ic) AS null_mean, stddev_pop(ic) AS null_std, avg(CASE WHEN ic >= o THEN CAST(1 AS DOUBLE) ELSE 0 END) AS p_one_sided,
      avg(CASE WHEN abs(ic) >= abs(o) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS p_two_sided FROM nul JOIN obs USING (fold) GROUP BY 1""",
      "scores", "observed_ic null_mean null_std p_one_sided p_two_sided", _PERM)
def _(s, sf):
    return I.permutation_test(X.scores(s, sf), "y", "pred_a")


@case("eval28_min_detectable_ic", """SELECT n, observed_ic, 1 / sqrt(n - 3) AS se_fisher_z, m AS min_ic, abs(observed_ic) / m AS ratio, m * m AS r_squared, abs(observed_ic) >= m AS detectable
      FROM (SELECT count(*) AS n, avg(ic) AS observed_ic, (exp(2 * 2.8015852181129683 / sqrt(count(*) - 3)) - 1) / (exp(2 * 2.8015852181129683 / sqrt(count(*) - 3)) + 1) AS m FROM dic)""",
      "scores", "observed_ic se_fisher_z min_ic ratio r_squared", DAY_IC)
def _(s, sf):
    return I.min_detectable_ic(day_ic(s, sf))


_HASH = "(CAST('0x' || substr(md5(symbol || '|' || date || '|0|{i}'), 1, 8) AS BIGINT) + 1) / (pow(2, 32) + 1)"


@case("eval29_naive_baselines", f"""SELECT symbol, date, sqrt(-2 * ln({_HASH.format(i=0)})) * cos(6.283185307179586 * {_HASH.format(i=1)}) AS random_pred, -pred_a AS meanrev_pred FROM scores""",
      "scores", "random_pred meanrev_pred")
def _(s, sf):
    return I.naive_baselines(X.scores(s, sf), "pred_a").select("symbol", "date", "random_pred", "meanrev_pred")


_LOSS = [("losses", """SELECT fold, avg(e * e) AS mse, avg(abs(e)) AS mae, avg(CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END) AS huber,
      avg(greatest(0.05 * -e, -0.95 * -e)) AS pinball, avg(greatest(p, 0) - p * u + ln(1 + exp(-abs(p)))) AS logloss,
      avg(abs(e) * exp(CASE WHEN sign(p) = sign(y) THEN -0.5 ELSE 0.5 END)) AS gmadl, avg(p * p) AS l2,
      sqrt(252) * avg(tanh(p) * y) / sqrt(var_samp(tanh(p) * y) + 1e-6) AS sh, sqrt(252) * avg(sign(p) * y) / sqrt(var_samp(sign(p) * y) + 1e-6) AS sg
      FROM (SELECT fold, y, pred_a AS p, pred_a - y AS e, CASE WHEN y > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS u FROM scores) GROUP BY 1""")]


@case("eval30_loss_metrics", "SELECT fold, mse, mae, huber, pinball, logloss, gmadl FROM losses", "scores", "mse mae huber pinball logloss gmadl", _LOSS)
def _(s, sf):
    return M.loss_metrics(X.scores(s, sf), "y", "pred_a", tau=0.05)


@case("eval31_composite_loss_value", "SELECT fold, mse + 0.1 * pinball + logloss + 0.01 * l2 - 0.1 * sh AS loss FROM losses", "scores", "loss", _LOSS)
def _(s, sf):
    return M.composite_loss_value(X.scores(s, sf), "y", "pred_a", w_l2=0.01, w_sharpe=0.1)


SOFT = [("soft", """SELECT a.symbol, a.date, any_value(a.y) AS y, any_value(a.pred_a) AS pred_a, sum(1 / (1 + exp(-(a.y - b.y) / 0.1))) AS ky, sum(1 / (1 + exp(-(a.pred_a - b.pred_a) / 0.1))) AS kp
      FROM scores a JOIN scores b ON a.date = b.date GROUP BY 1, 2"""),
        ("rankic", """SELECT date, 1 - covar_pop(ky, kp) * count(*) / (sqrt(var_pop(ky) * count(*) + 1e-8) * sqrt(var_pop(kp) * count(*) + 1e-8) + 1e-8) AS rankic_loss,
      avg(pow(pred_a - y, 2)) AS mse, avg(pred_a * pred_a) AS l2 FROM soft GROUP BY 1""")]


@case("eval31_rank_composite_value", "SELECT date, 0.5 * mse + 0.3 * rankic_loss + 0.2 * l2 AS loss FROM rankic", "scores", "loss", SOFT)
def _(s, sf):
    return M.rank_composite_value(X.scores(s, sf), "y", "pred_a", by=["date"])


@case("eval32_strategy_sharpe_of_positions", "SELECT fold, sh AS tanh_sharpe, sg AS sign_sharpe FROM losses", "scores", "tanh_sharpe sign_sharpe", _LOSS)
def _(s, sf):
    d = X.scores(s, sf)
    a = M.strategy_sharpe_of_positions(d, "pred_a", "y").withColumnRenamed("sharpe", "tanh_sharpe")
    return a.join(M.strategy_sharpe_of_positions(d, "pred_a", "y", "sign").withColumnRenamed("sharpe", "sign_sharpe"), "fold")


@case("eval32_portfolio_sharpe", """SELECT fold, (avg(p) - 0.02 / 252) / (stddev_pop(p) + 1e-8) AS sharpe FROM (
      SELECT fold, date, sum(pred_b * y) AS p FROM scores GROUP BY 1, 2) GROUP BY 1""", "scores", "sharpe")
def _(s, sf):
    return M.portfolio_sharpe(X.scores(s, sf), "pred_b", "y")
