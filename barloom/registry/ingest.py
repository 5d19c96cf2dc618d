"""Queries of scans, panel shaping, projections and targets."""

from pyspark.sql import functions as F

from barloom.operators import returns as R
from barloom.registry import case
from barloom.registry import tables as X

W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


@case("prj01_simple_return", "SELECT symbol, date, r AS simple_return FROM ret", "ret", "simple_return")
def _(s, sf):
    return R.simple_return(X.px(s, sf)).select("symbol", "date", "simple_return")


@case("prj02_log_return", "SELECT symbol, date, coalesce(ln(close / prev), 0) AS log_return, coalesce(ln(close / prev), 0) * 100 AS scaled FROM px",
      "px", "log_return scaled")
def _(s, sf):
    d = R.log_return(X.px(s, sf))
    return R.log_return(d, scale=100.0, out="scaled").select("symbol", "date", "log_return", "scaled")


@case("prj03_forward_return", f"""SELECT symbol, date, lead(close, 5) OVER w / close - 1 AS fwd,
      coalesce(lead(close, 5) OVER w / close - 1, 0) AS fwd_zero FROM bars {W}""", "bars", "fwd fwd_zero")
def _(s, sf):
    d = R.forward_return(X.px(s, sf), periods=5, out="fwd")
    return R.forward_return(d, periods=5, tail="zero", out="fwd_zero").select("symbol", "date", "fwd", "fwd_zero")


@case("prj04_multi_horizon_targets", f"""SELECT symbol, date, lead(close) OVER w / close - 1 AS target_1,
      lead(close, 5) OVER w / close - 1 AS target_5, lead(close, 21) OVER w / close - 1 AS target_21 FROM bars {W}""",
      "bars", "target_1 target_5 target_21")
def _(s, sf):
    return R.multi_horizon_targets(X.px(s, sf)).drop("close", "volume")


@case("prj05_backward_return_target", f"SELECT symbol, date, close / lag(close, 5) OVER w - 1 AS backward_return FROM bars {W}",
      "bars", "backward_return")
def _(s, sf):
    return R.backward_return_target(X.px(s, sf)).drop("close", "volume")


@case("prj06_vol_adjusted_return", f"""SELECT symbol, date, CASE WHEN rn > 21 THEN (lead(close, 5) OVER w / close - 1)
      / greatest(stddev_pop(r) OVER (w ROWS 20 PRECEDING), 1e-6) END AS vol_adjusted_return FROM ret {W}""",
      "ret", "vol_adjusted_return")
def _(s, sf):
    return R.vol_adjusted_return(X.px(s, sf)).drop("close", "volume")


@case("prj07_forward_realized_vol", f"""SELECT symbol, date, CASE WHEN count(r1) OVER f = 21 THEN stddev_samp(r1) OVER f END AS forward_vol
      FROM (SELECT *, close / prev - 1 AS r1 FROM px)
      WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)""", "px", "forward_vol")
def _(s, sf):
    return R.forward_realized_vol(X.px(s, sf)).drop("close", "volume")


@case("prj09_demean_target_by_date", "SELECT symbol, date, y - avg(y) OVER (PARTITION BY date) AS y_demeaned FROM scores",
      "scores", "y_demeaned")
def _(s, sf):
    return R.demean_target_by_date(X.scores(s, sf), "y").select("symbol", "date", "y_demeaned")


@case("prj10_direction_class", "SELECT symbol, date, CAST(sign(y) + 1 AS INT) AS direction FROM scores", "scores")
def _(s, sf):
    return R.direction_class(X.scores(s, sf), "y").select("symbol", "date", "direction")


@case("prj11_class_weights", """SELECT direction, n, total / (3 * (n + 1e-6)) AS weight FROM (
      SELECT *, sum(n) OVER () AS total, count(*) OVER () AS k FROM (
        SELECT CAST(sign(y) + 1 AS INT) AS direction, count(*) AS n FROM scores GROUP BY 1)) WHERE k > 1""",
      "scores", "weight")
def _(s, sf):
    return R.class_weights(R.direction_class(X.scores(s, sf), "y"))


@case("prj12_log_target_floor", """SELECT symbol, date, ln(greatest(y * y, 1e-8)) AS log_target,
      exp(least(greatest(ln(greatest(y * y, 1e-8)), -50), 50)) AS variance FROM scores""", "scores", "log_target variance")
def _(s, sf):
    d = R.log_target_floor(X.scores(s, sf).withColumn("sq", F.col("y") * F.col("y")), "sq")
    return R.exp_clipped(d, "log_target").select("symbol", "date", "log_target", "variance")


# ---- sources -------------------------------------------------------------------

from barloom.operators import panel as P  # noqa: E402
from barloom.session import shared_folder  # noqa: E402
from barloom.sources import bars as B  # noqa: E402
from barloom.sources.store import write_predictions  # noqa: E402


@case("src01_read_bars", """SELECT symbol, date, close, volume FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 500)""",
      "bars", "close volume")
def _(s, sf):
    path = shared_folder(s)
    write_predictions(X.bars(s, sf), path)
    return B.read_bars(s, path, "parquet", 500).select("symbol", "date", "close", "volume")


@case("src06_write_predictions", "SELECT symbol, date, pred_a, y, fold FROM scores", "scores", "pred_a y")
def _(s, sf):
    path = shared_folder(s)
    write_predictions(X.scores(s, sf).drop("pred_b"), path, "csv", ["fold"])
    schema = "symbol string, date date, pred_a double, y double, fold int"
    return s.read.schema(schema).option("header", True).csv(path)


@case("src02_merge_symbols", """SELECT symbol, date, close, volume FROM bars WHERE CAST(symbol AS INT) % 2 = 0
      UNION ALL SELECT symbol, date, close, volume FROM bars WHERE CAST(symbol AS INT) % 2 = 1""", "bars", "close volume")
def _(s, sf):
    b = X.bars(s, sf)
    odd = F.col("symbol").cast("int") % 2
    return B.merge_symbols(b.filter(odd == 0), b.filter(odd == 1)).select("symbol", "date", "close", "volume")


@case("src03_tidy_wide_quotes", """SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, CAST(NULL AS DOUBLE) AS open,
      max(l_extendedprice) AS high, min(l_extendedprice) AS low, avg(l_extendedprice) AS close, sum(l_quantity) AS volume
      FROM lineitem GROUP BY 1, 2""", "", "high low close volume")
def _(s, sf):
    items = s.read.parquet(f"{sf}/lineitem.parquet").withColumn("date", F.col("l_shipdate").cast("date"))
    parts = {"High": F.max("l_extendedprice"), "Low": F.min("l_extendedprice"),
             "Adj Close": F.avg("l_extendedprice"), "Volume": F.sum("l_quantity")}
    flags = ["A", "N", "R"]
    cells = items.groupBy("date").pivot("l_returnflag", flags).agg(*[e.alias(n) for n, e in parts.items()])
    wide = cells.select("date", *[F.col(f"`{f}_{n}`").alias(f"{n}|{f}") for f in flags for n in parts])
    return B.tidy_wide_quotes(wide)


@case("src04_clean_tickers", """SELECT replace(t, '.', '-') AS symbol, min(pos) AS pos FROM (
      SELECT upper(trim(regexp_replace(raw, '\\[[^\\]]*\\]', '', 'g'))) AS t, pos FROM (
        SELECT split_part(p_name, ' ', 1) || '.' || substr(p_type, 1, 1) || '[' || p_partkey || ']' AS raw, p_partkey AS pos FROM part
        UNION ALL SELECT p_brand, p_partkey FROM part))
      WHERE regexp_matches(t, '^[A-Z]{1,8}(\\.[A-Z]{1,5})?$') GROUP BY t""")
def _(s, sf):
    part = s.read.parquet(f"{sf}/part.parquet")
    raw = F.concat(F.split("p_name", " ")[0], F.lit("."), F.substring("p_type", 1, 1), F.lit("["), F.col("p_partkey"), F.lit("]"))
    names = part.select(raw.alias("ticker"), F.col("p_partkey").alias("pos")).union(part.select("p_brand", "p_partkey"))
    return B.clean_tickers(names)


def _series(s, sf, priority):
    o = s.read.parquet(f"{sf}/orders.parquet").filter(F.col("o_orderpriority") == priority)
    return o.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.avg("o_totalprice").alias("value"))


def _macro_sql(bfill: bool) -> str:
    fill = "coalesce({0}, (SELECT min_by({0}, date) FROM carried WHERE {0} IS NOT NULL))" if bfill else "{0}"
    return f"SELECT date, {fill.format('urgent')} AS urgent, {fill.format('low')} AS low FROM carried"


_MACRO = [
    (f"{name}_s", f"""SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value FROM orders
     WHERE o_orderpriority = '{prio}' GROUP BY 1""") for name, prio in (("urgent", "1-URGENT"), ("low", "5-LOW"))
] + [
    (f"{name}_g", f"""SELECT d.date, v.value AS {name} FROM (
       SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM {name}_s) d
     ASOF LEFT JOIN {name}_s v ON d.date >= v.date WHERE isodow(d.date) < 6""") for name in ("urgent", "low")
] + [("carried", """SELECT date, last_value(urgent IGNORE NULLS) OVER w AS urgent, last_value(low IGNORE NULLS) OVER w AS low
     FROM (SELECT coalesce(a.date, b.date) AS date, urgent, low FROM urgent_g a FULL JOIN low_g b ON a.date = b.date)
     WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""")]


@case("src05_calendar_resample_ffill", _macro_sql(True), ctes=_MACRO, nums="urgent low")
def _(s, sf):
    return B.calendar_resample_ffill({"urgent": _series(s, sf, "1-URGENT"), "low": _series(s, sf, "5-LOW")}, bfill=True)


# ---- panel -----------------------------------------------------------------------

@case("pan01_min_history_filter", """SELECT symbol, date, close FROM bars WHERE symbol IN (
      SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 535)""", "bars", "close")
def _(s, sf):
    return P.min_history_filter(X.bars(s, sf).select("symbol", "date", "close"), 535)


@case("pan02_top_liquid_universe", """SELECT symbol, date, volume FROM bars WHERE symbol IN (
      SELECT symbol FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars)
      WHERE k <= 252 GROUP BY 1 ORDER BY avg(volume) DESC, symbol LIMIT 30)""", "bars", "volume")
def _(s, sf):
    return P.top_liquid_universe(X.bars(s, sf).select("symbol", "date", "volume"), 30)


_BRAND = ("brand", """SELECT p_type AS symbol, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS volume
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")


def _brand(s, sf):
    li = s.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_quantity")
    part = s.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_type")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_type").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_quantity").alias("volume"))


@case("pan03_calendar_intersect", """SELECT * FROM brand WHERE date IN (SELECT date FROM brand GROUP BY 1
      HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM brand))""", ctes=[_BRAND], nums="volume")
def _(s, sf):
    return P.calendar_intersect(_brand(s, sf))


@case("pan04_calendar_union_panel", """SELECT s.symbol, d.date, b.close FROM (SELECT DISTINCT symbol FROM bars) s
      CROSS JOIN (SELECT DISTINCT date FROM bars) d LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = d.date""", "bars", "close")
def _(s, sf):
    return P.calendar_union_panel(X.bars(s, sf).select("symbol", "date", "close"))


@case("pan05_coverage_stats", """SELECT min(n) AS min_names, CAST(median(n) AS DOUBLE) AS median_names, max(n) AS max_names
      FROM (SELECT date, count(*) AS n FROM bars GROUP BY 1)""", "bars", "median_names")
def _(s, sf):
    return P.coverage_stats(X.bars(s, sf))


@case("pan06_panel_build", """SELECT symbol, date, pred_a, y, close, volume FROM scores JOIN bars USING (symbol, date)""",
      "scores", "pred_a y close volume")
def _(s, sf):
    sc = X.scores(s, sf)
    return P.panel_build(sc.select("date", "symbol", "pred_a"), X.bars(s, sf).select("date", "symbol", "close", "volume"),
                         sc.select("date", "symbol", "y"))


@case("pan07_triple_align", f"""SELECT symbol, date, m, fwd, liq FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM (
      SELECT symbol, date, close / lag(close, 21) OVER w - 1 AS m, lead(close, 5) OVER w / close - 1 AS fwd,
        CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(volume) OVER (w ROWS 19 PRECEDING) END AS liq
      FROM bars {W}) WHERE m IS NOT NULL AND fwd IS NOT NULL AND liq IS NOT NULL) WHERE n >= 500""", "bars", "m fwd liq")
def _(s, sf):
    from barloom.operators import rolling as G

    b, key = X.px(s, sf), ["symbol", "date"]
    f = G.momentum(b, periods=[21]).select(*key, F.col("mom_21").alias("m"))
    t = R.forward_return(b, periods=5, out="fwd").select(*key, "fwd")
    v = G.rolling_liquidity(b, out="liq").select(*key, "liq")
    return P.triple_align(f, t, v, 500)


@case("pan08_macro_asof_join", """SELECT b.symbol, b.date, b.close, m.value AS macro FROM bars b
      LEFT JOIN (SELECT d.date, v.value FROM (SELECT DISTINCT date FROM bars) d ASOF LEFT JOIN urgent_s v ON d.date >= v.date) m
      ON b.date = m.date""", "bars", "close macro", ctes=_MACRO[:1])
def _(s, sf):
    macro = _series(s, sf, "1-URGENT").withColumnRenamed("value", "macro")
    return P.macro_asof_join(X.bars(s, sf).select("symbol", "date", "close"), macro, ["macro"])


@case("pan09_date_index", "SELECT symbol, date, date_idx FROM bars JOIN days USING (date)", "bars days")
def _(s, sf):
    return P.date_index(X.bars(s, sf).select("symbol", "date"))


@case("pan10_return_alignment", f"""SELECT symbol, date, nr AS next_return, coalesce(lag(nr * nr) OVER w, avg(nr * nr) OVER (PARTITION BY symbol)) AS sq_return_lag1
      FROM (SELECT symbol, date, ln(lead(close) OVER w / close) * 100 AS nr FROM bars {W}) WHERE nr IS NOT NULL {W}""",
      "bars", "next_return sq_return_lag1")
def _(s, sf):
    return P.return_alignment(X.px(s, sf)).select("symbol", "date", "next_return", "sq_return_lag1")


_ROLES = ("roled", """SELECT symbol, date, year(date) - 1995 AS fold, CASE WHEN month(date) <= 8 THEN 'train' ELSE 'val' END AS role,
   close / lag(close, 21) OVER w - 1 AS m, lead(close, 5) OVER w / close - 1 AS y FROM bars
   WINDOW w AS (PARTITION BY symbol ORDER BY date)""")


def _roled(s, sf):
    from barloom.operators import rolling as G

    d = R.forward_return(G.momentum(X.px(s, sf), periods=[21]), periods=5, out="y")
    return d.select("symbol", "date", (F.year("date") - 1995).alias("fold"),
                    F.when(F.month("date") <= 8, "train").otherwise("val").alias("role"), F.col("mom_21").alias("m"), "y")


@case("pan11_valid_row_filter", """SELECT * FROM roled r WHERE m IS NOT NULL AND y IS NOT NULL AND fold IN (
      SELECT fold FROM roled WHERE m IS NOT NULL AND y IS NOT NULL GROUP BY 1
      HAVING count(*) FILTER (role = 'train') >= 200 AND count(*) FILTER (role = 'val') >= 50)""", "bars", "m y", [_ROLES])
def _(s, sf):
    return P.valid_row_filter(_roled(s, sf), ["m"], "y")


@case("pan12_impute_columns", """SELECT symbol, date, fold, role, coalesce(m, 0) AS m_zero,
      coalesce(m, avg(m) FILTER (role = 'train') OVER (PARTITION BY fold), 0) AS m FROM roled""", "bars", "m m_zero", [_ROLES])
def _(s, sf):
    d = P.impute_columns(_roled(s, sf).withColumn("m_zero", F.col("m")), ["m_zero"])
    return P.impute_columns(d, ["m"], "mean").drop("y")


@case("pan13_set_checks", """SELECT fold, count(*) FILTER (tr = 1) AS n_train, count(*) FILTER (te = 1) AS n_test,
      count(*) FILTER (tr = 1 AND te = 1) AS n_both, count(*) AS n_keys FROM (SELECT fold, symbol,
        max(CASE WHEN role = 'train' THEN 1 ELSE 0 END) AS tr, max(CASE WHEN role <> 'train' THEN 1 ELSE 0 END) AS te
      FROM roled GROUP BY 1, 2) GROUP BY 1""", "bars", "", [_ROLES])
def _(s, sf):
    return P.set_checks(_roled(s, sf), ["symbol"])
