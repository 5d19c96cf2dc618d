"""Queries of orders, fills and positions, on the events and orders tables."""

from pyspark.sql import functions as F

from barloom.operators import ledger as L
from barloom.registry import case

FILLS = [("fills", """SELECT CAST(user_id AS VARCHAR) AS account, 'S' || (CAST(json_extract_string(props, '$.k') AS INT) % 4) AS symbol, event_id AS seq,
            CASE WHEN event_type IN ('error', 'view') THEN 'sell' ELSE 'buy' END AS side, round(value) AS qty, 10 + CAST(json_extract_string(props, '$.k') AS INT) / 4.0 AS price
          FROM events"""),
         ("f", "SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY seq) AS k FROM fills WHERE qty > 0 AND price > 0"),
         ("walk(account, symbol, k, q, av, held, pl)", """SELECT account, symbol, k, CASE side WHEN 'buy' THEN qty ELSE -qty END, price, true, CAST(0 AS DOUBLE) FROM f WHERE k = 1
          UNION ALL SELECT f.account, f.symbol, f.k,
            CASE WHEN f.side = 'buy' THEN w.q + f.qty WHEN abs(w.q - f.qty) < 1e-10 THEN 0 ELSE w.q - f.qty END,
            CASE WHEN NOT w.held THEN f.price WHEN f.side = 'buy' AND w.q + f.qty <> 0 THEN (w.q * w.av + f.qty * f.price) / (w.q + f.qty) ELSE w.av END,
            f.side = 'buy' OR abs(w.q - f.qty) >= 1e-10,
            w.pl + CASE WHEN f.side = 'sell' AND w.held AND w.q > 0 THEN least(f.qty, w.q) * (f.price - w.av) ELSE 0 END
          FROM walk w JOIN f ON f.account = w.account AND f.symbol = w.symbol AND f.k = w.k + 1"""),
         ("pos", """SELECT a.account, a.symbol, w.q AS qty, CASE WHEN w.q <> 0 THEN w.av END AS avg_entry_price, w.pl AS realized_pl, a.cash AS cash_flow, a.n AS n_fills
          FROM (SELECT account, symbol, sum(CASE side WHEN 'buy' THEN -qty ELSE qty END * price) AS cash, count(*) AS n FROM f GROUP BY 1, 2) a
          JOIN walk w ON w.account = a.account AND w.symbol = a.symbol AND w.k = a.n"""),
         ("last", "SELECT symbol, max_by(price, seq) AS price FROM fills GROUP BY 1"),
         ("val", """SELECT *, cash + pv AS nav, CASE WHEN cash + pv > 0 THEN gv / (cash + pv) ELSE 0 END AS exposure, greatest(cash, 0) AS buying_power FROM (
          SELECT account, 100000 + sum(cash_flow) AS cash, sum(qty * price) AS pv, sum(abs(qty * price)) AS gv, sum(qty * price - coalesce(qty * avg_entry_price, 0)) AS unrealized_pl, sum(realized_pl) AS realized_pl
          FROM pos JOIN last USING (symbol) GROUP BY 1)""")]


def fills(s, sf):
    e = s.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").cast("string").alias("account"), F.concat(F.lit("S"), k % 4).alias("symbol"), F.col("event_id").alias("seq"), F.col("ts"),
        F.when(F.col("event_type").isin("error", "view"), "sell").otherwise("buy").alias("side"),
        F.round("value").alias("qty"), F.lit(0.0).alias("filled_qty"), (k / 4.0 + 10).alias("price"))


def book(s, sf):
    f = fills(s, sf)
    pos, last = L.fills_to_positions(f), L.last_prices(f)
    return pos, last, L.account_valuation(pos, last, 100000.0)


@case("led01_fills_to_positions", "SELECT * FROM pos", nums="qty avg_entry_price realized_pl cash_flow", ctes=FILLS)
def _(s, sf):
    return L.fills_to_positions(fills(s, sf))


@case("led02_account_valuation", "SELECT account, cash, pv AS positions_value, gv AS gross_value, unrealized_pl, realized_pl, nav, exposure, buying_power FROM val",
      nums="cash positions_value gross_value unrealized_pl realized_pl nav exposure buying_power", ctes=FILLS)
def _(s, sf):
    return book(s, sf)[2]


@case("led03_position_concentration", """SELECT account, symbol, CASE WHEN nav > 0 THEN abs(qty * price) / nav ELSE 0 END AS concentration
      FROM pos JOIN last USING (symbol) JOIN val USING (account) WHERE qty <> 0""", nums="concentration", ctes=FILLS)
def _(s, sf):
    pos, last, val = book(s, sf)
    return L.position_concentration(pos, last, val).select("account", "symbol", "concentration")


_TARGETS = ("targets", "SELECT account, symbol, round(sum(qty)) % 400 AS target_qty FROM fills GROUP BY 1, 2 HAVING count(*) >= 3")


def targets(s, sf):
    return fills(s, sf).groupBy("account", "symbol").agg((F.round(F.sum("qty")) % 400).alias("target_qty"), F.count(F.lit(1)).alias("_m")).filter("_m >= 3").drop("_m")


@case("led04_rebalance_deltas", """SELECT account, symbol, CASE WHEN d > 0 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN abs(d) * price > 5000 THEN 5000 / price ELSE abs(d) END AS order_qty
      FROM (SELECT t.*, t.target_qty - p.qty AS d FROM targets t JOIN pos p USING (account, symbol)) JOIN last USING (symbol) WHERE abs(d) >= 1e-10""", nums="order_qty", ctes=[*FILLS, _TARGETS])
def _(s, sf):
    pos, last, _ = book(s, sf)
    return L.rebalance_deltas(targets(s, sf), pos, last, 5000.0)


@case("led05_signal_gate", """SELECT account, symbol, side, target_qty, allowed_qty FROM (
      SELECT *, CASE WHEN side = 'buy' AND nav > 0 AND now + price * target_qty > 0.02 * nav THEN (0.02 * nav - now) / price ELSE target_qty END AS allowed_qty FROM (
        SELECT g.*, abs(p.qty * l.price) AS now, l.price, v.nav FROM sig g JOIN pos p USING (account, symbol) JOIN last l USING (symbol) JOIN val v USING (account)
        WHERE g.target_qty > 0 AND NOT EXISTS (SELECT 1 FROM opn o WHERE o.account = g.account AND o.symbol = g.symbol AND o.side = g.side))) WHERE allowed_qty >= 1""",
      nums="target_qty allowed_qty", ctes=[*FILLS, ("sig", "SELECT account, symbol, max_by(side, seq) AS side, max_by(qty, seq) AS target_qty FROM fills GROUP BY 1, 2"),
                                          ("opn", "SELECT account, symbol, min_by(side, seq) AS side FROM fills GROUP BY 1, 2 HAVING count(*) >= 7")])
def _(s, sf):
    f = fills(s, sf)
    pos, last, val = book(s, sf)
    sig = f.groupBy("account", "symbol").agg(F.max_by("side", "seq").alias("side"), F.max_by("qty", "seq").alias("target_qty"))
    opn = f.groupBy("account", "symbol").agg(F.min_by("side", "seq").alias("side"), F.count(F.lit(1)).alias("n")).filter("n >= 7")
    return L.signal_gate(sig, opn, pos, val, last, 0.02, fractional=False)


_GATE = [*FILLS, ("opn", "SELECT account, symbol, min_by(side, seq) AS side FROM fills GROUP BY 1, 2 HAVING count(*) >= 7"),
         ("sq", """SELECT f.*, p.qty AS held, l.price AS mark, v.nav, o.side AS open_side, row_number() OVER (PARTITION BY f.account, f.symbol ORDER BY f.seq) AS k
            FROM fills f LEFT JOIN pos p USING (account, symbol) LEFT JOIN last l USING (symbol) LEFT JOIN val v USING (account) LEFT JOIN opn o USING (account, symbol)"""),
         ("ask", """SELECT *, CASE WHEN side = 'buy' AND nav > 0 THEN 0.05 * nav END AS most FROM sq"""),
         ("gate(account, symbol, k, seq, side, target_qty, h, a)", """SELECT account, symbol, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), any_value(held), CAST(0 AS DOUBLE) FROM ask GROUP BY 1, 2
            UNION ALL SELECT account, symbol, k, seq, side, qty, h + CASE side WHEN 'buy' THEN a ELSE -a END, a FROM (
              SELECT account, symbol, k, seq, side, qty, h, CASE WHEN side IS NOT DISTINCT FROM open_side OR qty <= 0 OR want < 1 THEN 0 ELSE want END AS a FROM (
                SELECT s.*, g.h, CASE WHEN most IS NOT NULL AND abs(g.h * mark) + mark * qty > most THEN (most - abs(g.h * mark)) / mark ELSE qty END AS want
                FROM gate g JOIN ask s ON s.account = g.account AND s.symbol = g.symbol AND s.k = g.k + 1))""")]


@case("led05_sequential_gate", "SELECT account, symbol, seq, side, target_qty, a AS allowed_qty, h AS position_after FROM gate WHERE a > 0",
      nums="target_qty allowed_qty position_after", ctes=_GATE)
def _(s, sf):
    f = fills(s, sf)
    pos, last, val = book(s, sf)
    sig = f.select("account", "symbol", "seq", "side", F.col("qty").alias("target_qty"))
    opn = f.groupBy("account", "symbol").agg(F.min_by("side", "seq").alias("side"), F.count(F.lit(1)).alias("n")).filter("n >= 7")
    return L.sequential_gate(sig, opn, pos, val, last, max_concentration=0.05, fractional=False)


_UPD = [("upd", """SELECT o_orderkey // 3 AS order_id, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'P' THEN 'partially_filled' ELSE 'pending' END AS status, o_orderdate AS updated_at FROM orders""")]


def updates(s, sf):
    o = s.read.parquet(f"{sf}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_orderstatus") == "P", "partially_filled").otherwise("pending")
    return o.select(F.floor(F.col("o_orderkey") / 3).alias("order_id"), status.alias("status"), F.col("o_orderdate").alias("updated_at"))


@case("led06_latest_order_state", """SELECT order_id, status, updated_at, status NOT IN ('filled', 'canceled', 'rejected', 'expired') AS is_open FROM (
      SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC, status DESC) AS k FROM upd) WHERE k = 1""", ctes=_UPD)
def _(s, sf):
    return L.latest_order_state(updates(s, sf))


@case("led06_order_history", "SELECT o_orderkey AS order_id, o_orderdate AS updated_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def _(s, sf):
    o = s.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("updated_at"))
    return L.order_history(o)


@case("led07_bars_normalize", """SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts, min(l_extendedprice) AS low, max(l_extendedprice) AS high, sum(l_quantity) AS volume, count(*) AS trade_count,
      sum(l_extendedprice) / sum(l_quantity) AS vwap FROM lineitem GROUP BY 1, 2""", nums="low high volume vwap")
def _(s, sf):
    li = s.read.parquet(f"{sf}/lineitem.parquet")
    bars = li.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("ts")).agg(
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.sum("l_quantity").alias("volume"),
        F.count(F.lit(1)).alias("trade_count"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"))
    pages = bars.groupBy(F.trunc("ts", "month").alias("page"), "symbol").agg(F.collect_list(F.struct("ts", "low", "high", "volume", "trade_count", "vwap")).alias("b"))
    return L.bars_normalize(pages.select(F.create_map("symbol", "b").alias("data")))


@case("led08_status_mapping", """SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'P' THEN 'pending' ELSE 'rejected' END AS status,
      CASE WHEN o_orderpriority LIKE '1%' THEN 'limit' ELSE 'market' END AS kind FROM orders""")
def _(s, sf):
    o = s.read.parquet(f"{sf}/orders.parquet")
    raw = F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "P", "pending_new").otherwise("Suspended")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "LIMIT").otherwise("bracket")
    return L.status_mapping(o.select(F.col("o_orderkey").alias("order_id"), raw.alias("status"), kind.alias("kind")), kind="kind")
