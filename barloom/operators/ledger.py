"""Orders, fills and positions as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import lit
from barloom.functions.grouping import along_time, attach, longest_group, running

BOOK = ("account", "symbol")
FLAT = 1e-10  # fixed value: a position below this size after a sale is closed
BLOCK = 4096


def valid_fills(fills: DataFrame) -> DataFrame:
    """filled_qty falls back to qty; non-positive quantities or prices are skipped."""
    qty = F.when(F.col("filled_qty") > 0, F.col("filled_qty")).otherwise(F.col("qty"))
    return fills.withColumn("_q", qty).filter((F.col("_q") > 0) & (F.col("price") > 0))


def fills_to_positions(fills: DataFrame, order: str = "seq", *, by: Sequence[str] = BOOK) -> DataFrame:
    """Final quantity, average entry, realised P&L and cash flow per (account, symbol).

    Input: side (buy / sell), qty, filled_qty, price and a unique order column.  Quantities
    are running sums.  Given them, a fill changes the average entry by an affine map
    avg -> a * avg + b, and the P&L of a sale is affine in the average before it; maps are
    composed inside blocks of 4096 fills first and then over the blocks of a book.
    """
    size = longest_group(fills, by)
    signed = F.when(F.col("side") == "buy", F.col("_q")).otherwise(-F.col("_q"))
    rows = running(valid_fills(fills), {"_run": ("sum", signed)}, by=by, time=order, longest=size)
    buy = F.col("side") == "buy"
    rows = rows.withColumn("_after", F.when(F.abs("_run") < FLAT, lit(0)).otherwise(F.col("_run")))
    rows = along_time(rows, {
        "_before": lambda t: F.coalesce(F.lag("_after").over(t.w), lit(0)),
        # no position: at the start, or after a sale that left nothing
        "_none": lambda t: F.coalesce(F.lag(~buy & (F.abs(F.col("_run")) < FLAT)).over(t.w), F.lit(True)),
        "_pos": lambda t: t.pos}, by=by, time=order, back=1, longest=size)
    price, before, after = F.col("price"), F.col("_before"), F.col("_after")
    mix = buy & ~F.col("_none") & (after != 0)
    a = F.when(F.col("_none"), lit(0)).when(mix, before / F.nullif(after, lit(0))).otherwise(lit(1))
    b = F.when(F.col("_none"), price).when(mix, F.col("_q") * price / F.nullif(after, lit(0))).otherwise(lit(0))
    closed = F.when(~buy & ~F.col("_none") & (before > 0), F.least(F.col("_q"), before)).otherwise(lit(0))
    steps = rows.select(
        *by, F.floor(F.col("_pos") / BLOCK).alias("_block"),
        F.struct("_pos", a.alias("a"), b.alias("b"), closed.alias("m"), price.alias("p")).alias("s"),
        after.alias("_after"), F.col("_pos"), (-signed * price).alias("_cash"))

    def sale(acc: Column, x: Column) -> Column:
        """One fill after the composed fills: P&L is r0 - r1 * (average before the first)."""
        return F.struct(
            (x["a"] * acc["a"]).alias("a"), (x["a"] * acc["b"] + x["b"]).alias("b"),
            (acc["r0"] + x["m"] * (x["p"] - acc["b"])).alias("r0"), (acc["r1"] + x["m"] * acc["a"]).alias("r1"))

    def compose(acc: Column, x: Column) -> Column:
        f = x["f"]
        return F.struct(
            (f["a"] * acc["a"]).alias("a"), (f["a"] * acc["b"] + f["b"]).alias("b"),
            (acc["r0"] + f["r0"] - f["r1"] * acc["b"]).alias("r0"), (acc["r1"] + f["r1"] * acc["a"]).alias("r1"))

    start = F.struct(lit(1).alias("a"), lit(0).alias("b"), lit(0).alias("r0"), lit(0).alias("r1"))
    level = steps.groupBy(*by, "_block").agg(
        F.aggregate(F.sort_array(F.collect_list("s")), start, sale).alias("f"),
        F.max_by("_after", "_pos").alias("_after"), F.sum("_cash").alias("_cash"), F.count(F.lit(1)).alias("_n"))
    for group in (F.floor(F.col("_block") / BLOCK), F.lit(0)):  # BLOCK blocks at a time, then the rest
        level = level.groupBy(*by, group.alias("_next")).agg(
            F.aggregate(F.sort_array(F.collect_list(F.struct("_block", "f"))), start, compose).alias("f"),
            F.max_by("_after", "_block").alias("_after"), F.sum("_cash").alias("_cash"), F.sum("_n").alias("_n"),
        ).withColumnRenamed("_next", "_block")
    return level.select(
        *by, F.col("_after").alias("qty"), F.when(F.col("_after") != 0, F.col("f.b")).alias("avg_entry_price"),
        F.col("f.r0").alias("realized_pl"), F.col("_cash").alias("cash_flow"), F.col("_n").alias("n_fills"))


def account_valuation(positions: DataFrame, prices: DataFrame, initial_cash: float = 0.0, *, account: str = "account") -> DataFrame:
    """NAV, gross exposure, unrealised and realised P&L and buying power per account."""
    open_ = attach(positions, prices.select("symbol", F.col("price").alias("current_price")), ["symbol"])
    mv = F.coalesce(F.col("qty") * F.col("current_price"), lit(0))
    cost = F.coalesce(F.col("qty") * F.col("avg_entry_price"), lit(0))
    sums = open_.groupBy(account).agg(
        (F.sum("cash_flow") + lit(initial_cash)).alias("cash"), F.sum(mv).alias("positions_value"), F.sum(F.abs(mv)).alias("gross_value"),
        F.sum(mv - cost).alias("unrealized_pl"), F.sum("realized_pl").alias("realized_pl"))
    nav = F.col("cash") + F.col("positions_value")
    return sums.withColumns({
        "nav": nav, "exposure": F.when(nav > 0, F.col("gross_value") / F.nullif(nav, lit(0))).otherwise(lit(0)),
        "buying_power": F.greatest("cash", lit(0))})


def position_concentration(positions: DataFrame, prices: DataFrame, valuation: DataFrame, *, account: str = "account") -> DataFrame:
    """|market value| / NAV per position; 0 when NAV is not positive."""
    open_ = attach(positions.filter("qty <> 0"), prices.select("symbol", F.col("price").alias("_p")), ["symbol"])
    both = attach(open_, valuation.select(account, F.col("nav").alias("_nav")), [account])
    share = F.when(F.col("_nav") > 0, F.abs(F.col("qty") * F.col("_p")) / F.nullif(F.col("_nav"), lit(0))).otherwise(lit(0))
    return both.withColumn("concentration", share).drop("_p", "_nav")


def rebalance_deltas(targets: DataFrame, positions: DataFrame, prices: DataFrame | None = None, max_notional: float | None = None, *, by: Sequence[str] = BOOK) -> DataFrame:
    """Orders that move positions to their targets; names without a target are left alone."""
    held = positions.select(*by, F.col("qty").alias("_held"))
    both = attach(targets, held, by).withColumn("_d", F.col("target_qty") - F.coalesce("_held", lit(0)))
    moves = both.filter(F.abs("_d") >= FLAT)
    qty = F.abs("_d")
    if max_notional is not None:
        moves = attach(moves, prices.select("symbol", F.col("price").alias("_p")), ["symbol"])
        known = F.col("_held").isNotNull() & (F.col("_p") > 0)
        qty = F.when(known & (qty * F.col("_p") > max_notional), lit(max_notional) / F.nullif(F.col("_p"), lit(0))).otherwise(qty)
    return moves.select(*by, F.when(F.col("_d") > 0, "buy").otherwise("sell").alias("side"), qty.alias("order_qty"))


def signal_gate(
    signals: DataFrame, open_orders: DataFrame, positions: DataFrame, valuation: DataFrame, prices: DataFrame,
    max_concentration: float = 0.1, fractional: bool = True, *, by: Sequence[str] = BOOK,
) -> DataFrame:
    """Accepted signals with their allowed quantity.  Rows are judged independently.

    Rejected: non-positive quantities, an open order of the same side, buys beyond the
    concentration limit with no room, and parts of a share when these are not supported.
    """
    account = by[0]
    fresh = signals.filter(F.col("target_qty") > 0).join(open_orders.select(*by, "side").distinct(), [*by, "side"], "left_anti")
    held = attach(fresh, positions.select(*by, F.col("qty").alias("_held")), by)
    priced = attach(held, prices.select("symbol", F.col("price").alias("_mark")), ["symbol"])
    rows = attach(priced, valuation.select(account, F.col("nav").alias("_nav")), [account])
    known = F.col("_held").isNotNull() & (F.col("_mark") > 0)
    price = F.when(known, F.col("_mark")).otherwise(lit(1))
    now = F.when(known, F.abs(F.col("_held") * F.col("_mark"))).otherwise(lit(0))
    over = (F.col("side") == "buy") & (F.col("_nav") > 0) & (now + price * F.col("target_qty") > lit(max_concentration) * F.col("_nav"))
    if max_concentration >= 1:
        over = F.lit(False)
    room = (lit(max_concentration) * F.col("_nav") - now) / price
    out = rows.withColumn("allowed_qty", F.when(over, room).otherwise(F.col("target_qty"))).filter(F.col("allowed_qty") > 0)
    if not fractional:
        out = out.filter(F.col("allowed_qty") >= 1)
    return out.drop("_held", "_mark", "_nav")


def sequential_gate(
    signals: DataFrame, open_orders: DataFrame, positions: DataFrame, valuation: DataFrame, prices: DataFrame, order: Sequence[str] = ("seq",),
    max_concentration: float = 0.1, fractional: bool = True, fills: str = "immediate", *, by: Sequence[str] = BOOK,
) -> DataFrame:
    """Accepted signals in their order, each judged after what the earlier ones did: ``allowed_qty`` and ``position_after``.

    ``fills="immediate"``: an accepted signal fills at the mark, so it moves the position that limits the next one; net asset value stays
    as it is. ``fills="pending"``: an accepted signal becomes an open order, and later signals of its side are duplicates. Signals of a
    side with an open order are rejected in both. Unknown positions count as none, at price 1, as in ``signal_gate``.

    A book's signals stream by in order, with one position and two flags held: memory is bounded for any number of signals, and a net
    asset value that fills at the mark don't move makes the symbols of an account independent.
    """
    if fills not in ("immediate", "pending"):
        raise ValueError(f"unknown fills {fills!r}")
    account, names = by[0], list(signals.columns)
    sides = open_orders.groupBy(*by).agg(F.collect_set("side").alias("_open"))
    held = attach(attach(signals, sides, by), positions.select(*by, F.col("qty").alias("_held")), by)
    priced = attach(held, prices.select("symbol", F.col("price").alias("_mark")), ["symbol"])
    rows = attach(priced, valuation.select(account, F.col("nav").alias("_nav")), [account])
    key = F.to_json(F.struct(*by)).alias("_key")
    rows = rows.select(*names, F.coalesce("_open", F.array().cast("array<string>")).alias("_open"), F.col("_held").cast("double"), F.col("_mark").cast("double"),
                       F.col("_nav").cast("double"), key, F.col("side").alias("_side"), F.col("target_qty").cast("double").alias("_qty"))

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, position, blocked = None, None, set()
        for batch in batches:
            keep, allowed, after = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("_key", "_side", "_qty", "_open", "_held", "_mark", "_nav")]
            for i, (key, side, qty, open_, start, mark, nav) in enumerate(zip(*columns, strict=True)):
                if key != last:
                    last, position, blocked = key, start, set(open_)
                if qty is None or qty <= 0 or side in blocked:
                    continue
                known = position is not None and mark is not None and mark > 0
                price, now = (mark, abs(position * mark)) if known else (1.0, 0.0)
                if side == "buy" and max_concentration < 1 and nav is not None and nav > 0 and now + price * qty > max_concentration * nav:
                    qty = (max_concentration * nav - now) / price
                if qty <= 0 or (not fractional and qty < 1):
                    continue
                if fills == "pending":
                    blocked.add(side)
                else:
                    position = (position or 0.0) + (qty if side == "buy" else -qty)
                keep.append(i)
                allowed.append(qty)
                after.append(position)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:len(names)], pa.array(allowed, pa.float64()), pa.array(after, pa.float64())],
                                             [*names, "allowed_qty", "position_after"])

    schema = T.StructType([*signals.schema.fields, T.StructField("allowed_qty", T.DoubleType()), T.StructField("position_after", T.DoubleType())])
    return rows.repartition("_key").sortWithinPartitions("_key", *order).mapInArrow(admit, schema)


# Final states of an order.
TERMINAL = ("filled", "canceled", "rejected", "expired")


def latest_order_state(updates: DataFrame, key: str = "order_id", at: str = "updated_at") -> DataFrame:
    """Latest record per order and whether it is still open."""
    last = updates.groupBy(key).agg(F.max_by(F.struct(*updates.columns), F.struct(at, "status")).alias("_r"))
    return last.select("_r.*").withColumn("is_open", ~F.col("status").isin(*TERMINAL))


def order_history(updates: DataFrame, limit: int = 100, at: str = "updated_at", key: str = "order_id") -> DataFrame:
    """The most recent records."""
    return updates.orderBy(F.desc(at), F.desc(key)).limit(limit)


def bars_normalize(responses: DataFrame, col: str = "data") -> DataFrame:
    """Responses holding a map of symbol -> bars -> one row per bar."""
    per = responses.select(F.explode(col).alias("symbol", "_bars"))
    return per.select("symbol", F.explode("_bars").alias("_b")).select("symbol", "_b.*")


# Provider order states, sides and types and their canonical names.
STATUS_NAMES = {
    "new": "pending", "accepted": "accepted", "pending_new": "pending", "pending_cancel": "pending",
    "pending_replace": "pending", "partially_filled": "partially_filled", "filled": "filled", "canceled": "canceled",
    "rejected": "rejected", "expired": "expired", "suspended": "rejected"}
ORDER_TYPES = ("market", "limit", "stop", "stop_limit")
SIDES = ("buy", "sell")


def status_mapping(df: DataFrame, status: str = "status", kind: str | None = None, side: str | None = None) -> DataFrame:
    """Canonical states (unknown: pending), order types (unknown: market) and checked sides."""
    names = F.create_map(*[F.lit(v) for pair in STATUS_NAMES.items() for v in pair])
    new = {status: F.coalesce(F.try_element_at(names, F.lower(status)), F.lit("pending"))}
    if kind:
        new[kind] = F.when(F.lower(kind).isin(*ORDER_TYPES), F.lower(kind)).otherwise("market")
    if side:
        new[side] = F.when(F.lower(side).isin(*SIDES), F.lower(side))
    return df.withColumns(new)


def last_prices(fills: DataFrame, order: str = "seq") -> DataFrame:
    """Latest traded price per symbol."""
    return fills.filter(F.col("price") > 0).groupBy("symbol").agg(F.max_by("price", order).alias("price"))

