"""Structured Streaming forms of the fill and order operators.

State is one small record per key.  Fills later than the watermark are not applied; route
them with ``late_fills`` to a side table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.ledger import FLAT, TERMINAL, valid_fills

POSITION = "account string, symbol string, qty double, avg_entry_price double, realized_pl double, cash_flow double, n_fills bigint"
BOOK_STATE = "qty double, avg double, held boolean, pl double, cash double, n bigint, held_fills string"


def apply_fill(state: tuple, side: str, qty: float, price: float) -> tuple:
    """Next (qty, avg, held, pl, cash, n) after one fill."""
    q, avg, held, pl, cash, n = state
    if side == "buy":
        cash -= qty * price
        if held:
            cost = q * avg + qty * price
            q += qty
            avg = cost / q if q != 0 else avg
        else:
            q, avg, held = qty, price, True
    else:
        cash += qty * price
        if not held:
            q, avg, held = -qty, price, True
        else:
            if q > 0:
                pl += min(qty, q) * (price - avg)
            q -= qty
            if abs(q) < FLAT:
                q, held = 0.0, False
    return q, avg, held, pl, cash, n + 1


def stream_positions(fills: DataFrame, watermark: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Running positions per (account, symbol); emits the book after each batch of its fills.

    Fills count in (ts, seq) order, in whatever order they arrive within the watermark: those it has not passed yet are held beside
    the settled book and applied anew with every batch.  A fill that is held already is a replay.  Fills older than the watermark are
    not applied.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *settled, held = state.get if state.exists else (0.0, 0.0, False, 0.0, 0.0, 0, "[]")
        passed = state.getCurrentWatermarkMs() * 1000
        waiting = {(at, seq): rest for at, seq, *rest in json.loads(held)}
        for pdf in () if state.hasTimedOut else batches:
            for r in pdf.itertuples(index=False):
                if r.at >= passed:
                    waiting.setdefault((int(r.at), int(r.seq)), [r.side, float(r.q), float(r.price)])
        book = settled = tuple(settled)
        kept = []
        for (at, seq), fill in sorted(waiting.items()):
            book = apply_fill(book, *fill)
            if at < passed:
                settled = book
            else:
                kept.append([at, seq, *fill])
        state.update((*settled, json.dumps(kept)))
        if kept:
            state.setTimeoutTimestamp(max(passed, kept[-1][0]) // 1000 + 1)
        if not state.hasTimedOut:
            q, avg, live, pl, cash, n = book
            yield pd.DataFrame([(*key, q, avg if live and q != 0 else None, pl, cash, n)],
                               columns=["account", "symbol", "qty", "avg_entry_price", "realized_pl", "cash_flow", "n_fills"])

    rows = valid_fills(fills).withWatermark(ts, watermark).select(
        "account", "symbol", ts, F.unix_micros(ts).alias("at"), "seq", "side", F.col("_q").alias("q"), "price")
    return rows.groupBy("account", "symbol").applyInPandasWithState(
        update, POSITION, BOOK_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def late_fills(fills: DataFrame, horizon: str = "10 minutes", ts: str = "ts", arrived: str = "arrived_at") -> DataFrame:
    """Fills that arrived more than the horizon after their time (a stateless side output)."""
    return fills.filter(F.col(arrived) > F.col(ts) + F.expr(f"INTERVAL {horizon}"))


ORDER = "order_id bigint, status string, updated_at timestamp, is_open boolean"


def stream_order_states(updates: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Latest state per order id, emitted whenever it changes; finished orders are forgotten once the watermark has passed them."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["updated_at", "status"])
        at, status, ms = rows["updated_at"].iloc[-1], rows["status"].iloc[-1], int(rows["ms"].max())
        if seen[1] is None or (pd.Timestamp(seen[1]), seen[0]) < (pd.Timestamp(at), status):
            seen = (status, pd.Timestamp(at).to_pydatetime())
            yield pd.DataFrame([(key[0], status, at, status not in TERMINAL)], columns=["order_id", "status", "updated_at", "is_open"])
        state.update(seen)
        if seen[0] in TERMINAL:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), ms) + 1)

    rows = updates.select("order_id", "status", F.col("updated_at").cast("timestamp").alias("updated_at")).withWatermark("updated_at", watermark)
    return rows.withColumn("ms", F.unix_millis("updated_at")).groupBy("order_id").applyInPandasWithState(
        update, ORDER, "status string, updated_at timestamp", "update", GroupStateTimeout.EventTimeTimeout)
