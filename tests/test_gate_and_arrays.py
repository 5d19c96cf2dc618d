"""Order-dependent admission of signals, and fold callables on arrays."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators.ledger import sequential_gate
from barloom.operators.splits import cv_arrays

SIGNAL = "account string, symbol string, seq long, side string, target_qty double"


def loop(signals, open_orders, held, nav, price, limit, fractional, pending):
    out, state, blocked = [], dict(held), {(a, s, side) for a, s, side in open_orders}
    for account, symbol, seq, side, qty in sorted(signals, key=lambda r: r[2]):
        if qty <= 0 or (account, symbol, side) in blocked:
            continue
        position = state.get((account, symbol))
        known = position is not None and price.get(symbol, 0) > 0
        mark, now = (price[symbol], abs(position * price[symbol])) if known else (1.0, 0.0)
        if side == "buy" and limit < 1 and nav.get(account, 0) > 0 and now + mark * qty > limit * nav[account]:
            qty = (limit * nav[account] - now) / mark
        if qty <= 0 or (not fractional and qty < 1):
            continue
        if pending:
            blocked.add((account, symbol, side))
        else:
            state[account, symbol] = (position or 0.0) + (qty if side == "buy" else -qty)
        out.append((account, symbol, seq, round(qty, 9), None if state.get((account, symbol)) is None else round(state[account, symbol], 6)))
    return sorted(out)


@pytest.mark.parametrize("fractional", [True, False])
@pytest.mark.parametrize("fills", ["immediate", "pending"])
def test_equal_to_a_loop(spark, fractional, fills):
    rng = np.random.default_rng(3)
    signals = [(f"a{rng.integers(4)}", f"s{rng.integers(3)}", i, ("buy", "sell")[int(rng.random() < 0.4)], float(rng.integers(-1, 12)) + 0.25) for i in range(1500)]
    opens = [("a0", "s0", "sell"), ("a1", "s1", "buy")]
    held = {(f"a{a}", f"s{s}"): float(rng.integers(-5, 9)) for a in range(4) for s in range(2)}
    nav, price = {"a0": 1000.0, "a1": 500.0, "a2": -5.0}, {"s0": 10.0, "s1": 3.5}
    got = sequential_gate(
        spark.createDataFrame(signals, SIGNAL).repartition(5), spark.createDataFrame(opens, "account string, symbol string, side string"),
        spark.createDataFrame([(*k, v) for k, v in held.items()], "account string, symbol string, qty double"),
        spark.createDataFrame(list(nav.items()), "account string, nav double"), spark.createDataFrame(list(price.items()), "symbol string, price double"),
        max_concentration=0.1, fractional=fractional, fills=fills)
    rows = sorted((r.account, r.symbol, r.seq, round(r.allowed_qty, 9), None if r.position_after is None else round(r.position_after, 6)) for r in got.collect())
    assert rows == loop(signals, opens, held, nav, price, 0.1, fractional, fills == "pending") and rows


def test_long_account(spark):
    n = 300_000
    signals = spark.range(n).selectExpr("'a' as account", "'s' as symbol", "id as seq", "if(id % 3 = 2, 'sell', 'buy') as side", "double(1 + id % 7) as target_qty")
    none = spark.createDataFrame([], "account string, symbol string, side string")
    got = sequential_gate(signals, none, spark.createDataFrame([("a", "s", 1.0)], "account string, symbol string, qty double"),
                          spark.createDataFrame([("a", 400.0)], "account string, nav double"), spark.createDataFrame([("s", 2.0)], "symbol string, price double")).toPandas()
    want = loop([("a", "s", i, "sell" if i % 3 == 2 else "buy", 1.0 + i % 7) for i in range(n)], [], {("a", "s"): 1.0}, {"a": 400.0}, {"s": 2.0}, 0.1, True, False)
    assert len(got) == len(want) and np.allclose(got.sort_values("seq").allowed_qty, [w[3] for w in want])


def test_arrays_flat_and_panel(spark):
    rng = np.random.default_rng(5)
    d = pd.DataFrame({"fold": np.repeat([0, 1, 2], 600), "date": np.tile(np.repeat(np.arange(60), 10), 3), "symbol": np.tile(np.arange(10), 180)})
    d["x"], d["z"] = rng.normal(size=(2, len(d)))
    d["y"] = d.x - 2 * d.z + 0.1 * rng.normal(size=len(d))
    d["role"] = np.where(d.date < 40, "train", "test")
    d = d[(d.fold < 2) | (d.role == "train")].drop(index=7)
    df = spark.createDataFrame(d).repartition(4)
    fit = lambda x, y: np.linalg.lstsq(x.reshape(-1, 2)[~np.isnan(y.ravel())], y.ravel()[~np.isnan(y.ravel())], rcond=None)[0]
    error = lambda y, p: float(np.nanmean((y - p) ** 2))
    flat, one = cv_arrays(df, ["x", "z"], "y", fit, lambda m, x: x @ m, error)
    cube, two = cv_arrays(df, ["x", "z"], "y", fit, lambda m, x: x @ m, error, panel=("date", "symbol"))
    first, second = ({r.fold: r.metric for r in t.collect()} for t in (one, two))
    assert first.keys() == {0, 1} and all(abs(first[f] - second[f]) < 1e-12 and first[f] < 0.02 for f in first)
    a, b = (sorted((r.fold, r.date, r.symbol, round(r.pred, 9)) for r in t.collect()) for t in (flat, cube))
    assert a == b and len(a) == 400
    with pytest.raises(ValueError):
        cv_arrays(df, ["x", "z"], "y", fit, lambda m, x: x @ m, most_rows=100)


def test_flat_arrays_have_no_longest_fold(spark, monkeypatch):
    """Two million training rows and more in a fold are fitted; test rows in parts get the fold's one model; nulls stay nulls."""
    from barloom.operators import splits

    long = spark.range(2_100_500).selectExpr("id % 1 as fold", "if(id < 2100000, 'train', 'test') as role", "id", "double(id % 7) as x",
                                             "if(id = 5, null, 2.0D * (id % 7) + 1) as y")
    fit = lambda x, y: (len(y), float((x[:, 0] * y).sum() / (x[:, 0] ** 2).sum()))
    _, metric = cv_arrays(long, ["x"], "y", fit, lambda m, x: np.full(len(x), m[0]), lambda y, p: float(len(y) + p[0]))
    assert [(r.fold, r.metric) for r in metric.collect()] == [(0, 2_099_999 + 500)]
    monkeypatch.setattr(splits, "PART_ROWS", 60)
    small = long.filter("id < 300 or id >= 2100300")
    scored, metric = cv_arrays(small, ["x"], "y", fit, lambda m, x: m[1] * x[:, 0], lambda y, p: float(len(y)))
    got = scored.toPandas()
    assert len(got) == 200 and got.id.is_unique and (got.pred / got.x)[got.x > 0].round(9).nunique() == 1 and metric.first().metric == 200
