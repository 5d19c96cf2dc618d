"""Event labels and sample weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import lit
from barloom.functions.grouping import Stage, along_time, attach, group_stats, longest_group, positions, running

KEY, TIME = ("symbol",), "date"


def triple_barrier_events(
    df: DataFrame, price: str = "close", vol: str = "vol", pt_factor: float = 2.0, sl_factor: float = 1.0,
    max_hold: int = 20, min_return: float = 0.0, side: str | None = None, *, by=KEY, time=TIME,
) -> DataFrame:
    """First touch of the upper, lower or vertical barrier for every row with a volatility.

    Returns t0, t1, label, ret, type and the row positions t0_pos, t1_pos.  With ``side``
    only the barrier in its direction counts and the label is 1 (hit) or 0.
    """
    size = longest_group(df, by)
    placed = positions(df, by, time, "t0_pos", longest=size)
    path: Stage = {"_path": lambda t: F.collect_list(F.struct(F.col(time).alias("at"), F.col(price).alias("p"))).over(t.between(1, max_hold))}
    ahead = along_time(placed, path, by=by, time=time, ahead=max_hold, longest=size)
    usable = (F.col(vol) > 0) & (F.col(price) > 0) & (F.size("_path") > 0)
    ret = lambda p: p / F.col(price) - 1
    first = lambda test: F.nullif(F.array_position(F.transform("_path", lambda x: F.coalesce(test(ret(x["p"])), F.lit(False))), True), F.lit(0))
    up = first(lambda r: r >= lit(pt_factor) * F.col(vol))
    down = first(lambda r: r <= lit(-sl_factor) * F.col(vol))
    if side:
        usable = usable & F.col(side).isNotNull() & (F.col(side) != 0)
        up, down = F.when(F.col(side) > 0, up), F.when(F.col(side) < 0, down)
    touched = ahead.filter(usable).withColumns({"_up": up, "_dn": down})
    hit = F.least("_up", "_dn")  # NULL sides are skipped
    kind = (
        F.when(hit.isNull() | F.col("_up").eqNullSafe(F.col("_dn")), "vertical")
        .when(F.col("_dn").isNull() | (F.col("_up") < F.col("_dn")), "upper").otherwise("lower")
    )
    end = F.element_at("_path", F.coalesce(hit, F.size("_path")).cast("int"))
    label = (F.when(F.col("type") == "vertical", 0).otherwise(1) if side else
             F.when(F.col("type") == "upper", 1).when(F.col("type") == "lower", -1).otherwise(0))
    events = touched.withColumns({"type": kind, "_end": end}).withColumns({
        "label": label.cast("tinyint"), "ret": ret(F.col("_end.p"))})
    events = events.filter((F.col("type") != "vertical") | (F.abs("ret") >= lit(min_return)))
    steps = F.coalesce(hit, F.size("_path"))
    return events.select(
        *by, F.col(time).alias("t0"), F.col("_end.at").alias("t1"), "label", "ret", "type",
        "t0_pos", (F.col("t0_pos") + steps).cast("int").alias("t1_pos"))


def meta_labels(df: DataFrame, side: str, **params) -> DataFrame:
    """Triple-barrier events for a given side: 1 if the favourable barrier was hit."""
    return triple_barrier_events(df, side=side, **params)


def bins_to_bars(bars: DataFrame, events: DataFrame, *, by=KEY, time=TIME, out: str = "bin") -> DataFrame:
    """Event labels on the bars they start at; NULL elsewhere."""
    starts = events.select(*by, F.col("t0").alias(time), F.col("label").cast("double").alias(out))
    return attach(bars, starts, [*by, time])


def _edges(events: DataFrame, by: Sequence[str], t0: str, t1: str) -> DataFrame:
    """Net change of the number of active labels at each position where it changes."""
    return (
        events.select(*by, F.explode(F.array(
            F.struct(F.col(t0).cast("long").alias("at"), F.lit(1).alias("d")),
            F.struct((F.col(t1) + 1).cast("long").alias("at"), F.lit(-1).alias("d")))).alias("e"))
        .groupBy(*by, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    )


def concurrency(bars: DataFrame, events: DataFrame, pos: str = "pos", *, by=KEY, t0="t0_pos", t1="t1_pos") -> DataFrame:
    """Number of labels active at each bar, by a running sum over starts and ends."""
    edges = _edges(events, by, t0, t1).withColumnRenamed("at", pos)
    joined = attach(bars, edges, [*by, pos]).withColumn("_d", F.coalesce("d", F.lit(0)))
    return running(joined, {"active": ("sum", F.col("_d"))}, by=by, time=pos).drop("d", "_d")


def avg_uniqueness(events: DataFrame, *, by=KEY, t0: str = "t0_pos", t1: str = "t1_pos", out: str = "uniqueness",
                   longest: int | None = None) -> DataFrame:
    """Mean of 1 / concurrency over [t0, t1]; 0 when t1 < t0.

    Concurrency is constant between edges, so a prefix sum over edges, read at t0 and at
    t1 + 1, replaces any join of intervals.  ``longest`` bounds the events of a key when known.
    """
    size = 2 * (longest_group(events, by) if longest is None else longest)  # two edges per event
    act = running(_edges(events, by, t0, t1), {"_a": ("sum", F.col("d"))}, by=by, time="at", longest=size)
    wide = along_time(act, {"_w": lambda t: F.lead("at").over(t.w) - F.col("at")}, by=by, time="at", ahead=1, longest=size)
    mass = F.coalesce(F.col("_w") / F.greatest("_a", F.lit(1)), lit(0))
    cum = running(wide, {"_u": ("sum", mass)}, by=by, time="at", exclusive=True, longest=size)
    cum = cum.select(*by, "at", F.coalesce("_u", lit(0)).alias("_u"))
    lo = cum.withColumnsRenamed({"at": "_k0", "_u": "_u0"})
    hi = cum.withColumnsRenamed({"at": "_k1", "_u": "_u1"})
    keyed = events.withColumns({"_k0": F.col(t0).cast("long"), "_k1": (F.col(t1) + 1).cast("long")})
    both = attach(attach(keyed, lo, [*by, "_k0"]), hi, [*by, "_k1"])
    value = F.when(F.col(t1) < F.col(t0), lit(0)).otherwise(
        (F.col("_u1") - F.col("_u0")) / F.nullif(F.col("_k1") - F.col("_k0"), F.lit(0)))
    return both.withColumn(out, value).drop("_k0", "_k1", "_u0", "_u1")


def sample_weights(
    events: DataFrame, decay: float = 0.0, ret: str = "ret", *, by=KEY, t0: str = "t0_pos", t1: str = "t1_pos",
    out: str = "weight", longest: int | None = None,
) -> DataFrame:
    """uniqueness * |return| * exp(-decay * (T - t0)) with T the key's last t1."""
    uniq = avg_uniqueness(events, by=by, t0=t0, t1=t1, out="_u", longest=longest)
    last = group_stats(uniq, by, _T=F.max(t1)) if decay > 0 else uniq.withColumn("_T", F.lit(0))
    fade: Column = F.exp(lit(-decay) * F.greatest(F.col("_T") - F.col(t0), F.lit(0))) if decay > 0 else lit(1)
    return last.withColumn(out, F.col("_u") * F.abs(ret) * fade).drop("_u", "_T")
