"""Per-symbol features over trailing row frames, and recursions with geometric memory."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.columns import lit, ratio
from barloom.functions.grouping import Line, Stage, along_time, attach, group_stats, positions, running
from barloom.operators.cross import market_return
from barloom.operators.returns import change_of, log_return_of, simple_return_of

KEY, TIME = ("symbol",), "date"
EPS = 1e-8


# ---- expressions -------------------------------------------------------------

def mean_of(col: str, t: Line, period: int) -> Column:
    return F.avg(col).over(t.last(period))


def band_position(price: str, t: Line, period: int) -> Column:
    std = F.stddev_pop(price).over(t.last(period))
    return F.when(2 * std > 1e-12, (F.col(price) - mean_of(price, t, period)) / (std + lit(EPS)))


def _moments(cols: Sequence[str], w: WindowSpec) -> Column:
    """Counts, means and sums of squares and products of the one or two columns over a frame."""
    def mean(c: str) -> Column:  # exact where all values agree
        return F.when(F.min(c).over(w) == F.max(c).over(w), F.min(c).over(w)).otherwise(F.avg(c).over(w))

    n = F.count(cols[0]).over(w)
    fields = {"n": n, **{f"m{i}": mean(c) for i, c in enumerate(cols)}, **{f"s{i}{i}": F.var_pop(c).over(w) * n for i, c in enumerate(cols)}}
    if len(cols) == 2:
        fields["s01"] = F.covar_pop(*cols).over(w) * n
    return F.struct(*[F.coalesce(v.cast("double"), lit(0)).alias(k) for k, v in fields.items()])


def trailing_moments(cols: Sequence[str], width: int, out: str) -> list[Stage]:
    """Stages that add ``out``, the moments (n, m0, s00; with two columns also m1, s11, s01) of the last ``width`` rows.

    A sliding frame adds up all its rows for every row. Here the rows are cut into cells of ``width`` positions, and the moments of a
    frame are those of the end of one cell and the start of the next, both of which grow by one row at a time. Two columns are null
    in the same rows. Needs ``width - 1`` rows of ``back``; the columns ``out_at``, ``out_head`` and ``out_tail`` may be dropped.
    """
    at, head, tail, both = f"{out}_at", f"{out}_head", f"{out}_tail", len(cols) == 2

    def cell(t: Line, order: Column) -> WindowSpec:
        return Window.partitionBy(*t.by, F.floor(F.col(at) / width)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    def joined(t: Line) -> Column:
        b = F.col(head)
        a = F.lag(tail, width - 1).over(Window.partitionBy(*t.by).orderBy(at))
        n = a["n"] + b["n"]
        share = a["n"] * b["n"] / F.greatest(n, lit(1))
        # A part without values has no mean.
        mean = lambda i: F.when(a["n"] == 0, b[f"m{i}"]).when(b["n"] == 0, a[f"m{i}"]).otherwise(a[f"m{i}"] + (b[f"m{i}"] - a[f"m{i}"]) * b["n"] / n)
        square = lambda i, j: (a[f"s{i}{j}"] + b[f"s{i}{j}"]
                               + F.when(share > 0, (b[f"m{i}"] - a[f"m{i}"]) * (b[f"m{j}"] - a[f"m{j}"]) * share).otherwise(lit(0)))
        fields = {"n": n, "m0": mean(0)} | ({"m1": mean(1)} if both else {}) | {"s00": square(0, 0)} | ({"s11": square(1, 1), "s01": square(0, 1)} if both else {})
        whole = a.isNull() | (F.col(at) % width == width - 1)  # the frame lies in one cell
        return F.when(whole, b).otherwise(F.struct(*[v.alias(k) for k, v in fields.items()]))

    return [{at: lambda t: t.pos.cast("bigint")},
            {head: lambda t: _moments(cols, cell(t, F.col(at).asc())), tail: lambda t: _moments(cols, cell(t, F.col(at).desc()))},
            {out: joined}]


def realized_of(ret: str, t: Line, period: int) -> Column:
    return F.coalesce(F.stddev_samp(ret).over(t.last(period)), lit(0))


# ---- moving averages, bands, ratios -------------------------------------------

def sma(df: DataFrame, col: str = "close", period: int = 20, out: str = "sma", *, by=KEY, time=TIME) -> DataFrame:
    """Trailing mean; the head of a key uses the rows it has."""
    return along_time(df, {out: lambda t: mean_of(col, t, period)}, by=by, time=time, back=period - 1)


def sma_deviation(df: DataFrame, price: str = "close", periods: Sequence[int] = (5, 20), *, by=KEY, time=TIME) -> DataFrame:
    """close / (sma + 1e-8) - 1 per period, and ``bias`` from the longest period."""
    stage: Stage = {
        f"sma_{p}": (lambda t, p=p: F.col(price) / (mean_of(price, t, p) + lit(EPS)) - 1) for p in periods}
    p = max(periods)
    stage["bias"] = lambda t: (F.col(price) - mean_of(price, t, p)) / (mean_of(price, t, p) + lit(EPS))
    return along_time(df, stage, by=by, time=time, back=p - 1)


def bollinger_bands(
    df: DataFrame, price: str = "close", period: int = 20, width: float = 2.0, *, by=KEY, time=TIME,
) -> DataFrame:
    std = lambda t: F.stddev_pop(price).over(t.last(period)) * lit(width)
    return along_time(df, {
        "bb_mid": lambda t: mean_of(price, t, period),
        "bb_upper": lambda t: mean_of(price, t, period) + std(t),
        "bb_lower": lambda t: mean_of(price, t, period) - std(t),
    }, by=by, time=time, back=period - 1)


def bollinger_position(
    df: DataFrame, price: str = "close", period: int = 20, out: str = "bollinger_position", *, by=KEY, time=TIME,
) -> DataFrame:
    """(close - mid) / (std + 1e-8); NULL where the band has no width."""
    return along_time(df, {out: lambda t: band_position(price, t, period)}, by=by, time=time, back=period - 1)


def volume_ratio(df: DataFrame, volume: str = "volume", period: int = 20, out: str = "volume_ratio", *, by=KEY, time=TIME) -> DataFrame:
    return along_time(
        df, {out: lambda t: F.col(volume) / (mean_of(volume, t, period) + lit(EPS))}, by=by, time=time, back=period - 1)


def realized_vol(df: DataFrame, ret: str = "simple_return", period: int = 21, out: str = "realized_vol", *, by=KEY, time=TIME) -> DataFrame:
    """Trailing sample deviation; 0 on the first row of a key."""
    return along_time(df, {out: lambda t: realized_of(ret, t, period)}, by=by, time=time, back=period - 1)


def rolling_liquidity(df: DataFrame, volume: str = "volume", period: int = 20, out: str = "liquidity", *, by=KEY, time=TIME) -> DataFrame:
    full = lambda t: F.count(volume).over(t.last(period)) == period
    return along_time(df, {out: lambda t: F.when(full(t), mean_of(volume, t, period))}, by=by, time=time, back=period - 1)


# ---- recursions with geometric memory -------------------------------------------

def _geometric(rate: float) -> tuple[int, int]:
    """Block length and look-back for sums weighted by exp(-rate * age): weights stay
    inside double range in a block, and what lies before the look-back is below 1e-17."""
    return max(1, int(600 / rate)), math.ceil(40 / rate)


def _decayed(x: Column, t: Line, rate: float, at: Column | None = None) -> Column:
    """Sum over past rows of x * exp(-rate * age) as one running sum of scaled terms."""
    w = t.w.rowsBetween(Window.unboundedPreceding, 0)
    place = F.col("_p") if at is None else at
    return F.sum(x * F.exp(lit(rate) * (place - F.col("_p0")))).over(w) * F.exp(lit(-rate) * (F.col("_p") - F.col("_p0")))


_PLACE: Stage = {"_p": lambda t: t.pos}
_ORIGIN: Stage = {"_p0": lambda t: F.first("_p").over(t.w.rowsBetween(Window.unboundedPreceding, 0))}


def rsi_stages(price: str, period: int, out: str) -> list[Stage]:
    rate = -math.log(1 - 1 / period)
    change = F.col("_chg")
    at = F.greatest(F.col("_p"), F.lit(period))  # the seed averages the first `period` changes equally

    def value(t: Line) -> Column:
        gain = _decayed(F.greatest(change, lit(0)), t, rate, at) / period
        loss = _decayed(F.greatest(-change, lit(0)), t, rate, at) / period
        return F.when(F.col("_p") < period, lit(0)).otherwise(lit(100) - lit(100) / (gain / (loss + lit(EPS)) + 1))

    return [
        {**_PLACE, "_chg": lambda t: F.coalesce(F.col(price) - F.lag(price).over(t.w), lit(0))},
        _ORIGIN, {out: value},
    ]


RSI_DROP = ("_p", "_p0", "_chg")


def rsi_wilder(df: DataFrame, price: str = "close", period: int = 14, out: str = "rsi", *, by=KEY, time=TIME) -> DataFrame:
    """Wilder's index; the first ``period`` rows are 0."""
    rows, back = _geometric(-math.log(1 - 1 / period))
    return along_time(
        df, *rsi_stages(price, period, out), by=by, time=time, back=max(back, period + 1), rows=rows, drop=RSI_DROP)


def ewm_vol(df: DataFrame, price: str = "close", span: int = 100, floor: float = 1e-8, out: str = "ewm_vol", *, by=KEY, time=TIME) -> DataFrame:
    """Bias-corrected exponentially weighted deviation of simple returns, floored."""
    rate = -math.log(1 - 2 / (span + 1))
    rows, back = _geometric(2 * rate)
    x = F.col("_x")
    one = F.when(x.isNotNull(), lit(1))

    def value(t: Line) -> Column:
        return F.when(F.col("_k") >= 2, F.greatest(F.sqrt(F.greatest(
            (F.col("_s2") / F.col("_s0") - F.pow(F.col("_s1") / F.col("_s0"), lit(2)))
            * F.col("_s0") * F.col("_s0") / (F.col("_s0") * F.col("_s0") - F.col("_q0")), lit(0))), lit(floor)))

    return along_time(
        df,
        {**_PLACE, "_x": lambda t: change_of(price, t, 1)},
        _ORIGIN,
        {
            "_k": lambda t: F.count("_x").over(t.w.rowsBetween(Window.unboundedPreceding, 0)),
            "_s0": lambda t: _decayed(one, t, rate), "_q0": lambda t: _decayed(one, t, 2 * rate),
            "_s1": lambda t: _decayed(x, t, rate), "_s2": lambda t: _decayed(x * x, t, rate),
        },
        {out: value},
        by=by, time=time, back=2 * back, rows=rows, drop=("_p", "_p0", "_x", "_k", "_s0", "_q0", "_s1", "_s2"),
    )


def ema(df: DataFrame, col: str = "close", span: int = 252, out: str = "ema", *, by=KEY, time=TIME, longest: int | None = None) -> DataFrame:
    """ema += alpha * (x - ema), started at the first value."""
    alpha = 2 / (span + 1)
    rate = -math.log(1 - alpha)
    rows, back = _geometric(rate)
    scaled = F.when(F.col("_p") == 0, F.col(col)).otherwise(lit(alpha) * F.col(col))
    return along_time(df, _PLACE, _ORIGIN, {out: lambda t: _decayed(scaled, t, rate)},
                      by=by, time=time, back=back, rows=rows, drop=("_p", "_p0"), longest=longest)


def ema_rows(span: int) -> int:
    """Rows of a key up to which ``ema`` uses a plain window."""
    return _geometric(-math.log(1 - 2 / (span + 1)))[0]


# ---- the nine base features -------------------------------------------------------

# The base feature names, in order.
BASE_FEATURES = ("simple_return", "log_return", "sma_5", "sma_20", "rsi_14", "bollinger_position",
                 "volume_ratio", "realized_vol_21", "bias")


def base_features(df: DataFrame, price: str = "close", volume: str | None = "volume", *, by=KEY, time=TIME,
                  longest: int | None = None) -> DataFrame:
    """All base features from one sort per key; ``volume`` may be absent."""
    missing = [c for c in (price, volume) if c and c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available {df.columns}")
    rows, back = _geometric(-math.log(1 - 1 / 14))
    place, origin, rsi = rsi_stages(price, 14, "rsi_14")
    first: Stage = {
        **place, "simple_return": lambda t: simple_return_of(price, t), "log_return": lambda t: log_return_of(price, t),
        "sma_5": lambda t: F.col(price) / (mean_of(price, t, 5) + lit(EPS)) - 1,
        "sma_20": lambda t: F.col(price) / (mean_of(price, t, 20) + lit(EPS)) - 1,
    }
    second: Stage = {**origin, "bollinger_position": lambda t: band_position(price, t, 20)}
    if volume:
        second["volume_ratio"] = lambda t: F.col(volume) / (mean_of(volume, t, 20) + lit(EPS))
    second["realized_vol_21"] = lambda t: realized_of("simple_return", t, 21)
    second["bias"] = lambda t: (F.col(price) - mean_of(price, t, 20)) / (mean_of(price, t, 20) + lit(EPS))
    out = along_time(df, first, second, rsi, by=by, time=time, back=max(back, 22), rows=rows, drop=RSI_DROP, longest=longest)
    names = [n for n in BASE_FEATURES if volume or n != "volume_ratio"]
    return out.select(*df.columns, *names)


# ---- normalisation -----------------------------------------------------------------

def rolling_zscore(df: DataFrame, cols: Sequence[str], window: int = 252, prefix: str = "z_", *, by=KEY, time=TIME) -> DataFrame:
    """Trailing z-score including the current row; the first row of a key is 0."""
    each = [trailing_moments([c], window, f"_m{i}") for i, c in enumerate(cols)]
    stages = [{k: v for stage in level for k, v in stage.items()} for level in zip(*each, strict=True)]

    def value(i: int, c: str, t: Line) -> Column:
        m = F.col(f"_m{i}")
        z = (F.col(c) - m["m0"]) / (F.sqrt(m["s00"] / m["n"]) + lit(1e-12))
        return F.when(F.col(f"_m{i}_at") == 0, lit(0)).otherwise(F.when(m["n"] > 0, z))

    scores = {f"{prefix}{c}": (lambda t, i=i, c=c: value(i, c, t)) for i, c in enumerate(cols)}
    extra = [f"_m{i}{end}" for i in range(len(cols)) for end in ("", "_at", "_head", "_tail")]
    return along_time(df, *stages, scores, by=by, time=time, back=window - 1, drop=extra)


def expanding_zscore(df: DataFrame, cols: Sequence[str], prefix: str = "z_", eps: float = 1e-8, *, by=KEY, time=TIME) -> DataFrame:
    """Causal expanding z-score; NULL adds 0 to the sums but counts as a row."""
    parts: dict = {"_n": ("sum", F.lit(1))}
    for c in cols:
        parts[f"_s_{c}"] = ("sum", F.coalesce(F.col(c), lit(0)))
        parts[f"_q_{c}"] = ("sum", F.coalesce(F.col(c) * F.col(c), lit(0)))
    out = running(df, parts, by=by, time=time)
    mean = lambda c: F.col(f"_s_{c}") / F.col("_n")
    var = lambda c: F.greatest(F.col(f"_q_{c}") / F.col("_n") - mean(c) * mean(c), lit(1e-12))
    return out.withColumns({
        f"{prefix}{c}": (F.col(c) - mean(c)) / (F.sqrt(var(c)) + lit(eps)) for c in cols}).drop(*parts)


# ---- momentum, liquidity, risk --------------------------------------------------------

def momentum(df: DataFrame, price: str = "close", periods: Sequence[int] = (5, 21, 63, 126), prefix: str = "mom_", *, by=KEY, time=TIME) -> DataFrame:
    stage = {f"{prefix}{k}": (lambda t, k=k: change_of(price, t, k)) for k in periods}
    return along_time(df, stage, by=by, time=time, back=max(periods))


def amihud_of(ret: str, price: str, volume: str) -> Column:
    dollars = F.col(price) * F.greatest(F.col(volume), lit(1))
    return F.abs(F.col(ret)) / F.greatest(dollars, lit(1e-12))


def amihud_illiquidity(
    df: DataFrame, price: str = "close", volume: str = "volume", window: int = 21, out: str = "illiq", *, by=KEY, time=TIME,
) -> DataFrame:
    """Rolling median of |return| per traded value, from row ``window`` on."""
    return along_time(
        df,
        {"_r": lambda t: simple_return_of(price, t)},
        {"_i": lambda t: amihud_of("_r", price, volume)},
        {out: lambda t: F.when(t.pos >= window, F.percentile("_i", lit(0.5)).over(t.last(window)))},
        by=by, time=time, back=window, drop=("_r", "_i"),
    )


def idio_of(ret: str, market: str, t: Line, window: int, min_valid: int) -> Column:
    """Deviation of the residual of a rolling regression on the market: s * sqrt(1 - rho^2)."""
    both = F.col(ret).isNotNull() & F.col(market).isNotNull()
    y, x, w = F.when(both, F.col(ret)), F.when(both, F.col(market)), t.last(window)
    sx, sy = F.stddev_pop(x).over(w), F.stddev_pop(y).over(w)
    rho = F.covar_pop(x, y).over(w) / F.nullif(sx * sy, lit(0))
    value = sy * F.sqrt(F.greatest(1 - rho * rho, lit(0)))
    return F.when((t.pos >= window) & (F.count(y).over(w) > min_valid), value)


def idiosyncratic_vol(
    df: DataFrame, ret: str = "simple_return", window: int = 63, min_valid: int = 20, out: str = "idio_vol", *, by=KEY, time=TIME,
) -> DataFrame:
    """``idio_of`` with the market return of the same rows."""
    both = attach(df, market_return(df, ret, "_mkt", time=time), [time])
    pair, m = F.col(ret).isNotNull() & F.col("_mkt").isNotNull(), F.col("_m")
    sx, sy = F.sqrt(m["s00"] / m["n"]), F.sqrt(m["s11"] / m["n"])
    rho = m["s01"] / m["n"] / F.nullif(sx * sy, lit(0))
    value = F.when((F.col("_m_at") >= window) & (m["n"] > min_valid), sy * F.sqrt(F.greatest(1 - rho * rho, lit(0))))
    return along_time(
        both, {"_x": lambda t: F.when(pair, F.col("_mkt")), "_y": lambda t: F.when(pair, F.col(ret))},
        *trailing_moments(["_x", "_y"], window, "_m"), {out: lambda t: value},
        by=by, time=time, back=window, drop=("_mkt", "_x", "_y", "_m", "_m_at", "_m_head", "_m_tail"))


def short_term_reversal(df: DataFrame, price: str = "close", out: str = "reversal", *, by=KEY, time=TIME) -> DataFrame:
    return along_time(df, {out: lambda t: -simple_return_of(price, t)}, by=by, time=time, back=1)


# ---- filters ---------------------------------------------------------------------------

def ffd_weights(d: float, threshold: float = 1e-5) -> list[float]:
    """Fractional differencing weights down to the threshold."""
    if not 0 <= d <= 1:
        raise ValueError("d must lie in [0, 1]")
    weights = [1.0]
    while abs(nxt := weights[-1] * (len(weights) - 1 - d) / len(weights)) >= threshold:
        weights.append(nxt)
    return weights


def weighted_past(col: str, weights: Sequence[float], t: Line, pad: float | None) -> Column:
    """Sum of weights[k] * x[t-k]; with ``pad`` None, NULL until the window is full."""
    width = len(weights)
    if width <= 128:
        past = [F.lag(col, k).over(t.w) if k else F.col(col) for k in range(width)]
        terms = [lit(v) * (F.coalesce(p, lit(pad)) if pad is not None else p) for v, p in zip(weights, past)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total
    frame = F.collect_list(F.coalesce(F.col(col), lit(pad or 0))).over(t.last(width))
    taps = F.array(*[lit(v) for v in weights])
    pairs = F.zip_with(F.reverse(frame), F.slice(taps, 1, F.size(frame)), lambda x, v: x * v)
    total = F.aggregate(pairs, lit(0), lambda a, b: a + b)
    return total if pad is not None else F.when(F.size(frame) == width, total)


def frac_diff(df: DataFrame, col: str, d: float, threshold: float = 1e-5, out: str = "frac_diff", *, by=KEY, time=TIME) -> DataFrame:
    """Fixed-width fractional differencing; NULL until the full width is available."""
    if d == 0:
        return df.withColumn(out, F.col(col))
    weights = ffd_weights(d, threshold)
    return along_time(df, {out: lambda t: weighted_past(col, weights, t, None)}, by=by, time=time, back=len(weights) - 1)


def causal_fir(df: DataFrame, col: str, taps: Sequence[float], bias: float = 0.0, out: str = "fir", *, by=KEY, time=TIME) -> DataFrame:
    """Causal convolution with given taps (taps[k] meets the row k back) and zero padding."""
    return along_time(df, {out: lambda t: weighted_past(col, taps, t, 0.0) + lit(bias)}, by=by, time=time, back=len(taps) - 1)


def trend_seasonal_split(df: DataFrame, col: str, period: int = 25, *, by=KEY, time=TIME) -> DataFrame:
    """Trailing sum / period (zeros before the start) as trend, the rest as seasonal."""
    trend = lambda t: F.sum(col).over(t.last(period)) / lit(period)
    return along_time(df, {"trend": trend, "seasonal": lambda t: F.col(col) - trend(t)}, by=by, time=time, back=period - 1)


# ---- sequences ----------------------------------------------------------------------------

def sequence_windows(
    df: DataFrame, cols: Sequence[str], length: int, target: str | None = None, target_at: str = "next",
    *, by=KEY, time=TIME,
) -> DataFrame:
    """One row per full window of ``length`` rows: an array of structs, oldest first.  The
    target is that of the following row, or of the window's last row."""
    stage: Stage = {"sequence": lambda t: F.collect_list(F.struct(*cols)).over(t.last(length))}
    if target:
        stage["target"] = (lambda t: F.lead(target).over(t.w)) if target_at == "next" else (lambda t: F.col(target))
    stage["_more"] = lambda t: F.lead(F.lit(1)).over(t.w)
    out = along_time(df, stage, by=by, time=time, back=length - 1, ahead=1).filter(F.size("sequence") == length)
    if target_at == "next":
        out = out.filter(F.col("_more").isNotNull())
    return out.select(*by, time, "sequence", *(["target"] if target else []))


def sequence_aggregates(df: DataFrame, cols: Sequence[str], length: int, *, by=KEY, time=TIME) -> DataFrame:
    """last, mean, sample deviation, min, max and slope per column over full windows."""
    stage: Stage = {"_len": lambda t: F.count(F.lit(1)).over(t.last(length))}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.col("_p").cast("double"))
        stage |= {
            f"{c}_last": lambda t, c=c: F.col(c),
            f"{c}_mean": lambda t, c=c: F.avg(c).over(t.last(length)),
            f"{c}_std": lambda t, c=c: F.stddev_samp(c).over(t.last(length)),
            f"{c}_min": lambda t, c=c: F.min(c).over(t.last(length)),
            f"{c}_max": lambda t, c=c: F.max(c).over(t.last(length)),
            f"{c}_slope": lambda t, c=c, at=at: F.coalesce(
                F.covar_pop(c, at).over(t.last(length)) / F.nullif(F.var_pop(at).over(t.last(length)), lit(0)), lit(0)),
        }
    out = along_time(df, _PLACE, stage, by=by, time=time, back=length - 1)
    names = [f"{c}_{a}" for c in cols for a in ("last", "mean", "std", "min", "max", "slope")]
    return out.filter(F.col("_len") == length).select(*by, time, *names)


def hidden_state_pool(df: DataFrame, states: str, method: str = "last", out: str = "pooled") -> DataFrame:
    """Pool an array of vectors: the last one, the mean per dimension, or both appended."""
    last = F.element_at(states, -1)

    def mean(i: Column) -> Column:
        vals = F.filter(F.transform(states, lambda v: v[i].cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
        return ratio(F.aggregate(vals, lit(0), lambda a, b: a + b), F.size(vals))

    mean_all = F.transform(F.sequence(F.lit(0), F.size(last) - 1), mean)
    last = F.transform(last, lambda x: x.cast("double"))
    picks = {"last": last, "mean": mean_all, "both": F.concat(last, mean_all)}
    if method not in picks:
        raise ValueError(f"method must be one of {sorted(picks)}, got {method!r}")
    return df.withColumn(out, picks[method])


# ---- variance forecasts ---------------------------------------------------------------------

def persistence_forecast(df: DataFrame, squared: str, floor: float = 1e-8, out: str = "forecast", *, by=KEY, time=TIME) -> DataFrame:
    lagged = lambda t: F.lag(squared).over(t.w)
    return along_time(df, {out: lambda t: F.when(lagged(t).isNotNull(), F.greatest(lagged(t), lit(floor)))},
                      by=by, time=time, back=1)


def historical_mean_forecast(
    df: DataFrame, squared: str, out: str = "forecast", *, by: Sequence[str] = ("symbol", "fold"), role: str = "role",
) -> DataFrame:
    """Training mean of the fold on every test row; NULL when it is not positive."""
    means = df.filter(F.col(role) == "train").groupBy(*by).agg(F.avg(squared).alias("_m"))
    return attach(df.filter(F.col(role) == "test"), means, by).withColumn(
        out, F.when(F.col("_m") > 0, F.col("_m"))).drop("_m")


def garch_filter(
    df: DataFrame, ret: str = "ret", *, by: Sequence[str] = ("symbol", "fold"), time=TIME,
    floor: float = 1e-8, cap: float = 10.0, out: str = "variance",
) -> DataFrame:
    """h_t = omega + alpha * r_{t-1}^2 + beta * h_{t-1} from parameter columns ``omega``,
    ``alpha``, ``beta`` and ``train_var`` that are constant in the key.

    The recursion is linear, so a segment's end state is a + beta^n * start: segments of
    256 rows are folded in place, and the chain of segment ends is folded per key.
    """
    step, start = 256, F.col("omega") / (1 - F.col("alpha") - F.col("beta"))
    placed = positions(df, by, time, "_p")
    shock = along_time(placed, {"_in": lambda t: F.when(F.col("_p") > 0, F.col("omega") + F.col("alpha") * F.pow(F.lag(ret).over(t.w), lit(2)))},
                       by=by, time="_p", back=1).withColumn("_seg", F.floor(F.col("_p") / step))
    keep = [c for c in df.columns if c not in by]
    segs = shock.groupBy(*by, "_seg").agg(
        F.sort_array(F.collect_list(F.struct("_p", F.col("_in").alias("x"), F.struct(*keep).alias("row")))).alias("_rows"),
        F.max("omega").alias("omega"), F.max("alpha").alias("alpha"), F.max("beta").alias("beta"))

    def walk(rows: Column, first: Column) -> Column:
        return F.aggregate(rows, F.struct(first.alias("h"), F.array().cast("array<double>").alias("all")), lambda acc, r: F.struct(
            F.when(r["x"].isNull(), first).otherwise(r["x"] + F.col("beta") * acc["h"]).alias("h"),
            F.concat(acc["all"], F.array(F.when(r["x"].isNull(), first).otherwise(r["x"] + F.col("beta") * acc["h"]))).alias("all")))

    ends = segs.select(*by, "_seg", "beta", F.size("_rows").alias("_n"),
                       walk(F.col("_rows"), F.when(F.col("_seg") == 0, start).otherwise(lit(0)))["h"].alias("_end"))
    # Carry into a segment: the ends of all earlier (full) segments, each faded by the rows since.
    fade = F.pow(F.col("beta"), lit(step))
    earlier = Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_past", F.collect_list("_end").over(earlier))
    carried = carried.select(*by, "_seg", F.aggregate("_past", lit(0), lambda a, e: a * fade + e).alias("_carry"))
    done = attach(segs, carried, [*by, "_seg"]).withColumn(
        "_h", walk(F.col("_rows"), F.when(F.col("_seg") == 0, start).otherwise(F.col("_carry")))["all"])
    flat = done.select(*by, F.posexplode("_h").alias("_i", "_v"), "_rows").select(*by, "_v", F.element_at("_rows", F.col("_i") + 1).alias("_r"))
    value = F.least(F.greatest(F.col("_v"), lit(floor)), F.col("train_var") * lit(cap))
    return flat.select(*by, "_v", "_r.row.*").withColumn(out, value).drop("_v")
