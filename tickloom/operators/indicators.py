"""Indicators over bars: frames of the last n bars, differences, and recursive averages.

All take bars with symbol and time and add columns. A frame indicator is null until it has n
bars. Times of a symbol must be distinct. Windows shuffle once by symbol and share one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expressions import corr_guarded, ratio, round_scaled


def series():
    return Window.partitionBy("symbol").orderBy("time")


def frame(n: int):
    return series().rowsBetween(-(n - 1), 0)


def full(value: Column, n: int, of: Column | None = None) -> Column:
    """value where the frame has n bars (with of: n values that are not null)."""
    count = F.count(of if of is not None else F.lit(1)).over(frame(n))
    return F.when(count == n, value)


def sma(x: Column, n: int) -> Column:
    return full(F.avg(x).over(frame(n)), n, x)


def rolling_sd(x: Column, n: int) -> Column:
    return full(F.stddev_samp(x).over(frame(n)), n, x)


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, sd = sma(F.col("close"), n), rolling_sd(F.col("close"), n)
    return bars.withColumns({"mid": mid, "upper": mid + k * sd, "lower": mid - k * sd})


def donchian(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumns({"channel_high": full(F.max("high").over(frame(n)), n), "channel_low": full(F.min("low").over(frame(n)), n)})


def stochastic(bars: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    """k: where the close lies in the frame's range, in percent (null in a flat one); d: its average of smooth bars."""
    low, high = F.min("low").over(frame(n)), F.max("high").over(frame(n))
    bars = bars.withColumn("k", full(ratio((F.col("close") - low) * 100, high - low), n))
    return bars.withColumn("d", sma(F.col("k"), smooth))


def returns(bars: DataFrame, n: int = 10) -> DataFrame:
    """ret, logret, momentum and roc (percent) over n bars, true_range."""
    prev, back = F.lag("close").over(series()), F.lag("close", n).over(series())
    gap = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return bars.withColumns(
        {
            "ret": ratio(F.col("close"), prev) - 1,
            "logret": log_return(F.col("close"), prev),
            "momentum": F.col("close") - back,
            "roc": (ratio(F.col("close"), back) - 1) * 100,
            "true_range": gap,
        }
    )


def log_return(now: Column, before: Column) -> Column:
    """Null where a price is not positive."""
    return F.when((now > 0) & (before > 0), F.ln(now / before))


def vwap(bars: DataFrame) -> DataFrame:
    """vwap and obv since the symbol's first bar. The volume is tick_volume, the price (high + low + close) / 3."""
    run = series().rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    sign = F.coalesce(F.signum(F.col("close") - F.lag("close").over(series())), F.lit(0.0))
    bars = bars.withColumn("__signed", (sign * F.col("tick_volume")).cast("long"))
    return bars.withColumns({"vwap": ratio(F.sum(typical * F.col("tick_volume")).over(run), F.sum("tick_volume").over(run)), "obv": F.sum("__signed").over(run)}).drop("__signed")


def chunk_bars(decay: float) -> int:
    """Bars of a chunk: two of them weigh a value down to 1e-18, and powers of the decay in one stay far from overflow."""
    return max(16, math.ceil(math.log(1e18) / -math.log(decay) / 2))


def smoothed_all(bars: DataFrame, averages: dict[str, tuple[Column, float]]) -> DataFrame:
    """For each name, x and alpha: alpha * x + (1 - alpha) * before, from the first x that counts (null before it).
    Null and NaN do not count: the average decays over them. alpha lies in (0, 1]; at 1 it is x itself, or the last 0.

    A recursive average never needs a symbol's whole series at once: inside a chunk it is a running sum of
    u * decay ** -k times decay ** k, and a chunk takes over what the chunks before it came to, of which two weigh.
    All averages of one chunk length share the sort, and windows alone carry over: the bars are read and dealt once."""
    for _, alpha in averages.values():
        if not 0 < alpha <= 1:
            raise ValueError("alpha must lie in (0, 1]")
    i, *names = free_names(bars, "i", *(f"x{k}" for k in range(len(averages))), *(f"seen{k}" for k in range(len(averages))))
    xs, seens = names[: len(averages)], names[len(averages) :]
    counted = lambda x: F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    rows = bars.withColumns({i: F.row_number().over(series()) - 1, **{c: counted(x) for c, (x, _) in zip(xs, averages.values(), strict=True)}})
    rows = rows.withColumns({s: F.count(c).over(series().rowsBetween(Window.unboundedPreceding, 0)) for c, s in zip(xs, seens, strict=True)})
    for group in _chunk_groups([1 - alpha for _, alpha in averages.values()]):
        own = {name: (F.col(xs[k]), F.col(seens[k]), alpha) for k, (name, (_, alpha)) in enumerate(averages.items()) if k in group}
        rows = _recursive(rows, i, own)
    return rows.drop(i, *xs, *seens)


def _chunk_groups(decays: list[float]) -> list[set[int]]:
    """Averages that can share a chunk length: the slowest one's, in which the fastest's powers do not overflow."""
    order = sorted(range(len(decays)), key=lambda k: -decays[k])
    groups: list[set[int]] = []
    for k in order:
        chunk = chunk_bars(max(decays[g] for g in groups[-1])) if groups else 0
        if groups and decays[k] > 0 and chunk * -math.log(decays[k]) < 300:
            groups[-1].add(k)
        else:
            groups.append({k})
    return groups


def _recursive(rows: DataFrame, i: str, averages: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    slowest = max(1 - alpha for *_, alpha in averages.values())
    u = lambda x, seen, alpha: F.coalesce(F.when((seen == 1) & x.isNotNull(), x).otherwise(alpha * x), F.lit(0.0))
    if slowest == 0:
        return rows.withColumns({name: F.when(seen > 0, u(x, seen, alpha)) for name, (x, seen, alpha) in averages.items()})
    chunk = chunk_bars(slowest)
    c, k, carry, *local = free_names(rows, "c", "k", "carry", *(f"local{j}" for j in range(len(averages))))
    rows = rows.withColumns({c: F.floor(F.col(i) / chunk), k: F.col(i) % chunk})
    inside = Window.partitionBy("symbol", c).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    decays = [1 - alpha for *_, alpha in averages.values()]
    power = lambda d, e: F.exp(e * math.log(d))
    rows = rows.withColumns({n: F.sum(u(*a) * power(d, -F.col(k))).over(inside) * power(d, F.col(k)) for n, d, a in zip(local, decays, averages.values(), strict=True)})
    # what the chunks before came to at their end: first the last one alone, then with what that took over
    before = Window.partitionBy("symbol").orderBy(c, k).rowsBetween(Window.unboundedPreceding, -1)
    at_end = lambda values: F.last(F.when(F.col(k) == chunk - 1, F.struct(*values)), ignorenulls=True).over(before)
    rows = rows.withColumn(carry, at_end([F.col(n).alias(n) for n in local]))
    taken = lambda n: F.coalesce(F.col(f"{carry}.{n}"), F.lit(0.0))
    rows = rows.withColumn(carry, at_end([(F.col(n) + d**chunk * taken(n)).alias(n) for n, d in zip(local, decays, strict=True)]))
    value = {name: F.when(seen > 0, F.col(n) + taken(n) * power(d, F.col(k) + 1)) for (name, (_, seen, _)), n, d in zip(averages.items(), local, decays, strict=True)}
    return rows.withColumns(value).drop(c, k, carry, *local)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each behind so many underscores that df has no column of that name (in any case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"__{name}".lower() in have:
            name = f"_{name}"
        out.append(f"__{name}")
        have.add(out[-1].lower())
    return out


def ema(bars: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """Exponential average with weight 2 / (n + 1), seeded by the first value."""
    return smoothed(bars, F.col(column), 2 / (n + 1), out)


def smoothed(bars: DataFrame, x: Column, alpha: float, out: str) -> DataFrame:
    return smoothed_all(bars, {out: (x, alpha)})


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    bars = smoothed_all(bars, {"__fast": (F.col("close"), 2 / (fast + 1)), "__slow": (F.col("close"), 2 / (slow + 1))})
    bars = bars.withColumn("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    return ema(bars, "macd", signal, "macd_signal")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's index: gains and losses smoothed with weight 1 / n from the first change; null for the first n bars.
    100 without losses, 50 without any change."""
    change = F.col("close") - F.lag("close").over(series())
    bars = bars.withColumns({"__gain": F.greatest(change, F.lit(0.0)), "__loss": F.greatest(-change, F.lit(0.0)), "__n": F.row_number().over(series())})
    moved = lambda c: F.when(F.col("__n") > 1, F.col(c))
    bars = smoothed_all(bars, {"__g": (moved("__gain"), 1 / n), "__l": (moved("__loss"), 1 / n)})
    total = F.col("__g") + F.col("__l")
    return bars.withColumn("rsi", F.when(F.col("__n") > n, F.when(total == 0, 50.0).otherwise(ratio(100 * F.col("__g"), total)))).drop("__gain", "__loss", "__n", "__g", "__l")


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """True range (high - low on the first bar) smoothed with weight 1 / n; null for the first n - 1 bars."""
    prev = F.lag("close").over(series())
    gap = F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - prev), F.lit(0.0)), F.coalesce(F.abs(F.col("low") - prev), F.lit(0.0)))
    bars = smoothed(bars.withColumns({"__tr": gap, "__n": F.row_number().over(series())}), F.col("__tr"), 1 / n, "atr")
    return bars.withColumn("atr", F.when(F.col("__n") >= n, F.col("atr"))).drop("__tr", "__n")


def rolling_corr(x: Column, y: Column, n: int) -> Column:
    return full(corr_guarded(x, y, frame(n)), n, F.when(x.isNotNull() & y.isNotNull(), 1))


def volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """vol: sample deviation of the last n log returns."""
    bars = bars.withColumn("logret", log_return(F.col("close"), F.lag("close").over(series())))
    return bars.withColumn("vol", rolling_sd(F.col("logret"), n))


def volatility_regime(bars: DataFrame, n: int = 20, lookback: int = 100, high: float = 0.8) -> DataFrame:
    """vol_pct: share of the last lookback volatilities (its own too) that are not above the current one; regime: high
    from `high` up, else low; null without volatility."""
    bars = volatility(bars, n)
    past = F.collect_list("vol").over(frame(lookback))
    share = ratio(F.size(F.filter(past, lambda v: v <= F.col("vol"))).cast("double"), F.size(past).cast("double"))
    bars = bars.withColumn("vol_pct", F.when(F.col("vol").isNotNull(), share))
    return bars.withColumn("regime", F.when(F.col("vol_pct") >= high, "high").when(F.col("vol_pct").isNotNull(), "low"))


def forward_target(bars: DataFrame, horizon: int) -> DataFrame:
    """target: the return over the next horizon bars, null where they are not all there. Never a feature."""
    return bars.withColumn("target", ratio(F.lead("close", horizon).over(series()), F.col("close")) - 1)


def crossover(bars: DataFrame, fast: int = 5, slow: int = 20, digits: int = 9) -> DataFrame:
    """signal: 1 where the fast average crosses above the slow one, -1 below, else 0; entries take the next bar's open.

    Averages are compared at so many digits after the point: equal ones of different sums differ by the last bits, which
    would be crossings. Where their difference is no number (NaN, infinite prices) they count as equal."""
    bars = bars.withColumns({"fast": sma(F.col("close"), fast), "slow": sma(F.col("close"), slow)})
    side = F.nanvl(F.signum(round_scaled(F.col("fast"), digits) - round_scaled(F.col("slow"), digits)), F.lit(0.0))
    bars = bars.withColumn("__side", side)
    before = F.lag("__side").over(series())
    signal = F.when((F.col("__side") > 0) & (before <= 0), 1).when((F.col("__side") < 0) & (before >= 0), -1).otherwise(0)
    return bars.withColumns({"signal": signal, "entry_time": F.lead("time").over(series()), "entry_price": F.lead("open").over(series())}).drop("__side")


#: Rows of a chunk of a series that is too long for one task.
CHUNK_ROWS = 100_000


def numbered_by_day(rows: DataFrame, tiebreak: str) -> DataFrame:
    """rows with i, their number in their symbol from 1 by (time, tiebreak), without a sort of a whole symbol: a day's
    rows are numbered, and the days before counted."""
    day = F.to_date("time")
    sizes = rows.groupBy("symbol", day.alias("__day")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("symbol").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("symbol").alias("__symbol"), "__day", F.coalesce(before, F.lit(0)).alias("__before"))
    own = rows.withColumns({"__of": day, "__place": F.row_number().over(Window.partitionBy("symbol", day).orderBy("time", tiebreak))})
    same = F.col("symbol").eqNullSafe(F.col("__symbol")) & F.col("__of").eqNullSafe(F.col("__day"))
    return own.join(sizes, same).withColumn("i", F.col("__place") + F.col("__before")).drop("__of", "__place", "__symbol", "__day", "__before")


def by_chunks(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], before: int, after: int = 1, size: int = CHUNK_ROWS) -> DataFrame:
    """transform (of series by symbol and time, which may look so many rows back and ahead) over chunks of numbered rows
    (i), each with the rows it looks at: no task sorts more than a chunk. While transform runs, time is i."""
    own, at = F.floor(F.col("i") / size), F.col("i") % size
    chunks = F.array_compact(F.array(own, F.when(at < after, own - 1), F.when(at >= size - before, own + 1)))
    dealt = rows.withColumns({"__own": own, "__time": F.col("time"), "__symbol": F.col("symbol")}).withColumn("__chunk", F.explode(chunks))
    done = transform(dealt.withColumns({"symbol": F.struct("__symbol", "__chunk"), "time": F.col("i")}))
    return done.where("__chunk = __own").withColumns({"symbol": F.col("__symbol"), "time": F.col("__time")}).drop("__own", "__chunk", "__time", "__symbol")
