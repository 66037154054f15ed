"""Backtests over bars: fills, exits, sizing, costs, positions, equity.

Rules, which are this library's own: a signal on a bar's close enters long at the next bar's
open. From that bar on, each bar is tried in order: if its low reaches the stop (the fixed or
the trailing one, whichever is higher; the trail follows the highest high of the bars before)
the trade ends there, or at the open if that is lower already; else if its high reaches the
target it ends there, or at the open if that is higher; after `hold` bars it ends at the
close, and at the last close if the series ends first. A symbol holds one trade at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.expressions import clamp, ratio
from tickloom.operators.indicators import series


@dataclass(frozen=True)
class Exits:
    """Distances are shares of the entry price (trail: of the peak); None leaves a rule out."""

    hold: int = 24
    stop: float | None = 0.1
    target: float | None = 0.2
    trail: float | None = None


def fill_price(price: Column, side: Column, slippage_bps: float) -> Column:
    """The next open, worse by the slippage for the side (1 buys, -1 sells)."""
    return price * (1 + side * slippage_bps / 10_000)


def costs(notional: Column, contracts: Column, bps: float, per_contract: float) -> Column:
    return F.abs(notional) * bps / 10_000 + F.abs(contracts) * per_contract


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("i", F.row_number().over(series()))


def candidate_trades(bars: DataFrame, signals: DataFrame, exits: Exits, variants: tuple[str, ...] = ()) -> DataFrame:
    """What each signal (symbol, i: the bar it is known at) would trade by itself: entry and exit bar and price, reason,
    and the largest gain and loss on the way (mfe, mae, as shares of the entry price).

    bars: numbered ones. A signal meets the `hold` bars after it in an equi-join on (symbol, i), so a
    group is never larger than that. variants: columns of signals that tell several exit settings of one signal apart;
    those named stop and target go before those of exits, null for none."""
    given = lambda name, value: F.col(name) if name in variants else F.lit(value).cast("double")
    entry = bars.select("symbol", (F.col("i") - 1).alias("s"), F.col("open").alias("entry_price"), F.col("time").alias("entry_time"))
    path = signals.select("symbol", F.col("i").alias("s"), *variants).join(entry, ["symbol", "s"])
    path = path.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(exits.hold)))).withColumn("i", F.col("s") + F.col("k"))
    path = path.join(bars.select("symbol", "i", "time", "open", "high", "low", "close"), ["symbol", "i"])
    one = Window.partitionBy("symbol", "s", *variants).orderBy("k")
    e = F.col("entry_price")
    peak = F.greatest(e, F.coalesce(F.max("high").over(one.rowsBetween(Window.unboundedPreceding, -1)), e))
    fixed, target = e * (1 - given("stop", exits.stop)), e * (1 + given("target", exits.target))
    stop = F.greatest(fixed, peak * (1 - F.lit(exits.trail).cast("double")))  # of those there are
    tested = path.withColumn("stop_at", stop)
    last = F.col("k") == F.max("k").over(Window.partitionBy("symbol", "s", *variants))
    reason = (
        F.when(F.col("low") <= F.col("stop_at"), F.when(F.col("stop_at") > F.coalesce(fixed, F.lit(-1.0)), "trail").otherwise("stop"))
        .when(F.col("high") >= target, "target")
        .when(F.col("k") == exits.hold, "time")
        .when(last, "end")
    )
    price = F.when(reason.isin("stop", "trail"), F.least("open", "stop_at")).when(reason == "target", F.greatest(F.col("open"), target)).otherwise(F.col("close"))
    tested = tested.withColumns({"reason": reason, "price": price, "top": F.max("high").over(one), "bottom": F.min("low").over(one)})
    at = F.when(F.col("reason").isNotNull(), F.col("k"))
    first = lambda c: F.min_by(c, at)
    return tested.groupBy("symbol", "s", *variants, "entry_time", "entry_price").agg(
        first("i").alias("exit_i"), first("time").alias("exit_time"), first("price").alias("exit_price"), first("reason").alias("reason"),
        (ratio(first("top"), F.first("entry_price")) - 1).alias("mfe"), (1 - ratio(first("bottom"), F.first("entry_price"))).alias("mae"),
    )


def one_at_a_time(trades: DataFrame) -> DataFrame:
    """The trades that are taken if one must be over (by the close of its exit bar) before a signal counts.

    Rows stream through sorted partitions with the last exit as the only state; no symbol is held in memory."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, busy = None, -1
        for rows in batches:
            keep = []
            for name, s, exit_i in zip(rows["symbol"], rows["s"], rows["exit_i"], strict=True):
                if name != symbol:
                    symbol, busy = name, -1
                keep.append(s >= busy)
                if keep[-1]:
                    busy = exit_i
            yield rows[keep]

    return trades.repartition("symbol").sortWithinPartitions("symbol", "s").mapInPandas(take, trades.schema)


def first_by_priority(signals: list[DataFrame]) -> DataFrame:
    """Several entry rules at once: of signals on the same bar the first rule's stays. source: its number from 0."""
    merged = None
    for n, s in enumerate(signals):
        own = s.select("symbol", "i", F.lit(n).alias("source"))
        merged = own if merged is None else merged.unionByName(own)
    return merged.groupBy("symbol", "i").agg(F.min("source").alias("source"))


def fixed_size(strength: Column | None, quantity: float) -> Column:
    return F.lit(quantity) * strength if strength is not None else F.lit(quantity)


def margin_size(equity: Column, margin: Column | float, least: int, most: int) -> Column:
    """Whole contracts that the equity covers at a safety margin each, clamped; 0 without a positive margin."""
    m = margin if isinstance(margin, Column) else F.lit(margin)
    return F.when(m > 0, clamp(F.floor(equity / m), least, most)).otherwise(0).cast("long")


def inverse_volatility_size(vol: Column, target_vol: float, least: float, most: float) -> Column:
    """target / volatility, clamped; null without volatility, the most at none."""
    return F.when(vol == 0, F.lit(most)).otherwise(clamp(ratio(F.lit(target_vol), vol), least, most))


def with_pnl(trades: DataFrame, quantity: float = 1.0, slippage_bps: float = 0.0, bps: float = 0.0, per_contract: float = 0.0) -> DataFrame:
    """pnl in money and ret as a share of the entry, after slippage and costs of both fills."""
    buy, sell = fill_price(F.col("entry_price"), F.lit(1), slippage_bps), fill_price(F.col("exit_price"), F.lit(-1), slippage_bps)
    q = F.lit(quantity)
    paid = costs(buy * q, q, bps, per_contract) + costs(sell * q, q, bps, per_contract)
    return trades.withColumn("pnl", (sell - buy) * q - paid).withColumn("ret", ratio(F.col("pnl"), F.col("entry_price") * q))


def equity_curve(trades: DataFrame, by: str, order: list[str], start: float) -> DataFrame:
    """equity after each trade, its running peak and the drawdown from it (a share)."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    curve = trades.withColumn("equity", start + F.sum("pnl").over(w))
    curve = curve.withColumn("peak", F.greatest(F.lit(start), F.max("equity").over(w)))
    return curve.withColumn("drawdown", 1 - ratio(F.col("equity"), F.col("peak")))


def performance(trades: DataFrame, by: str, order: list[str], start: float) -> DataFrame:
    """Trades, total, win rate, profit factor (null without losses), Sharpe ratio of the trades' returns, and the largest
    drawdown of the equity curve that begins with start."""
    gain, loss = F.sum(F.greatest("pnl", F.lit(0.0))), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0)))
    return equity_curve(trades, by, order, start).groupBy(by).agg(
        F.count("*").alias("trades"), F.sum("pnl").alias("total"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        ratio(gain, loss).alias("profit_factor"), ratio(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"), F.max("drawdown").alias("max_drawdown"),
    )


def excursions(trades: DataFrame) -> DataFrame:
    """capture: share of the largest gain that was kept; giveback: the gain given back, as a share of the entry."""
    ret = ratio(F.col("exit_price"), F.col("entry_price")) - 1
    return trades.withColumns({"capture": ratio(ret, F.col("mfe")), "giveback": F.col("mfe") - ret})


def positions(fills: DataFrame) -> DataFrame:
    """Each account's position after its fills (account, n: their order, time, signed quantity, price) at average cost:
    account, quantity, average, realized, fills, is_open, opened_at, closed_at (null while it is open).

    Adding to a position averages its price; reducing it realizes the difference; going through zero opens the rest at
    the fill's price and time. A fill without quantity or price is none; null accounts are one account. Rows stream
    through sorted partitions with one position as the state."""
    kind = fills.schema
    schema = T.StructType([T.StructField("account", kind["account"].dataType), *(T.StructField(c, T.DoubleType()) for c in ("quantity", "average", "realized")), T.StructField("fills", T.LongType()), *(T.StructField(c, kind["time"].dataType) for c in ("opened_at", "closed_at"))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # (account, state, opened, closed)
        for batch in batches:
            done = []
            for a, t, dq, p in zip(*(batch.column(c).to_pylist() for c in ("account", "time", "quantity", "price")), strict=True):
                if now is None or a != now[0]:
                    done += [now] if now else []
                    now = (a, (0.0, 0.0, 0.0, 0), None, None)
                before, state = now[1][0], after_fill(*now[1], dq, p)
                opened = t if state[0] and before * state[0] <= 0 else now[2]
                now = (a, state, opened, None if state[0] else t if before else now[3])
            yield _position_rows(done, batch.schema)
        if now:
            yield _position_rows([now], batch.schema)

    good = fills.select("account", "n", "time", "quantity", "price").dropna(subset=["quantity", "price"])
    out = good.repartition("account").sortWithinPartitions("account", "n").mapInArrow(fold, schema)
    return out.select("account", "quantity", "average", "realized", "fills", (F.col("quantity") != 0).alias("is_open"), "opened_at", "closed_at")


def _position_rows(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    rows = [(a, *state, opened, closed) for a, state, opened, closed in done]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [schema.field("account").type, pa.float64(), pa.float64(), pa.float64(), pa.int64(), schema.field("time").type, schema.field("time").type]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["account", "quantity", "average", "realized", "fills", "opened_at", "closed_at"])


def after_fill(q: float, average: float, realized: float, fills: int, dq: float, p: float) -> tuple[float, float, float, int]:
    if q * dq >= 0:
        total = q + dq
        return total, (q * average + dq * p) / total if total else 0.0, realized, fills + 1
    closed = min(abs(q), abs(dq)) * (1 if q > 0 else -1)
    rest = q + dq
    return rest, (average if rest * q > 0 else p if rest else 0.0), realized + closed * (p - average), fills + 1


def ledger(entries: DataFrame, account: str, order: list[str], amount: str, start: Column) -> DataFrame:
    """balance_after of each entry, exact in decimals."""
    w = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("balance_after", start + F.sum(F.col(amount)).over(w))
