"""Ticks to bars, bars to coarser bars, and what is kept of them.

A tick has symbol, ts, id (which breaks ties), price. A bar holds the ticks of a half-open
interval [time, time + width). Ticks without a price are no ticks: open, high, low and close
ignore them and they are not counted. Intervals without ticks have no bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expressions import micros, order_key, ratio


def ticks_from_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"))


def bar_time(ts: Column, width: str) -> Column:
    """Start of the interval of ts. width: hour, day, or a number of minutes such as "15 minutes"."""
    return F.date_trunc(width, ts).cast("timestamp_ntz") if " " not in width else F.window(ts, width)["start"].cast("timestamp_ntz")


def ohlcv(ticks: DataFrame, width: str = "hour") -> DataFrame:
    """(symbol, time, open, high, low, close, tick_volume). Partial aggregation combines ticks before the one shuffle."""
    key = order_key(F.col("ts"), F.col("id"))
    return (
        ticks.where(F.col("price").isNotNull())
        .withColumn("time", bar_time(F.col("ts"), width))
        .groupBy("symbol", "time")
        .agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.count("*").alias("tick_volume"),
        )
    )


def resample(bars: DataFrame, width: str) -> DataFrame:
    """Bars to coarser bars; equal to bars of the ticks themselves where the widths nest."""
    return (
        bars.withColumn("wide", bar_time(F.col("time"), width))
        .groupBy("symbol", F.col("wide").alias("time"))
        .agg(
            F.min_by("open", F.col("time")).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", F.col("time")).alias("close"),
            F.sum("tick_volume").alias("tick_volume"),
        )
    )


def day_snapshot(ticks: DataFrame) -> DataFrame:
    """Daily bars with the close of the last day before that has ticks, and the change from it, absolute and in percent."""
    w = Window.partitionBy("symbol").orderBy("time")
    change = F.col("close") - F.col("prev_close")
    return ohlcv(ticks, "day").withColumn("prev_close", F.lag("close").over(w)).withColumn("change", change).withColumn("change_pct", ratio(change * 100, F.col("prev_close")))


def inventory(bars: DataFrame) -> DataFrame:
    """What is stored of each symbol: bars, first and last time, ticks."""
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.sum("tick_volume").alias("ticks"))


def last_n(rows: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The last n rows of each group; Spark keeps n rows of a group on each task before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def tape(ticks: DataFrame, n: int) -> DataFrame:
    """The n most recent ticks of each symbol, recency 1 first."""
    return last_n(ticks, n, ["symbol"], [F.desc("ts"), F.desc("id")])


def chart_payload(bars: DataFrame, columns: list[str], most: int = 10_000) -> DataFrame:
    """A row for each symbol and page of at most `most` bars (page from 0, in time order): arrays of times, in microseconds
    since 1970, and of each column, aligned and in time order."""
    w = Window.partitionBy("symbol").orderBy("time")
    paged = bars.withColumn("page", F.floor((F.row_number().over(w) - 1) / most))
    points = F.sort_array(F.collect_list(F.struct(micros(F.col("time")).alias("time"), *columns)))
    return paged.groupBy("symbol", "page").agg(points.alias("points")).select("symbol", "page", *[_column_of(c) for c in ("time", *columns)])


def _column_of(name: str) -> Column:
    return F.transform("points", lambda p: p[name]).alias(name)
