"""Walk-forward evaluation: windows, grids, efficiency, hold-out, gates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.expressions import ratio


def windows(bounds: DataFrame, train_days: int, test_days: int, step_days: int) -> DataFrame:
    """(index, train_start, train_end, test_start, test_end) for each window that ends within the bounds (one row: start,
    end). Training and test are half-open and meet."""
    last = F.expr(f"end - INTERVAL {train_days + test_days} DAYS")
    starts = F.when(last >= F.col("start"), F.sequence("start", last, F.expr(f"INTERVAL {step_days} DAYS")))
    w = bounds.select(F.posexplode(starts).alias("index", "train_start"))
    days = lambda n: F.expr(f"train_start + INTERVAL {n} DAYS")
    return w.select(F.col("index").cast("long").alias("index"), "train_start", days(train_days).alias("train_end"), days(train_days).alias("test_start"), days(train_days + test_days).alias("test_end"))


def split(rows: DataFrame, ts: str, windows: DataFrame) -> DataFrame:
    """Rows with each window's index and part (train or test) that they fall in. Windows are few: their number follows
    from the days covered, not from the rows."""
    parts = windows.select("index", F.inline(F.array(F.struct(F.lit("train").alias("part"), F.col("train_start").alias("from_"), F.col("train_end").alias("to_")), F.struct(F.lit("test").alias("part"), F.col("test_start").alias("from_"), F.col("test_end").alias("to_")))))
    days = F.explode(F.sequence(F.to_date("from_"), F.to_date("to_")))
    parts = parts.withColumn("__day", days)
    return rows.withColumn("__day", F.to_date(ts)).join(parts, "__day").where((F.col(ts) >= F.col("from_")) & (F.col(ts) < F.col("to_"))).drop("__day", "from_", "to_")


def efficiency(results: DataFrame, by: list[str], metric: str) -> DataFrame:
    """In-sample and out-of-sample mean of the metric over windows, and the second over the first (null at 0)."""
    part = lambda p: F.avg(F.when(F.col("part") == p, F.col(metric)))
    out = results.groupBy(*by).agg(part("train").alias("in_sample"), part("test").alias("out_of_sample"), F.count_distinct(F.when(F.col("part") == "test", F.col("index"))).alias("n_windows"))
    return out.withColumn("efficiency", ratio(F.col("out_of_sample"), F.col("in_sample")))


def lockbox(rows: DataFrame, ts: str, days: int | None = None, pct: float | None = None) -> DataFrame:
    """locked: whether a row lies in the last days, or in the last share of the covered time."""
    if (days is None) == (pct is None):
        raise ValueError("give days or pct")
    ends = rows.agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"))
    seconds = F.timestamp_diff("SECOND", F.col("__first"), F.col("__last"))
    back = F.lit(days * 86_400) if days is not None else F.floor(seconds * pct)
    cut = ends.select(F.timestamp_add("SECOND", -back.cast("int"), F.col("__last")).alias("__cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("locked", F.col(ts) > F.col("__cut")).drop("__cut")  # one row


@dataclass(frozen=True)
class Gates:
    min_trades: int = 1
    min_windows: int = 1
    efficiency: tuple[float, float] = (0.0, 10.0)


def gate_flags(rows: DataFrame, gates: Gates) -> DataFrame:
    """flags: the sorted names of the gates that a row fails; passed: none."""
    low, high = gates.efficiency
    e = F.col("efficiency")
    checks = [
        F.when(F.coalesce("trades", F.lit(0)) < gates.min_trades, "too_few_trades"),
        F.when(F.coalesce("n_windows", F.lit(0)) < gates.min_windows, "too_few_windows"),
        F.when(e.isNull() | (e < low) | (e > high), "efficiency_out_of_band"),
    ]
    return rows.withColumn("flags", F.array_sort(F.array_compact(F.array(*checks)))).withColumn("passed", F.size("flags") == 0)


def axis(spec: dict) -> Column:
    """An array of a parameter's values: {"choices"}, {"low", "high", "step"} or {"low", "high", "n", "log": True}."""
    if "choices" in spec:
        return F.array(*[F.lit(c) for c in spec["choices"]])
    low, high = spec["low"], spec["high"]
    if spec.get("log"):
        return F.transform(F.sequence(F.lit(0), F.lit(spec["n"] - 1)), lambda i: F.round(F.lit(float(low)) * F.pow(F.lit(high / low), i / (spec["n"] - 1)), 9))
    if isinstance(spec["step"], int):
        return F.sequence(F.lit(low), F.lit(high), F.lit(spec["step"]))
    n = int((high - low) / spec["step"] + 1e-9)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.round(F.lit(float(low)) + i * spec["step"], 9))


def grid(spark: SparkSession, space: dict[str, dict]) -> DataFrame:
    """Every combination of the axes, a row each."""
    rows = spark.range(1).select(*[axis(s).alias(f"__{n}") for n, s in space.items()])
    return reduce(lambda df, n: df.withColumn(n, F.explode(f"__{n}")).drop(f"__{n}"), space, rows)


def presets(rows: DataFrame, variants: list[dict], baseline: bool) -> DataFrame:
    """Each row with each exit preset (preset, stop, target), and with baseline once without any."""
    values = [F.struct(F.lit(v["preset"]).alias("preset"), F.lit(v["stop"]).cast("double").alias("stop"), F.lit(v["target"]).cast("double").alias("target")) for v in variants]
    if baseline:
        values.append(F.struct(F.lit("baseline").alias("preset"), F.lit(None).cast("double").alias("stop"), F.lit(None).cast("double").alias("target")))
    return rows.withColumn("__p", F.explode(F.array(*values))).select("*", "__p.*").drop("__p")
