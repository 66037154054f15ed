"""Joins of series and records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expressions import micros
from tickloom.sources.catalog import stored


def asof_join(left: DataFrame, right: DataFrame, by: list[str], ts: str, values: list[str], tiebreak: str | None = None, bucket_seconds: int = 86_400) -> DataFrame:
    """left with the values of the last row of right at or before its time, of the same key; null where there is none.

    Both sides' union is dealt by key and time bucket, and each bucket begins with the last values of the buckets before,
    which a row a bucket carries over: no task sorts more of a key than a bucket, and no pairs are made. An equal time
    matches. Of right rows of one key and time the one of the largest tiebreak counts (without tiebreak they must be
    distinct). Null values of right are values: they are carried like any other. Right rows without a time are none;
    left rows without a time find nothing.
    """
    right = right.where(F.col(ts).isNotNull())
    if tiebreak:
        right = right.groupBy(*by, ts).agg(F.max_by(F.struct(*values), tiebreak).alias("__v")).select(*by, ts, "__v")
    else:
        right = right.select(*by, ts, F.struct(*values).alias("__v"))
    bucket = F.floor(micros(F.col(ts)) / (bucket_seconds * 1_000_000)).alias("__bucket")
    kind = right.schema["__v"].dataType
    none = F.lit(None).cast(kind).alias("__v")
    lasts = right.groupBy(*by, bucket).agg(F.max_by("__v", ts).alias("__v")).withColumn("__asked", F.lit(False))
    asked = left.select(*by, bucket).distinct().select(*by, "__bucket", none, F.lit(True).alias("__asked"))
    earlier = Window.partitionBy(*by).orderBy("__bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = asked.unionByName(lasts).withColumn("__v", F.last("__v", ignorenulls=True).over(earlier)).where("__asked and __v IS NOT NULL")
    own = [c for c in left.columns if c not in (*by, ts)]
    a = left.select(*by, ts, bucket, F.lit(2).alias("__side"), F.struct(*own).alias("__row"), none)
    no_row, no_time = F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.lit(None).cast(left.schema[ts].dataType).alias(ts)
    b = right.select(*by, ts, bucket, F.lit(1).alias("__side"), no_row, "__v")
    c = carried.select(*by, no_time, "__bucket", F.lit(0).alias("__side"), no_row, "__v")
    w = Window.partitionBy(*by, "__bucket").orderBy(F.asc_nulls_first(ts), "__side").rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(b).unionByName(c).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 2")
    return merged.select(*by, ts, *[F.col(f"__row.{c}").alias(c) for c in own], *[F.col(f"__last.{v}").alias(v) for v in values])


def lagged(series: DataFrame, by: list[str], order: str, columns: list[str], bars: int) -> DataFrame:
    """Each value as it is available: columns moved back by so many bars of their own series."""
    w = Window.partitionBy(*by).orderBy(order)
    return series.withColumns({c: F.lag(c, bars).over(w) for c in columns})


def align_exogenous(bars: DataFrame, series: DataFrame, by: list[str], ts: str, values: list[str], lag: int = 0) -> DataFrame:
    """Bars with another series' values as of each bar, available lag bars late."""
    return asof_join(bars, lagged(series, by, ts, values, lag) if lag else series, by, ts, values)


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], point: str, start: str, end: str, bucket_seconds: int = 86_400) -> DataFrame:
    """Points with the intervals [start, end) of their key that hold them: an equi-join on key and time bucket, and then
    the bounds. An interval is put into each bucket it touches, so buckets should be about as long as intervals."""
    seconds = lambda c: F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c) / bucket_seconds)
    p = points.withColumn("__bucket", seconds(F.col(point)))
    i = intervals.where(F.col(start) < F.col(end)).withColumn("__bucket", F.explode(F.sequence(seconds(F.col(start)), seconds(F.col(end)))))
    return p.join(i, [*by, "__bucket"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("__bucket")


def not_found(requested: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return requested.join(existing, key, "left_anti")


#: Points of a block, when blocks judge each other, and points that judge all others first.
BLOCK, CHAMPIONS = 4096, 1000


def pareto_front(points: DataFrame, key: str, larger: list[str], smaller: list[str]) -> DataFrame:
    """Points that no other one dominates (at least as good in all objectives, better in one).

    Points of equal objectives collapse first; points with a null objective are none. With two objectives no pairs are
    compared: stretches of the first one pass on their best of the second, which drops most points on the map side, and
    a running best in each stretch decides. With more, each batch drops what it dominates itself, then what the
    best-ranked CHAMPIONS of all dominate goes, and blocks of what is left judge each other, two at a time in a task.
    """
    goals = [*larger, *smaller]
    sign = {**dict.fromkeys(larger, 1), **dict.fromkeys(smaller, -1)}
    good = points.dropna(subset=goals)
    distinct = good.select(*goals).distinct()
    first = goals[0]
    up = sign[first] > 0
    if len(goals) == 1:
        return good.join(F.broadcast(distinct.agg((F.max if up else F.min)(first).alias(first))), goals, "left_semi")  # one row
    if len(goals) > 2:
        return good.join(_front_of_many(distinct, goals, [sign[g] for g in goals]), goals, "left_semi")
    second = goals[1]
    best_of = F.max if sign[second] > 0 else F.min
    beats = (lambda a, b: a > b) if sign[second] > 0 else (lambda a, b: a < b)
    edges = sorted(set(distinct.approxQuantile(first, [i / 200 for i in range(201)], 0.002)))
    stretch = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(first)))
    marked = distinct.withColumn("__s", stretch)
    tops = marked.groupBy("__s").agg(best_of(second).alias("__top"))  # a row for each stretch: 202 at most
    w = Window.orderBy(F.desc("__s") if up else F.asc("__s")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__s", best_of("__top").over(w).alias("__better"))
    left = marked.join(F.broadcast(tops), "__s").where(F.col("__better").isNull() | beats(F.col(second), F.col("__better")))
    best = left.groupBy("__s", first).agg(best_of(second).alias(second))
    w = Window.partitionBy("__s").orderBy(F.desc(first) if up else F.asc(first)).rowsBetween(Window.unboundedPreceding, -1)
    ahead = best.withColumn("__ahead", best_of(second).over(w))
    front = ahead.where(F.col("__ahead").isNull() | beats(F.col(second), F.col("__ahead"))).select(first, second)
    return good.join(front, goals, "left_semi")


def _dominated(points: np.ndarray, judges: np.ndarray) -> np.ndarray:
    """Which points a judge dominates; more is better."""
    out = np.zeros(len(points), dtype=bool)
    for s in range(0, len(judges), 256):
        own = judges[s : s + 256, None, :]
        left = np.flatnonzero(~out)
        out[left] = ((own >= points[None, left]).all(2) & (own > points[None, left]).any(2)).any(0)
    return out


def _front_of_many(distinct: DataFrame, goals: list[str], signs: list[int]) -> DataFrame:
    spark = distinct.sparkSession
    values = lambda batch: np.stack([np.array(batch.column(g), dtype=np.float64) * s for g, s in zip(goals, signs, strict=True)], 1)

    def within_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                own = batch.slice(start, BLOCK)
                v = values(own)
                yield own.filter(pa.array(~_dominated(v, v)))

    left = stored(distinct.mapInArrow(within_batches, distinct.schema), "front")
    spread = left.agg(*[F.struct(F.min(g).alias("low"), F.max(g).alias("high")).alias(g) for g in goals]).first()
    scale = lambda g, s: (F.col(g) - spread[g].low) * s / ((spread[g].high - spread[g].low) or 1)
    score = sum((scale(g, s) for g, s in zip(goals, signs, strict=True)), F.lit(0.0)) if spread[goals[0]].low is not None else F.lit(0.0)
    champions = values(left.orderBy(F.desc(score), *goals).limit(CHAMPIONS).toArrow())

    def by_champions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_dominated(values(batch), judges.value)))

    judges = spark.sparkContext.broadcast(champions)
    left = stored(left.mapInArrow(by_champions, left.schema), "front")
    blocks = max(1, -(-left.count() // BLOCK))
    block = F.pmod(F.xxhash64(*goals), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    judged = left.select(*goals, block.alias("i"), every.alias("j"), F.lit(False).alias("judge"))
    judging = left.select(*goals, every.alias("i"), block.alias("j"), F.lit(True).alias("judge"))

    def judge(group: pa.Table) -> pa.Table:
        role = np.array(group.column("judge"))
        v = values(group)
        own = group.select(goals).filter(pa.array(~role))
        return own.filter(pa.array(_dominated(v[~role], v[role])))

    beaten = judged.unionByName(judging).groupBy("i", "j").applyInArrow(judge, left.schema)
    return left.join(beaten.distinct(), goals, "left_anti")


def paired_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """A/B pairs by key: both values and delta (b - a), or why a pair is dropped: "missing_a", "missing_b", "null_value"."""
    x = a.select(F.col(key), F.col(value).alias("a"), F.lit(True).alias("has_a"))
    y = b.select(F.col(key), F.col(value).alias("b"), F.lit(True).alias("has_b"))
    reason = F.when(F.col("has_a").isNull(), "missing_a").when(F.col("has_b").isNull(), "missing_b").when(F.col("a").isNull() | F.col("b").isNull(), "null_value")
    return x.join(y, key, "full_outer").select(key, "a", "b", (F.col("b") - F.col("a")).alias("delta"), reason.alias("dropped"))


def reconcile(ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """Both sides of each key with status: match, differs, only_ours, only_theirs."""
    x = ours.select(F.col(key), F.col(value).alias("ours"), F.lit(True).alias("has_ours"))
    y = theirs.select(F.col(key), F.col(value).alias("theirs"), F.lit(True).alias("has_theirs"))
    status = F.when(F.col("has_theirs").isNull(), "only_ours").when(F.col("has_ours").isNull(), "only_theirs").when(F.col("ours").eqNullSafe(F.col("theirs")), "match").otherwise("differs")
    return x.join(y, key, "full_outer").select(key, "ours", "theirs", status.alias("status"))
