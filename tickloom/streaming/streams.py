"""Structured Streaming: bars, recursive indicators and sequence signals, equal to their batch forms."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.expressions import order_key
from tickloom.operators.bars import last_n
from tickloom.schemas import ENVELOPE, EVENTS
from tickloom.session import shared_dir
from tickloom.sources.catalog import stored

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Off while a stream starts: what follows sorts ticks inside a micro-batch, which the check cannot tell from sorting a stream.
OPERATION_CHECK = ("spark.sql.streaming.unsupportedOperationCheck", "false")
#: Ticks of a chunk at most, and those that a chunk hands on one by one.
CHUNK, FEW = 4096, 64
#: Width of a chunk of sequence numbers.
SEQ_SPAN = 1 << 16


def tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """Ticks as a stream of Parquet files; times get the session's zone, since watermarks need one."""
    events = spark.readStream.schema(EVENTS).parquet(path)
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"), "user_id")


def streaming_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a tick stream. In append mode a bar is emitted once the watermark passes its end; later ticks are dropped."""
    key = order_key(F.col("ts").cast("timestamp_ntz"), F.col("id"))
    bars = (
        ticks.where(F.col("price").isNotNull())
        .withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width))
        .agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.count("*").alias("tick_volume"))
    )
    return bars.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "tick_volume")


def _ema_chunks(alpha: float):
    """Of ticks sorted by symbol and time, one row for each chunk of at most CHUNK ticks of a symbol's hour: how many they
    are, the first price, their weighted sum, and up to FEW of them as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            symbol, hour = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("symbol", "hour"))
            price = batch.column("price").to_numpy(zero_copy_only=False)
            new = np.flatnonzero((symbol[1:] != symbol[:-1]) | (hour[1:] != hour[:-1])) + 1
            cuts = [0, *new.tolist(), batch.num_rows]
            starts = np.concatenate([np.arange(s, e, CHUNK) for s, e in zip(cuts, cuts[1:], strict=False)])
            ends = np.append(starts[1:], batch.num_rows)
            prices = [price[s:e] for s, e in zip(starts, ends, strict=True)]
            local = [float(alpha * x @ (1 - alpha) ** np.arange(len(x) - 1.0, -1.0, -1.0)) for x in prices]
            first = batch.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays(
                [first.column("symbol"), first.column("ts"), first.column("id"), pa.array(np.arange(part, part + len(starts))), pa.array(ends - starts), first.column("price"), pa.array(local, pa.float64()), pa.array([x if len(x) <= FEW else None for x in prices], pa.list_(pa.float64()))],
                names=["symbol", "ts", "id", "part", "n", "first", "local", "prices"],
            )
            part += len(starts)

    return run


class Ema(StatefulProcessor):
    """The exponential average of each symbol's prices, from its chunks; the state is its last value, and the number of
    prices so far."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        value, n = (state[0], state[1]) if state else (0.0, 0)
        chunks = pd.concat(list(rows)).sort_values(["ts", "id", "part"])
        for size, first, local, prices in chunks[["n", "first", "local", "prices"]].itertuples(index=False):
            if prices is None:
                value = local + (1 - self.alpha) ** int(size) * (value if n else first)
                n += int(size)
                continue
            for x in prices:
                value = next_ema(value, n, float(x), self.alpha)
                n += 1
        self.last.update((float(value), n))
        yield pd.DataFrame({"symbol": [key[0]], "ema": [value], "n": [n]})

    def close(self) -> None:
        pass


def next_ema(value: float, n: int, x: float, alpha: float) -> float:
    """The one transition that batch folds and the stream share."""
    return x if n == 0 else alpha * x + (1 - alpha) * value


def streaming_ema(ticks: DataFrame, alpha: float) -> DataFrame:
    """(symbol, ema, n) after each micro-batch that has prices of the symbol. Ticks must arrive in time order from batch to
    batch; within one they are sorted. Start it under rocks_state.

    Tasks sort and sum the hours of a symbol, holding a chunk at a time; the state step takes a row a chunk."""
    hours = ticks.where(F.col("price").isNotNull() & ~F.isnan("price")).select("symbol", "ts", "id", "price", F.floor(F.unix_micros("ts") / 3_600_000_000).alias("hour"))
    hours = hours.withColumn("hour", F.coalesce("hour", F.lit(-(2**63))))
    dealt = hours.repartition("symbol", "hour").sortWithinPartitions("symbol", "hour", F.asc_nulls_last("ts"), F.asc_nulls_last("id"))
    chunks = dealt.mapInArrow(_ema_chunks(alpha), "symbol string, ts timestamp, id long, part long, n long, first double, local double, prices array<double>")
    return chunks.groupBy("symbol").transformWithStateInPandas(Ema(alpha), "symbol string, ema double, n long", "Update", "None")


SIGNAL = "producer string, epoch string, seq long, signal string"
LAST = "producer string, epoch string, seq long"


def sequence_signals(rows: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals of each producer's (epoch, seq) in a micro-batch: epoch_changed resets the sequence, gap has missing numbers,
    duplicate is an old number again. rows: producer, epoch, seq, in order from batch to batch (within one they are
    sorted); last: each producer's last (epoch, seq) so far. Gives the signals, and the last ones after the batch.

    Numbers meet the ones before them in chunks of SEQ_SPAN numbers of an epoch; only a row a chunk is sorted by producer."""
    rows = rows.withColumn("chunk", F.floor(F.col("seq") / SEQ_SPAN))
    chunks = rows.groupBy("producer", "epoch", "chunk").agg(F.max("seq").alias("high"))
    before = last.select(F.col("producer").alias("p"), F.col("epoch").alias("last_epoch"), F.col("seq").alias("last_seq"))
    w = Window.partitionBy("producer").orderBy(F.asc_nulls_last("epoch"), F.asc_nulls_last("chunk"))
    chunks = chunks.join(before, F.col("producer").eqNullSafe(F.col("p")), "left").withColumn("at", F.row_number().over(w))
    # what stands before a chunk: the chunk before it, or the state
    chunks = chunks.withColumns({"from_epoch": F.when(F.col("at") > 1, F.lag("epoch").over(w)).otherwise(F.col("last_epoch")), "from_seq": F.when(F.col("at") > 1, F.lag("high").over(w)).otherwise(F.col("last_seq"))})
    # an epoch that goes on may still be below the state's number
    going_on = F.col("last_epoch") == F.first("epoch").over(w)
    held = F.when(going_on & F.col("epoch").eqNullSafe(F.col("last_epoch")), F.col("last_seq"))
    chunks = stored(chunks.select("producer", "epoch", "chunk", "high", "from_epoch", F.greatest("from_seq", held).alias("from_seq"), held.alias("held")), "chunks")
    side = chunks.select(*(F.col(c).alias(f"c_{c}") for c in ("producer", "epoch", "chunk")), "from_epoch", "from_seq", "held")
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in ("producer", "epoch", "chunk")]
    own = Window.partitionBy("producer", "epoch", "chunk").orderBy("seq")
    seen = rows.withColumns({"i": F.row_number().over(own), "prev": F.lag("seq").over(own)}).join(side, same)
    inside = (F.col("i") > 1) | F.col("from_epoch").eqNullSafe(F.col("epoch"))
    floor = F.when(F.col("i") > 1, F.greatest("prev", "held")).otherwise(F.col("from_seq"))
    kind = F.when(~inside & F.col("from_epoch").isNotNull(), "epoch_changed").when(inside & (F.col("seq") <= floor), "duplicate").when(inside & (F.col("seq") > floor + 1), "gap")
    signals = seen.select("producer", "epoch", "seq", kind.alias("signal")).where("signal IS NOT NULL")
    rank = F.struct(F.col("epoch").isNull().alias("none"), "epoch", F.greatest("high", "held").alias("seq"))
    now = chunks.groupBy("producer").agg(F.max(rank).alias("now"))
    old = before.join(now, F.col("p").eqNullSafe(F.col("producer")), "left_anti").select(F.col("p").alias("producer"), F.col("last_epoch").alias("epoch"), F.col("last_seq").alias("seq"))
    return signals, old.unionAll(now.select("producer", "now.epoch", "now.seq"))


def run_signals(stream: DataFrame, top: str) -> DataFrame:
    """Runs sequence_signals over all that is there of stream (producer, epoch, seq) and reads all signals in top so far.

    A micro-batch reads the last numbers that the one before it wrote, so one that is done again gives the same."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        last = session.read.schema(LAST).parquet(f"{top}/last/batch={number - 1}") if number else session.createDataFrame([], LAST)
        signals, now = sequence_signals(batch, last)
        signals.write.mode("overwrite").parquet(f"{top}/out/batch={number}")
        now.write.mode("overwrite").parquet(f"{top}/last/batch={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{SIGNAL}, batch int").parquet(f"{top}/out")


def run_window(bars: DataFrame, n: int, top: str) -> DataFrame:
    """Runs a stream of bars over all that is there and reads each symbol's last n: what a bounded buffer holds.

    A micro-batch adds its bars to the window that the one before it wrote, and only n rows of a symbol go on from any
    task, so no state grows with the stream. A batch that is done again gives the same."""
    spark = bars.sparkSession
    schema = bars.schema

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        held = session.read.schema(schema).parquet(f"{top}/window/batch={number - 1}") if number else session.createDataFrame([], schema)
        kept = last_n(held.unionByName(batch), n, ["symbol"], [F.desc("time")]).drop("recency")
        kept.write.mode("overwrite").parquet(f"{top}/window/batch={number}")

    query = bars.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.lastProgress
    if progress is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{top}/window/batch={progress['batchId']}")


def cursor_signals(sent: DataFrame, cursors: DataFrame, retained: int, lag: int) -> DataFrame:
    """What a subscriber is told who comes back at a cursor: (consumer, topic, signal, previous_epoch, new_epoch, cursor,
    from_seq). sent: topic, epoch, seq; cursors: consumer, topic, epoch, seq, the last message taken.

    epoch_changed: the topic's newest message is of another epoch. cursor_expired: of the topic's `retained` newest
    messages those of its epoch start after the one that follows the cursor. lagging: more than `lag` numbers behind
    the head; from_seq is where to go on. Others, and cursors of topics without messages, get none. A null topic is a
    topic; null epochs and numbers are no messages, and no cursors."""
    newest = last_n(sent.dropna(subset=["epoch", "seq"]), retained, ["topic"], [F.desc("epoch"), F.desc("seq")])
    head = F.max(F.struct("epoch", "seq"))
    held = newest.withColumn("of", F.max("epoch").over(Window.partitionBy("topic"))).groupBy(F.col("topic").alias("t")).agg(head.alias("head"), F.min(F.when(F.col("epoch") == F.col("of"), F.col("seq"))).alias("oldest"))
    at = cursors.dropna(subset=["epoch", "seq"]).join(held, F.col("topic").eqNullSafe(F.col("t")))
    kind = F.when(F.col("epoch") != F.col("head.epoch"), "epoch_changed").when(F.col("seq") + 1 < F.col("oldest"), "cursor_expired").when(F.col("head.seq") - F.col("seq") > lag, "lagging")
    told = lambda name, value: F.when(F.col("signal") == name, value)
    return at.withColumn("signal", kind).where("signal IS NOT NULL").select(
        "consumer", "topic", "signal", told("epoch_changed", F.col("epoch")).alias("previous_epoch"), told("epoch_changed", F.col("head.epoch")).alias("new_epoch"),
        told("cursor_expired", F.col("seq").cast("string")).alias("cursor"), told("lagging", F.col("seq") + 1).alias("from_seq"),
    )


def decode_envelopes(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON envelopes to columns; unknown fields are ignored, text that is no envelope gives nulls."""
    return raw.select(F.from_json(F.col(column), ENVELOPE).alias("e")).select("e.*")


def topic_stream(spark: SparkSession, options: dict[str, str], topics: list[str], source: str = "text") -> DataFrame:
    """The decoded envelopes of some topics from a message source whose value column holds their JSON: by default a
    folder of logs with a message on each line; with source="kafka" (its connector must be there) a broker."""
    raw = spark.readStream.format(source).options(**options).load()
    return subscribed(decode_envelopes(raw.select(F.col("value").cast("string").alias("value"))), topics)


def subscribed(envelopes: DataFrame, topics: list[str]) -> DataFrame:
    return envelopes.where(F.col("topic").isin(topics))


def sequence_gaps(rows: DataFrame) -> DataFrame:
    """Batch form: after dropping repeats of (producer, epoch, seq), the numbers missing before each row of its epoch."""
    w = Window.partitionBy("producer", "epoch").orderBy("seq")
    return rows.dropDuplicates(["producer", "epoch", "seq"]).withColumn("missing", F.col("seq") - F.lag("seq").over(w) - 1).where("missing > 0")


def run_available(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is there, to Parquet in the shared folder, and reads what it wrote."""
    spark = stream.sparkSession
    top = f"{shared_dir(spark)}/tickloom-{name}-{uuid.uuid4().hex}"
    with rocks_state(spark):

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{top}/out/batch={number}")

        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{top}/out")


@contextlib.contextmanager
def rocks_state(spark: SparkSession):
    """Settings under which the streams of this module start."""
    before = {k: spark.conf.get(k, None) for k, _ in (ROCKS, OPERATION_CHECK)}
    for k, v in (ROCKS, OPERATION_CHECK):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
