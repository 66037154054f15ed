"""Streams run over all of a table, and what is stored and read back.

A stream of files wants a folder or a pattern, so tables are named by patterns that only they fit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import simulation
from tickloom.plans.registry import bars_sql, query, stream_query
from tickloom.plans.select_queries import hour_bars
from tickloom.plans.simulation_queries import CURVE_SQL, FIXED_SQL, PNL_SQL, TAKEN_SQL, all_trades, taken
from tickloom.session import shared_dir
from tickloom.sources import catalog
from tickloom.streaming import streams as ST


@stream_query(f"WITH {bars_sql()} SELECT * FROM bars WHERE time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def streaming_bars(spark, sf_dir):
    """Bars that the stream has emitted: all but those still open at the last watermark."""
    return ST.run_available(ST.streaming_bars(ST.tick_stream(spark, f"{sf_dir}/events.parque[t]")), "append", "bars").drop("batch")


@stream_query("""
    WITH t AS (SELECT event_type AS symbol, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT symbol, round(sum((CASE WHEN i = 1 THEN 1 ELSE 0.1::DOUBLE END) * x * pow(0.9::DOUBLE, n - i)), 6) AS ema, any_value(n) AS n FROM t GROUP BY symbol
""")
def streaming_ema(spark, sf_dir):
    out = ST.run_available(ST.streaming_ema(ST.tick_stream(spark, f"{sf_dir}/events.parque[t]"), 0.1), "update", "ema")
    return out.groupBy("symbol").agg(F.round(F.max_by("ema", "batch"), 6).alias("ema"), F.max("n").alias("n"))


@stream_query("""
    WITH e AS (SELECT user_id::VARCHAR AS producer, strftime(ts, '%Y-%m-%d') AS epoch, event_id AS seq FROM events),
    l AS (SELECT *, lag(epoch) OVER w AS pe, lag(seq) OVER w AS ps FROM e WINDOW w AS (PARTITION BY producer ORDER BY epoch, seq)),
    s AS (SELECT producer, epoch, seq, CASE WHEN pe <> epoch THEN 'epoch_changed' WHEN seq <= ps THEN 'duplicate' WHEN seq > ps + 1 THEN 'gap' END AS signal FROM l)
    SELECT * FROM s WHERE signal IS NOT NULL
""")
def stream_signals(spark, sf_dir):
    t = ST.tick_stream(spark, f"{sf_dir}/events.parque[t]")
    s = t.select(F.col("user_id").cast("string").alias("producer"), F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd").alias("epoch"), F.col("id").alias("seq"))
    return ST.run_signals(s, f"{shared_dir(spark)}/tickloom-signals-{uuid.uuid4().hex}").drop("batch")


@query("""
    WITH e AS (SELECT event_type AS topic, strftime(ts, '%Y-%m-%d') AS epoch, event_id AS seq, user_id::VARCHAR AS consumer FROM events),
    c AS (SELECT consumer, topic, max(epoch) AS epoch, arg_max(seq, (epoch, seq)) AS seq FROM e GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY epoch DESC, seq DESC) AS recency FROM e),
    h AS (SELECT topic, max(epoch) AS epoch, max(seq) FILTER (recency = 1) AS head FROM r GROUP BY 1),
    o AS (SELECT r.topic, min(r.seq) AS oldest FROM r JOIN h ON h.topic = r.topic AND h.epoch = r.epoch WHERE recency <= 200 GROUP BY 1),
    s AS (SELECT c.consumer, c.topic, CASE WHEN c.epoch <> h.epoch THEN 'epoch_changed' WHEN c.seq + 1 < oldest THEN 'cursor_expired' WHEN head - c.seq > 100 THEN 'lagging' END AS signal,
                 c.epoch AS previous_epoch, h.epoch AS new_epoch, c.seq AS cursor FROM c JOIN h USING (topic) JOIN o USING (topic))
    SELECT consumer, topic, signal, CASE WHEN signal = 'epoch_changed' THEN previous_epoch END AS previous_epoch, CASE WHEN signal = 'epoch_changed' THEN new_epoch END AS new_epoch,
           CASE WHEN signal = 'cursor_expired' THEN cursor::VARCHAR END AS cursor, CASE WHEN signal = 'lagging' THEN cursor + 1 END AS from_seq FROM s WHERE signal IS NOT NULL
""")
def cursor_signals(t):
    """What each consumer's last position in a topic means, with the 200 newest messages of a topic's epoch retained."""
    sent = t("events").select(F.col("event_type").alias("topic"), F.date_format("ts", "yyyy-MM-dd").alias("epoch"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("consumer"))
    last = F.max(F.struct("epoch", "seq")).alias("at")
    cursors = sent.groupBy("consumer", "topic").agg(last).select("consumer", "topic", "at.epoch", "at.seq")
    return ST.cursor_signals(sent.select("topic", "epoch", "seq"), cursors, retained=200, lag=100)


@stream_query(f"""
    WITH {bars_sql()}, b AS (SELECT * FROM bars WHERE time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)
    SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 24
""")
def stream_window(spark, sf_dir):
    """The last 24 bars of each symbol that the stream has emitted."""
    bars = ST.streaming_bars(ST.tick_stream(spark, f"{sf_dir}/events.parque[t]"))
    return ST.run_window(bars, 24, f"{shared_dir(spark)}/tickloom-window-{uuid.uuid4().hex}")


def envelopes(t):
    e = t("events")
    payload = F.to_json(F.struct("value", "props"))
    return e.select(
        F.to_json(
            F.struct(
                F.col("event_type").alias("topic"), F.date_format("ts", "yyyy-MM-dd").alias("epoch"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("producer_id"),
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("origin_ts"), F.lit("tick").alias("payload_kind"), F.lit(1).alias("schema_major"), payload.alias("payload"), F.lit("x").alias("unknown"),
            )
        ).alias("value")
    )


@query("SELECT event_type AS topic, strftime(ts, '%Y-%m-%d') AS epoch, event_id AS seq, user_id::VARCHAR AS producer_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS origin_ts, CAST(1 AS BIGINT) AS schema_major FROM events")
def envelope_decode(t):
    return ST.decode_envelopes(envelopes(t)).select("topic", "epoch", "seq", "producer_id", "origin_ts", "schema_major")


@query("SELECT event_type AS topic, event_id AS seq FROM events WHERE event_type IN ('click', 'error')")
def topic_subscription(t):
    return ST.subscribed(ST.decode_envelopes(envelopes(t)), ["click", "error"]).select("topic", "seq")


@query("""
    WITH d AS (SELECT DISTINCT user_id AS producer, date_trunc('day', ts)::DATE AS epoch, event_id AS seq FROM events),
    l AS (SELECT *, seq - lag(seq) OVER (PARTITION BY producer, epoch ORDER BY seq) - 1 AS missing FROM d) SELECT * FROM l WHERE missing > 0
""")
def seq_gaps(t):
    rows = t("events").select(F.col("user_id").alias("producer"), F.to_date("ts").alias("epoch"), F.col("event_id").alias("seq"))
    return ST.sequence_gaps(rows.unionAll(rows.where("seq % 10 = 0")))  # as delivered more than once


@stream_query("SELECT event_type AS topic, strftime(ts, '%Y-%m-%d') AS epoch, event_id AS seq, user_id::VARCHAR AS producer_id FROM events WHERE event_type IN ('purchase', 'signup')")
def topic_stream(spark, sf_dir):
    """Some topics of a message log, as a stream: the log is written first."""
    path = _folder(spark)
    envelopes(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")).write.text(path)
    out = ST.topic_stream(spark, {"path": path}, ["purchase", "signup"])
    return ST.run_available(out, "append", "topics").select("topic", "epoch", "seq", "producer_id")


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/tickloom-series-{uuid.uuid4().hex}"


BAR_FILES = "time timestamp_ntz, open double, high double, low double, close double, tick_volume bigint, symbol string"


@query(f"WITH {bars_sql()} SELECT * FROM bars WHERE symbol IN ('click', 'view') AND time >= TIMESTAMP '2024-01-03' AND time < TIMESTAMP '2024-01-20'")
def ingest_series(t):
    """Ticks of some symbols and days to stored bars, read back by path and schema."""
    rows = hour_bars(t).where("symbol IN ('click', 'view') AND time >= TIMESTAMP_NTZ '2024-01-03' AND time < TIMESTAMP_NTZ '2024-01-20'")
    spark, path = rows.sparkSession, _folder(rows.sparkSession)
    catalog.write_series(rows, path)
    return catalog.read_files(spark, [path], BAR_FILES)


@query(f"WITH {bars_sql('day')} SELECT * FROM bars WHERE symbol NOT IN ('error', 'view')")
def delete_series(t):
    rows = B.resample(hour_bars(t), "day")
    spark, path = rows.sparkSession, _folder(rows.sparkSession)
    catalog.write_series(rows, path)
    files = catalog.delete_series(catalog.series_files(spark, path, BAR_FILES), ["error", "view"])
    return catalog.read_series(spark, path, files, BAR_FILES)


@query(f"WITH {bars_sql()} SELECT * FROM bars")
def arrow_ipc(t):
    """Bars as Arrow IPC streams and back."""
    rows = hour_bars(t)
    return catalog.from_ipc(catalog.to_ipc(rows), rows.schema)


@query(f"WITH {FIXED_SQL} SELECT symbol, s, exit_time, reason, round(exit_price, 6) AS exit_price FROM trades")
def run_artifacts(t):
    """A run's trades as stored and read again."""
    rows = all_trades(t).select("symbol", "s", "exit_time", "reason", F.round("exit_price", 6).alias("exit_price"))
    path = _folder(rows.sparkSession)
    rows.write.parquet(path)
    return catalog.read_files(rows.sparkSession, [path], rows.schema)


@query(f"WITH RECURSIVE {FIXED_SQL}, {TAKEN_SQL}, {PNL_SQL}, {CURVE_SQL} SELECT symbol, exit_time AS time, round(equity, 6) AS equity FROM curve")
def run_equity(t):
    """A run's equity points as stored and read again."""
    rows = simulation.equity_curve(taken(t), "symbol", ["s"], 1000.0).select("symbol", F.col("exit_time").alias("time"), F.round("equity", 6).alias("equity"))
    path = _folder(rows.sparkSession)
    rows.write.parquet(path)
    return catalog.read_files(rows.sparkSession, [path], rows.schema)
