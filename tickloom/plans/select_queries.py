"""Bars, storage, slices, pages and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import select as S
from tickloom.plans.registry import TICKS, bars_sql, query
from tickloom.sources import catalog


def ticks(t):
    return B.ticks_from_events(t("events"))


def hour_bars(t):
    return B.ohlcv(ticks(t), "hour")


@query(f"WITH {bars_sql()} SELECT * FROM bars")
def bars_1h(t):
    return hour_bars(t)


@query(f"WITH {bars_sql('day')} SELECT * FROM bars")
def bars_1d_resample(t):
    return B.resample(hour_bars(t), "day")


@query("""
    SELECT event_type AS symbol, CAST(time_bucket(INTERVAL '15 minutes', ts) AS TIMESTAMP) AS time, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
           min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS tick_volume
    FROM events WHERE value IS NOT NULL GROUP BY 1, 2
""")
def bars_15m(t):
    return B.ohlcv(ticks(t), "15 minutes")


@query(f"""
    WITH {bars_sql('day')}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS prev_close FROM bars)
    SELECT *, close - prev_close AS change, (close - prev_close) * 100 / nullif(prev_close, 0) AS change_pct FROM p
""")
def day_snapshot(t):
    return B.day_snapshot(ticks(t))


@query(f"WITH {bars_sql()} SELECT symbol, count(*) AS bars, min(time) AS first_time, max(time) AS last_time, CAST(sum(tick_volume) AS BIGINT) AS ticks FROM bars GROUP BY symbol")
def inventory(t):
    return B.inventory(hour_bars(t))


@query("SELECT event_type AS symbol, min(ts) AS available_from, max(ts) AS available_to FROM events GROUP BY 1")
def available_range(t):
    return ticks(t).groupBy("symbol").agg(F.min("ts").alias("available_from"), F.max("ts").alias("available_to"))


@query(f"WITH {TICKS} SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, id DESC) AS recency FROM ticks QUALIFY recency <= 20")
def tape(t):
    return B.tape(ticks(t), 20)


@query(f"WITH {bars_sql()} SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS recency FROM bars QUALIFY recency <= 50")
def last_bars(t):
    return B.last_n(hour_bars(t), 50, ["symbol"], [F.desc("time")])


@query(f"""
    WITH {bars_sql('day')}, n AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY time) - 1) // 20 AS page FROM bars)
    SELECT symbol, page, list(epoch_us(time) ORDER BY time) AS time, list(open ORDER BY time) AS open, list(close ORDER BY time) AS close FROM n GROUP BY symbol, page
""")
def chart_payload(t):
    return B.chart_payload(B.ohlcv(ticks(t), "day"), ["open", "close"], 20)


MANIFESTS = """manifests AS (
    SELECT o_custkey AS dataset_id, o_orderkey AS version, CASE WHEN o_orderstatus = 'P' THEN 'tombstoned' END AS tombstone,
           lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS supersedes, o_totalprice AS size FROM orders)"""


def manifests(t):
    """Orders read as dataset versions: one dataset a customer, each order a version that supersedes the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t("orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "P", "tombstoned").alias("tombstone"),
        F.lag("o_orderkey").over(w).alias("supersedes"), F.col("o_totalprice").alias("size"),
    )


@query(f"""
    WITH {MANIFESTS}, live AS (
        SELECT m.* FROM manifests m WHERE tombstone IS NULL AND NOT EXISTS (
            SELECT 1 FROM manifests s WHERE s.dataset_id = m.dataset_id AND s.supersedes = m.version AND s.tombstone IS NULL))
    SELECT dataset_id, version, size FROM live QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY version DESC) = 1
""")
def dataset_latest(t):
    return catalog.current_versions(manifests(t)).select("dataset_id", "version", "size")


@query("""
    WITH manifest AS (SELECT o_custkey, max(o_orderkey) AS last_order, count(*) + CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS row_count, min(o_orderdate) AS start, max(o_orderdate) AS "end" FROM orders GROUP BY o_custkey),
    actual AS (SELECT o_custkey, count(*) AS rows_found, min(o_orderdate) AS first_time, max(o_orderdate) AS last_time FROM orders WHERE o_custkey % 11 <> 0 GROUP BY o_custkey)
    SELECT m.o_custkey AS dataset_id, m.row_count, coalesce(a.rows_found, 0) AS rows_found,
           coalesce(a.rows_found, 0) = m.row_count AS count_ok, coalesce(a.first_time >= m.start AND a.last_time <= m."end", false) AS range_ok
    FROM manifest m LEFT JOIN actual a ON a.o_custkey = m.o_custkey
""")
def manifest_validation(t):
    """Manifests made from all orders, with a wrong count for each seventh dataset, against files that lack each eleventh."""
    orders = t("orders").select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderdate").alias("time"))
    manifest = orders.groupBy("dataset_id").agg((F.count("*") + F.when(F.col("dataset_id") % 7 == 0, 1).otherwise(0)).alias("row_count"), F.min("time").alias("start"), F.max("time").alias("end"))
    return catalog.validate(manifest, orders.where("dataset_id % 11 <> 0"), "time")


@query("SELECT event_type AS symbol, ts, event_id AS id, value AS price FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def slice_series(t):
    return S.slice_series(ticks(t), ["click", "view"], "2024-01-05", "2024-01-12")


@query("SELECT event_type AS symbol, ts, event_id AS id, value AS price, strftime(ts, '%H:%M:%S') >= '17:25:00' AS closing FROM events WHERE strftime(ts, '%H:%M:%S') >= '09:00:00' AND strftime(ts, '%H:%M:%S') < '17:30:00'")
def session_filter(t):
    return S.session_filter(ticks(t), "09:00:00", "17:30:00", "17:25:00")


@query("SELECT event_id AS id, ts, CAST(event_id % 16 AS BIGINT) AS flags FROM events WHERE (event_id % 16) & 6 <> 0")
def tick_flags(t):
    return S.with_flags(t("events").select(F.col("event_id").alias("id"), "ts", (F.col("event_id") % 16).alias("flags")), 6)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_orders(t):
    return S.page(t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), [F.desc("o_totalprice"), F.col("o_orderkey")], 50, 100)


@query("SELECT count(*) AS total FROM orders")
def page_total(t):
    return t("orders").agg(F.count("*").alias("total"))


@query(f"WITH {bars_sql()} SELECT symbol, time, close, tick_volume FROM bars WHERE (close > open AND tick_volume >= 3) OR (NOT high < 400 AND symbol <> 'error')")
def condition_groups(t):
    tree = {
        "any": [
            {"all": [{"column": "close", "op": ">", "other": "open"}, {"column": "tick_volume", "op": ">=", "value": 3}]},
            {"all": [{"not": {"column": "high", "op": "<", "value": 400}}, {"column": "symbol", "op": "!=", "value": "error"}]},
        ]
    }
    return hour_bars(t).where(S.condition(tree)).select("symbol", "time", "close", "tick_volume")


@query(f"WITH {bars_sql()} SELECT symbol, time, round(CASE WHEN close - open > 0 THEN (close - open) / nullif(high - low, 0) ELSE -abs(close - open) END, 6) + 0.0 AS signal FROM bars")
def expression_graph(t):
    body = {"op": "sub", "inputs": ["close", "open"]}
    graph = {n: {"column": n} for n in ("open", "high", "low", "close")} | {
        "body": body, "range": {"op": "sub", "inputs": ["high", "low"]}, "up": {"op": "div", "inputs": ["body", "range"]},
        "size": {"op": "abs", "inputs": ["body"]}, "down": {"op": "neg", "inputs": ["size"]}, "out": {"op": "if_positive", "inputs": ["body", "up", "down"]},
    }
    return hour_bars(t).select("symbol", "time", F.round(S.compile_graph(graph, "out"), 6).alias("signal"))


@query("SELECT o_orderkey, CAST(try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE printf('%.2f', o_totalprice) END AS DECIMAL(38, 18)) AS VARCHAR) AS amount FROM orders")
def money_strings(t):
    text = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.format_string("%.2f", "o_totalprice"))
    return S.parse_money(t("orders").select("o_orderkey", text.alias("amount")), ["amount"]).withColumn("amount", F.col("amount").cast("string"))


@query("""
    SELECT l_orderkey, l_linenumber, round(floor(l_extendedprice / 0.25::DOUBLE + 0.5::DOUBLE) * 0.25::DOUBLE, 2) AS price,
           greatest(1.0::DOUBLE, least(40.0::DOUBLE, round(floor(l_quantity * (1 - l_discount) / 0.5::DOUBLE + 1e-9::DOUBLE) * 0.5::DOUBLE, 8))) AS volume FROM lineitem
""")
def instrument_rounding(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("volume"))
    return S.round_to_instrument(rows, "price", "volume", 2, 0.25, 0.5, 1.0, 40.0)


@query(f"""
    WITH {bars_sql()}, q AS (SELECT symbol, time, low AS bid, high AS ask, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS prev_close FROM bars)
    SELECT symbol, time, round(ask - bid, 6) AS spread, round((bid + ask) / 2, 6) AS mid, round((bid + ask) / 2 - prev_close, 6) AS change,
           round(((bid + ask) / 2 - prev_close) * 100 / nullif(prev_close, 0), 6) AS change_pct FROM q
""")
def quote_fields(t):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("time")
    quotes = hour_bars(t).select("symbol", "time", F.col("low").alias("bid"), F.col("high").alias("ask"), F.lag("close").over(w).alias("prev_close"))
    return S.quote_fields(quotes).select("symbol", "time", *[F.round(c, 6).alias(c) for c in ("spread", "mid", "change", "change_pct")])


@query("SELECT event_id AS id, CAST(datesub('millisecond', date_trunc('millisecond', ts), TIMESTAMP '2024-02-01') AS BIGINT) AS age_ms FROM events")
def quote_age(t):
    return S.quote_age(t("events").select(F.col("event_id").alias("id"), F.date_trunc("millisecond", "ts").cast("timestamp_ntz").alias("ts")), "2024-02-01").select("id", "age_ms")


@query("""
    SELECT c_custkey AS run_id, c_name AS name, coalesce(n, 0) AS n_results, best AS best_value, label AS best_label
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS best, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS label FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def run_listing(t):
    runs = t("customer").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("name"))
    return S.run_listing(runs, t("orders").select(F.col("o_custkey").alias("run_id"), "o_totalprice", "o_orderkey"), "run_id", "o_totalprice", "o_orderkey")


@query("SELECT event_id, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS field FROM events WHERE event_type IN ('error', 'purchase')")
def event_log(t):
    return S.event_log(t("events"), ["error", "purchase"], "k").select("event_id", "ts", "field")


@query("""
    SELECT p_partkey, list_sort(list_filter([CASE WHEN p_brand IS NULL THEN 'p_brand:missing' END, CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#21') THEN 'p_brand:choice' END,
        CASE WHEN p_retailprice IS NULL THEN 'p_retailprice:missing' END, CASE WHEN p_retailprice > 1500 THEN 'p_retailprice:max' END,
        CASE WHEN p_size IS NULL THEN 'p_size:missing' END, CASE WHEN p_size < 10 THEN 'p_size:min' END, CASE WHEN p_size > 40 THEN 'p_size:max' END], lambda x: x IS NOT NULL)) AS failed
    FROM part
""")
def parameter_violations(t):
    specs = {"p_brand": {"choices": ["Brand#11", "Brand#12", "Brand#21"]}, "p_retailprice": {"max": 1500}, "p_size": {"min": 10, "max": 40}}
    return S.violations(t("part"), specs).select("p_partkey", "failed")
