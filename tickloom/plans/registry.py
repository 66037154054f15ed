"""Where queries register, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (t) -> DataFrame under its name; t(name) reads a table of the given folder."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Ticks and bars in SQL, for queries to start from.
TICKS = "ticks AS (SELECT event_type AS symbol, ts, event_id AS id, value AS price FROM events)"


def bars_sql(width: str = "hour", name: str = "bars") -> str:
    return f"""{name} AS (
        SELECT event_type AS symbol, CAST(date_trunc('{width}', ts) AS TIMESTAMP) AS time, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
               min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS tick_volume
        FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""


def stream_query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame that opens its own stream."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
