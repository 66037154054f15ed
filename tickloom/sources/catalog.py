"""Datasets as immutable versions: which one is current, whether its files hold what the manifest says, reading and writing."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import shared_dir


def read_files(spark: SparkSession, files: list[str], schema: T.StructType | str) -> DataFrame:
    """Parquet files by explicit path and schema; nothing is discovered or inferred."""
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files)


def current_versions(manifests: DataFrame) -> DataFrame:
    """Of each dataset the highest version that is not tombstoned and that no live version supersedes."""
    live = manifests.where(F.col("tombstone").isNull())
    replaced = live.where(F.col("supersedes").isNotNull()).select("dataset_id", F.col("supersedes").alias("version")).distinct()
    left = live.join(replaced, ["dataset_id", "version"], "left_anti")
    newest = left.groupBy("dataset_id").agg(F.max("version").alias("version"))
    return left.join(newest, ["dataset_id", "version"], "left_semi")


def validate(manifest: DataFrame, rows: DataFrame, time: str) -> DataFrame:
    """For each manifest the rows found, whether their number is right and whether all lie in its time range."""
    found = rows.groupBy("dataset_id").agg(F.count("*").alias("rows_found"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    n = F.coalesce("rows_found", F.lit(0))
    inside = F.coalesce((F.col("first_time") >= F.col("start")) & (F.col("last_time") <= F.col("end")), F.lit(False))
    return manifest.join(found, "dataset_id", "left").select("dataset_id", "row_count", n.alias("rows_found"), (n == F.col("row_count")).alias("count_ok"), inside.alias("range_ok"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, where its lineage ends."""
    path = f"{shared_dir(df.sparkSession)}/tickloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_series(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A series by symbol folders; with mode "overwrite" only the symbols that rows has are replaced.

    Rows are dealt by ranges of symbol and time, so that a long series is many tasks and files."""
    writer = rows.repartitionByRange("symbol", "time").sortWithinPartitions("symbol", "time").write.mode(mode)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def series_files(spark: SparkSession, path: str, schema: T.StructType | str) -> list[str]:
    """A series' manifest: its files, whose folders name their symbols."""
    return sorted(unquote(f) for f in spark.read.schema(schema).parquet(path).inputFiles())  # they come as URIs


def read_series(spark: SparkSession, path: str, files: list[str], schema: T.StructType | str) -> DataFrame:
    """The rows of a series' version, which is a list of files under path."""
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*files)


def delete_series(files: list[str], symbols: list[str | None]) -> list[str]:
    """The next version of a series without the symbols (None: rows without a symbol): files are immutable, and whole
    symbols go, so the next manifest leaves their files out and nothing is copied."""
    return [f for f in files if _symbol_of(f) not in symbols]


def _symbol_of(file: str) -> str | None:
    name = unquote(re.search("/symbol=([^/]*)/[^/]*$", file).group(1))
    return None if name == "__HIVE_DEFAULT_PARTITION__" else name


def to_arrow(df: DataFrame):
    """A pyarrow.Table of a result that the caller knows to be small."""
    return df.toArrow()


def from_arrow(spark: SparkSession, table) -> DataFrame:
    return spark.createDataFrame(table)


def to_ipc(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Each Arrow batch of rows as an IPC stream in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[column])

    return rows.mapInArrow(run, f"{column} binary")


def from_ipc(payloads: DataFrame, schema: T.StructType | str, column: str = "payload") -> DataFrame:
    """The rows of Arrow IPC streams, by the names and types of schema; nulls and empty payloads hold none."""
    target = payloads.sparkSession.createDataFrame([], schema).schema
    names = target.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(column).to_pylist():
                if payload:
                    for own in pa.ipc.open_stream(payload):
                        yield own.select(names)

    return payloads.select(column).mapInArrow(run, target)
