"""What the operators of this subpackage share: the shared folder, row keys and Arrow batches."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import shared_dir

#: Rows with a null id count as one document that sorts before all others.
NULL_ID = -(2**63)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _CleanUp:
    """Shuffle files of a write go when it is over. Writes of several threads share the setting: the first one sets it,
    the last one puts it back."""

    def __init__(self):
        self.lock, self.users, self.before = threading.Lock(), {}, {}

    def enter(self, spark: SparkSession) -> None:
        key = spark.sparkContext.applicationId, id(spark._jsparkSession)
        with self.lock:
            if not self.users.get(key):
                self.before[key] = spark.conf.get(CLEANUP, "false")
                spark.conf.set(CLEANUP, "true")
            self.users[key] = self.users.get(key, 0) + 1

    def leave(self, spark: SparkSession) -> None:
        key = spark.sparkContext.applicationId, id(spark._jsparkSession)
        with self.lock:
            self.users[key] -= 1
            if not self.users[key]:
                spark.conf.set(CLEANUP, self.before.pop(key))


_clean_up = _CleanUp()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom-{name}-{uuid.uuid4().hex}"
    _clean_up.enter(spark)
    try:
        df.write.parquet(path)
    finally:
        _clean_up.leave(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes a table that written() gave and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with a number where df has a column of that name (in any case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        k = 0
        while (own := f"{name}_{k}" if k else name).lower() in have:
            k += 1
        have.add(own.lower())
        out.append(own)
    return out


def id_key(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(NULL_ID))


def sample_window(text: Column, by: Column, chars: int) -> Column:
    """The text, or of one longer than chars a stretch of so many characters, drawn by a hash of by."""
    start = F.pmod(F.xxhash64(by), F.length(text) - chars + 1).cast("int") + 1
    return F.when(F.length(text) <= chars, text).otherwise(F.substring(text, start, F.lit(chars)))


def schema_with(df: DataFrame, **added: T.DataType) -> T.StructType:
    """df's schema, with added columns at the end; a clashing old column gives way."""
    lower = {k.lower() for k in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in lower]
    return T.StructType(kept + [T.StructField(k, t, True) for k, t in added.items()])


def put(batch: pa.RecordBatch, schema: T.StructType, **values: pa.Array) -> pa.RecordBatch:
    """The batch with the given columns set, in schema's order."""
    have = dict(zip(batch.schema.names, batch.columns, strict=True))
    return pa.RecordBatch.from_arrays([values[f.name] if f.name in values else have[f.name] for f in schema.fields], names=schema.names)


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about most_bytes of text (one long text may be a slice of its own).

    A worker lives on after its task, so what Arrow holds in reserve is given back at the end.
    """
    for batch in batches:
        lengths = batch.column(text)
        start = size = 0
        for i, n in enumerate(_byte_lengths(lengths)):
            if size and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch, lengths
    pa.default_memory_pool().release_unused()


def _byte_lengths(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key; rows come sorted by keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = np.stack([np.array(batch.column(k)).astype(np.int64) for k in keys], 1)
        cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e <= s:
                continue
            if held and tuple(columns[s]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(columns[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)
