"""Near duplicates among embeddings: sign hashes in several tables, exact cosines, components.

Random hyperplanes give each vector one code a table; vectors of one label, length and code
share a bucket. Equal vectors collapse first, to one representative with their number, over
hashes of 128 bits alone. Then each representative is read once more, as 32-bit floats where
the column has them, and dealt to its bucket in each table: that is all the vectors that
travel. Buckets are meant to hold about BUCKET_VECTORS, so that few bits and tables are
enough; one of more than BLOCK is cut into blocks, and each pair of blocks is a group of its
own, so no task holds more than two blocks at once. A group's cosines are matrix products
in double precision, a strip at a time. A pair that shares several tables counts in the
first of them only, so links are summed without listing pairs; groups pass on each vector's
number of links and the least id of its component within the group.

The number of bits follows from the largest label's number of vectors, the number of tables
from the chance that two vectors at the threshold share a code, so that RECALL of them meet;
pairs above the threshold meet more often. Probing further buckets of a table would send a
vector as often as another table does, for less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import NULL_ID, id_key, partitions, runs, written

BLOCK = 4096
RECALL = 0.97
BUCKET_VECTORS = 2048
STRIP = 512
SEED = 7
#: The number of oversize buckets that are sent to every task; more are joined.
FEW_BUCKETS = 100_000


def plan_tables(largest: int, threshold: float) -> tuple[int, int]:
    """Bits of a code and number of tables."""
    bits = min(30, max(2, math.ceil(math.log2(max(1, largest) / BUCKET_VECTORS))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))


def _codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    planes = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(2).astype(np.int32)


def _coded(bits: int, tables: int, vector: bool):
    """A row for each vector and table: its bucket, and with vector the vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = np.array(batch.column("dim"))
            for d in np.unique(dim):
                own = batch.filter(pa.array(dim == d))
                flat = own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, d)
                codes = _codes(flat.astype(np.float64), bits, tables)
                n = own.num_rows
                columns = [(c, own.column(c)) for c in ("label_id", "dim", "h1", "h2", "rep", "m") if c in own.schema.names]
                if vector:
                    columns += [("codes", pa.array([c.tobytes() for c in codes], pa.binary())), ("raw", pa.array([v.tobytes() for v in np.ascontiguousarray(flat)], pa.binary()))]
                for t in range(tables):
                    both = [*columns, ("t", pa.array(np.full(n, t, np.int32))), ("code", pa.array(codes[:, t].copy()))]
                    yield pa.RecordBatch.from_arrays([v for _, v in both], names=[k for k, _ in both])

    return run


def _local_roots(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id in each vector's component, over links i - j."""
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (root == before).all():
            return root


def _links(v: np.ndarray, w: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of v, j of w; without w: i < j of v) of cosine >= threshold, a strip of v at a time."""
    for s in range(0, len(v), STRIP):
        own = v[s : s + STRIP]
        i, j = np.nonzero(own @ (v[s:] if w is None else w).T >= threshold)
        if w is None:
            i, j = i[j > i], j[j > i] + s
        yield i + s, j


def _compare(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "i", "j"]):
            h = np.stack([np.array(group.column("h1")), np.array(group.column("h2"))], 1)
            _, one = np.unique(h, axis=0, return_index=True)  # rows that repeat an id and a vector
            if len(one) < 2:
                continue
            group = group.take(pa.array(one))
            d, t = group.column("dim")[0].as_py(), group.column("t")[0].as_py()
            v = np.frombuffer(b"".join(group.column("raw").to_pylist()), dtype=kind).reshape(-1, d).astype(np.float64)
            v /= np.abs(v).max(1, keepdims=True)
            v /= np.sqrt((v * v).sum(1))[:, None]
            codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), dtype=np.int32).reshape(len(v), -1)
            ids, m = np.array(group.column("rep")), np.array(group.column("m"))
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            a, b = (np.flatnonzero(np.array(group.column("block")) == x) for x in (i, j))
            n, root = np.zeros(len(v), dtype=np.int64), ids.copy()
            links = []
            for x, y in _links(v[a], None if i == j else v[b], threshold):
                x, y = a[x], b[y]
                own = ~(codes[x, :t] == codes[y, :t]).any(1)
                np.add.at(n, x[own], m[y[own]])
                np.add.at(n, y[own], m[x[own]])
                links.append(_spanning(x, y, len(v)))
            if links:
                root = _local_roots(*np.concatenate(links, axis=1), ids)
            out = (n > 0) | (root != ids)
            if out.any():
                at = pa.array(np.flatnonzero(out))
                yield pa.RecordBatch.from_arrays([*(group.column(c).take(at).combine_chunks() for c in ("h1", "h2", "rep")), pa.array(n[out]), pa.array(root[out])], names=["h1", "h2", "rep", "n", "root"])

    return run


def _spanning(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """As few links (at most n) with the same components."""
    if len(x) <= n:
        return np.stack([x, y])
    root = _local_roots(x, y, np.arange(n))
    at = np.flatnonzero(root != np.arange(n))
    return np.stack([at, root[at]])


def _identity(label: str, vector: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), label, vector), F.xxhash64(F.lit(2), label, vector)


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    n_links counts the other rows found with cosine >= threshold among those of an equal label;
    component_id is the least id reachable by such links, and kept says that it is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components, and vectors without
    a label or of different lengths, link with nothing. Null ids count as one before all others;
    vectors that share an id share its component.
    """
    floats = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), True) or vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), False)
    v = F.col(f"`{vector_col}`") if floats else F.col(f"`{vector_col}`").cast("array<double>")
    good = F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select(id_key(id_col).alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("v")).withColumn("good", good)
    h1, h2 = _identity("label", F.col("v"))
    rows = rows.withColumns({"h1": F.when(F.col("good"), h1), "h2": F.when(F.col("good"), h2)})
    classes = written(rows.where("good").groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "vectors")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(largest, threshold)

    known = rows.where("good").join(classes.drop("label").withColumnsRenamed({"h1": "k1", "h2": "k2"}), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("id") == F.col("rep")))
    reps = known.select(F.xxhash64("label").alias("label_id"), F.size("v").alias("dim"), "v", "h1", "h2", "rep", "m")
    bucket = F.xxhash64("label_id", "dim", "t", "code").alias("key")
    sizes = reps.select("label_id", "dim", "v").mapInArrow(_coded(bits, tables, False), "label_id long, dim int, t int, code int").groupBy(bucket).agg(F.count("*").alias("size"))
    sizes = written(sizes.where(F.col("size") > BLOCK).select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "large-buckets")
    small = F.broadcast if sizes.count() <= FEW_BUCKETS else lambda df: df
    dealt = reps.mapInArrow(_coded(bits, tables, True), "label_id long, dim int, h1 long, h2 long, rep long, m long, codes binary, raw binary, t int, code int")
    groups = (
        dealt.select(bucket, "dim", "t", "h1", "h2", "rep", "m", "codes", "raw")
        .join(small(sizes), "key", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod("h1", F.col("blocks")).cast("int"))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "dim", "t", "h1", "h2", "rep", "m", "codes", "raw")
    )
    kind = "<f4" if floats else "<f8"
    compared = groups.repartition(partitions(vectors), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(threshold, kind), "h1 long, h2 long, rep long, n long, root long")
    found = written(compared, "cosines")
    links = found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = classes.join(links, ["h1", "h2"], "left").join(comp, "rep", "left").select("h1", "h2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    own = lambda c: F.when(F.col(c) != F.lit(NULL_ID), F.col(c))
    out = rows.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component")).select(
        own("id").alias(id_col), "n_links", own("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )
