"""Line dedup over a sharded minimal perfect hash.

1. Each text gives the distinct 128-bit hashes of its line keys (first half: the key's
   place, second half: its fingerprint); two grouped counts, combined before each shuffle,
   give the number of documents of each line and the largest doc_id that holds it.
2. Lines that enough documents hold go to shards by hash. A task builds each shard's
   minimal perfect hash and the arrays it indexes: fingerprints, counts, keepers.
3. Line hashes meet their shard's arrays, not the lines: a probe is a lookup by index and
   a comparison of fingerprints. Shards that hold frequent lines are probed by several
   tasks, each with the probes of some documents, so none gets all probes of one line.
4. What is to go is gathered by document, and documents drop those lines.

Null texts are one empty line. Null ids count as one document before all others; rows
that repeat an id are one document. A document without lines to drop keeps its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import perfect_hash
from .shared import id_key, put, schema_with, slices, unused, written
from .words import SPACES

SHARD_KEYS = 32_768
SHARD_PROBES = 200_000
_HALF = 2**63


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line's key in UTF-8, or None if it is shorter than min_chars code points."""
    key = line.strip(SPACES)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key.lower()  # of bytes: A-Z only


def _halves(key: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(key)
    return (x >> 64) - _HALF, (x & 2**64 - 1) - _HALF


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, docs = [], []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {_halves(k) for x in (text or "").encode().split(b"\n") if (k := line_key(x, min_chars))}
                hashes += own
                docs += [doc] * len(own)
            h = np.array(hashes, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(docs, pa.int64())], names=["h", "f", "doc"])

    return run


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    keys = shard["h"].to_numpy().view(np.uint64)
    if len(np.unique(keys)) < len(keys):  # equal first halves: one in 2**64 for a pair; the later ones are looked up as they are
        shard = shard.sort_values(["h", "f"], ignore_index=True)
        more = shard["h"].duplicated()
        extra, shard = shard[more], shard[~more]
        keys = shard["h"].to_numpy().view(np.uint64)
    else:
        extra = shard[:0]
    sizes, bits = perfect_hash.build(keys)
    order = np.argsort(perfect_hash.index(sizes, bits, keys))
    array = lambda c: shard[c].to_numpy()[order].tobytes()
    salts = 1 + int(shard["n_docs"].sum() + extra["n_docs"].sum()) // SHARD_PROBES
    return pd.DataFrame(
        {
            "shard": [int(shard["shard"].iloc[0])],
            "salts": [salts],
            "sizes": [sizes],
            "bits": [bits],
            "fingerprints": [array("f")],
            "counts": [array("n_docs")],
            "keepers": [array("keeper")],
            "extra": [extra[["h", "f", "n_docs", "keeper"]].to_numpy(dtype=np.int64).tobytes()],
        }
    )


_SHARD = "shard int, salts int, sizes array<int>, bits binary, fingerprints binary, counts binary, keepers binary, extra binary"


def _probe(min_docs: int):
    def run(probes: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if arrays.empty or probes.empty:
            return pd.DataFrame({"doc": np.zeros(0, np.int64), "h": np.zeros(0, np.int64), "f": np.zeros(0, np.int64)})
        a = arrays.iloc[0]
        prints, counts, keepers = (np.frombuffer(a[c], dtype=np.int64) for c in ("fingerprints", "counts", "keepers"))
        at = perfect_hash.index(list(a["sizes"]), a["bits"], probes["h"].to_numpy().view(np.uint64))
        f, doc = probes["f"].to_numpy(), probes["doc"].to_numpy()
        drop = (at >= 0) & (prints[at] == f) & (counts[at] >= min_docs) & (doc != keepers[at])
        for h, x, n, keeper in np.frombuffer(a["extra"], dtype=np.int64).reshape(-1, 4):
            drop |= (probes["h"].to_numpy() == h) & (f == x) & (n >= min_docs) & (doc != keeper)
        return probes.loc[drop, ["doc", "h", "f"]]

    return run


def _rewrite(text_col: str, drops_col: str, min_chars: int, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            kept, n_lines, n_dropped = [], [], []
            for text, drops in zip(batch.column(text_col).to_pylist(), batch.column(drops_col).to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                stay = lines
                if drops:
                    gone = {(x["h"], x["f"]) for x in drops}
                    stay = [x for x in lines if (k := line_key(x, min_chars)) is None or _halves(k) not in gone]
                kept.append(b"\n".join(stay).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            yield put(batch, schema, **{text_col: pa.array(kept, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with its repeated lines dropped from text_col, and n_lines (before), n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of
    at least min_chars code points that at least min_docs documents hold lose all their lines
    but those in the largest id that holds them. An older n_lines or n_dropped column gives way.
    """
    lines = written(docs.select(id_key(id_col).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_line_hashes(min_chars), "h long, f long, doc long"), "lines")
    repeated = written(
        lines.groupBy("h", "f", "doc").agg(F.lit(1).alias("one")).groupBy("h", "f").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper")).where(F.col("n_docs") >= min_docs),
        "repeated-lines",
    )
    doc, gone = unused(docs, "doc", "drops")
    n_shards = max(256, -(-repeated.count() // SHARD_KEYS))
    shard = F.pmod(F.xxhash64("h"), F.lit(n_shards)).cast("int").alias("shard")
    index = written(repeated.select("*", shard).groupBy("shard").applyInPandas(_build, _SHARD), "line-index")
    probes = (
        lines.select("*", shard)
        .join(index.select("shard", "salts"), "shard")  # shards without repeated lines drop nothing
        .select("shard", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"), "h", "f", "doc")
    )
    arrays = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    drops = (
        probes.groupBy("shard", "salt").cogroup(arrays.groupBy("shard", "salt")).applyInPandas(_probe(min_docs), "doc long, h long, f long")
        .groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct("h", "f")).alias(gone))
    )
    schema = schema_with(docs, n_lines=T.LongType(), n_dropped=T.LongType())
    clash = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")]
    joined = docs.drop(*clash).withColumn(doc, id_key(id_col)).join(drops.hint("shuffle_hash"), doc, "left").drop(doc)
    return joined.mapInArrow(_rewrite(text_col, gone, min_chars, schema), schema)
