"""Substring dedup by level-wise doubling.

A word goes if a window of `window` words covers it whose words also start earlier (in a
smaller id, or before in the same text). Whatever repeats at full length also repeats at
half of it, so the search starts at `base` words and doubles: at each length only windows
that are still candidates are hashed and counted, and those found once fall out, with all
longer windows around them. Below full length a candidate is counted through one of its
parts alone: the part of that length with the least hash, which any other occurrence of the
candidate has at the same place. At full length each candidate's hash (96 bits) is grouped
to its first start; candidates that are not the first are repeats.

Counting and grouping combine before they shuffle, and occurrences meet counts in a join
that adaptive execution can split, so neither a frequent window nor a large group of copies
needs one task.

Null and empty texts have no words. Null ids count as one document before all others. In
rows that repeat an id, equal windows at equal places count as the same start: neither goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import id_key, put, schema_with, slices, unused, written
from .words import Words, cut

_MOST = np.uint64(2**64 - 1)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over x[p : p + width], for each p where that many follow; the rest is cut short."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _padded(x: np.ndarray, n: int, fill) -> np.ndarray:
    return np.concatenate([x, np.full(n - len(x), fill, dtype=x.dtype)])


class _Level:
    """The windows of one part length in a batch of texts, among whole windows of `window` words."""

    def __init__(self, words: Words, length: int, window: int):
        n = len(words.starts)
        at, h = words.windows(length)
        self.hashes = np.full(n, _MOST)
        self.hashes[at] = h
        self.width = window - length + 1
        self.least = _padded(_slide(self.hashes, self.width, np.minimum), n, _MOST)

    def alive(self, whole: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Of whole windows: those whose least part is a repeated one."""
        least = _padded(_slide(np.where(repeated, self.hashes, _MOST), self.width, np.minimum), len(self.hashes), _MOST)
        return whole & (least == self.least)

    def parts(self, alive: np.ndarray) -> np.ndarray:
        """Positions of the least parts of the windows that are alive."""
        n = len(self.hashes)
        reach = _slide(np.concatenate([np.zeros(self.width - 1, dtype=np.uint64), np.where(alive, self.least, np.uint64(0))]), self.width, np.maximum)
        return np.flatnonzero((reach[:n] == self.hashes) & (reach[:n] > 0))


def _marks(words: Words, column: pa.Array | None) -> np.ndarray:
    """Which word positions the rows' lists name."""
    marked = np.zeros(len(words.starts), dtype=bool)
    if column is not None:
        lists = column.cast(pa.list_(pa.int64()))
        rows = np.repeat(np.arange(len(lists)), [len(x) if x.is_valid else 0 for x in lists])
        at = words.first[rows] + lists.flatten().to_numpy(zero_copy_only=False)
        marked[at[at < words.first[rows + 1]]] = True
    return marked


def _candidates(words: Words, before: int | None, window: int, survivors: pa.Array | None) -> np.ndarray:
    whole = np.zeros(len(words.starts), dtype=bool)
    whole[words.windows(window)[0]] = True
    return whole if before is None else _Level(words, before, window).alive(whole, _marks(words, survivors))


def _emit(before: int | None, length: int, window: int):
    """Rows of this level: (h, doc, pos), at full length with 32 more bits of hash, g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = cut(batch.column("text"))
            alive = _candidates(words, before, window, batch.column("survivors") if before else None)
            if length < window:
                level = _Level(words, length, window)
                at = level.parts(alive)
                hashes, more = {"h": level.hashes[at]}, {}
            else:
                at, h = words.windows(window)
                g = words.windows(window, second=True)[1]
                hashes = {"h": h[alive[at]]}
                more = {"g": (g[alive[at]] >> np.uint64(32)).astype(np.uint32).view(np.int32)}
                at = at[alive[at]]
            rows = words.rows()[at]
            doc = batch.column("doc").to_numpy(zero_copy_only=False)[rows]
            columns = {k: v.view(np.int64) for k, v in hashes.items()} | more | {"doc": doc, "pos": (at - words.first[rows]).astype(np.int32)}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    return run


def _remove(text_col: str, survivors_col: str, firsts_col: str, schema: T.StructType, before: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            column = batch.column(text_col)
            words = cut(column)
            repeats = _candidates(words, before, window, batch.column(survivors_col))
            at, h = words.windows(window)
            place = np.full(len(words.starts), -1, dtype=np.int64)
            place[at] = np.arange(len(at))
            firsts = batch.column(firsts_col)
            for row in np.flatnonzero(firsts.is_valid().to_numpy(zero_copy_only=False)):
                own = firsts[row].values.to_numpy()
                i = words.first[row] + (own >> 32)
                ok = i < words.first[row + 1]
                i, low = i[ok], own[ok] & 0xFFFFFFFF
                same = (place[i] >= 0) & ((h[place[i]] & np.uint64(0xFFFFFFFF)).astype(np.int64) == low)
                repeats[i[same]] = False
            delta = np.zeros(len(words.starts) + window + 1, dtype=np.int32)
            starts = np.flatnonzero(repeats)
            np.add.at(delta, starts, 1)
            np.add.at(delta, starts + window, -1)
            gone = np.cumsum(delta)[: len(words.starts)] > 0
            n_gone = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), words.first[:-1]) if batch.num_rows else np.zeros(0, np.int64)
            n_gone[words.counts == 0] = 0
            kept = []
            for row, text in enumerate(column.to_pylist()):
                own = (text or "").encode().split()
                if n_gone[row]:
                    stay = ~gone[words.first[row] : words.first[row + 1]]
                    own = [own[i] for i in np.flatnonzero(stay)]
                kept.append(b" ".join(own).decode())
            yield put(batch, schema, **{text_col: pa.array(kept, pa.string()), "n_words": pa.array(words.counts), "n_removed": pa.array(n_gone)})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, base: int = 5) -> DataFrame:
    """docs with text_col cut to the words that stay, joined by one space, and n_words (before), n_removed.

    Words are `[^\\x20\\x09-\\x0D]+`. window must be base times a power of two. An older n_words or n_removed gives way.
    """
    levels = [base]
    while levels[-1] < window:
        levels.append(2 * levels[-1])
    if levels[-1] != window or len(levels) < 2:
        raise ValueError("window must be base times 2, 4, 8, ...")
    source = docs.select(id_key(id_col).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    survivors, before = None, None
    for length in levels[:-1]:
        rows = source if survivors is None else source.join(survivors.hint("shuffle_hash"), "doc")
        found = rows.mapInArrow(_emit(before, length, window), "h long, doc long, pos int")
        # written first: a join can only be split at a frequent window if each side comes straight from a shuffle
        repeated = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), f"repeated-{length}")
        survivors = written(found.join(repeated, "h", "left_semi").groupBy("doc").agg(F.collect_list("pos").alias("survivors")), f"windows-{length}")
        before = length
    whole = source.join(survivors.hint("shuffle_hash"), "doc").mapInArrow(_emit(before, window, window), "h long, g int, doc long, pos int")
    first = whole.groupBy("h", "g").agg(F.min(F.struct("doc", "pos")).alias("first"))
    # a first start and half of its hash (rows that repeat an id can differ there) in one number
    packed = F.shiftleft(F.col("first.pos").cast("long"), 32).bitwiseOR(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)))
    firsts = written(first.groupBy(F.col("first.doc").alias("doc")).agg(F.collect_list(packed).alias("firsts")), "first-windows")
    names = {"n_words": T.LongType(), "n_removed": T.LongType()}
    schema = schema_with(docs, **names)
    doc, alive, first_col = unused(docs, "doc", "survivors", "firsts")
    known = survivors.join(firsts, "doc", "left").select(F.col("doc").alias(doc), F.col("survivors").alias(alive), F.col("firsts").alias(first_col))
    joined = docs.drop(*[c for c in docs.columns if c.lower() in names]).withColumn(doc, id_key(id_col)).join(known.hint("shuffle_hash"), doc, "left").drop(doc)
    return joined.mapInArrow(_remove(text_col, alive, first_col, schema, before, window), schema)
