"""Benchmark decontamination by spaced seeds.

Words are runs of ASCII letters and digits and of any character beyond ASCII, A-Z lower-cased.
A mask names the word positions of a short span that count; the others may differ.

1. Each item gives the hashes of its masked words (seeds), at every position and under every
   mask. They mark the slots of a bit filter of bounded size that every task gets.
2. Each text gives, once each, those of its seeds whose slots are marked; a join on the seed
   gives the distinct pairs of text and item that share one. Neither side is expanded by
   position, so a word repeated a thousand times makes one row.
3. A pair's shared seeds name diagonals (text position less item position); each is compared
   word by word. The longest stretch of a diagonal that agrees in at least the asked share of
   its words, its first and last among them, is a leak if it has enough words; so is an item
   that stands as a whole and agrees in that share of its words, at whichever places.

Texts are known by 128 bits of hash, so that copies are compared once. A join at a frequent
seed or item comes straight from tables, so adaptive execution can split it. The default masks
find every overlap of 6 to 18 words with a substitution in up to a fifth of them (tried out in
tests/llm), and so every longer one that has such a stretch. Items of five words also give the
seeds of four of them, shorter ones their whole, so that an item of any length is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices, unused, written
from .words import ALNUM, cut, mix

MASKS = ((0, 1, 3, 6, 7), (0, 1, 3, 4, 5), (0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 2, 4, 5), (0, 2, 3, 4, 5))
#: More masks, for items of exactly so many words.
SHORT_MASKS = {1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: ((0, 1, 2, 3),), 5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))}
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_equal", T.LongType())]))
#: Bits of the filter for each seed, and at most (32 MB); a benchmark beyond that lets more seeds of texts through to the join.
FILTER_BITS_A_SEED, MOST_FILTER_BITS = 32, 1 << 28
#: Items that are compared with a text in one row of a task.
ITEMS_A_ROW = 64

_Mask = tuple[int, ...]


def _seeds(hashes: np.ndarray, mask: _Mask) -> np.ndarray:
    """The hash of the masked words, and of the mask, at each position where the whole span fits."""
    n = max(0, len(hashes) - mask[-1])
    out = np.full(n, np.uint64(sum(1 << o for o in mask)), dtype=np.uint64)
    for o in mask:
        out = (out + hashes[o : o + n]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def _row_seeds(hashes: np.ndarray, rows: np.ndarray, mask: _Mask) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose span lies within one row, and their seeds."""
    h = _seeds(hashes, mask)
    at = np.flatnonzero(rows[: len(h)] == rows[mask[-1] :]) if len(h) else np.zeros(0, dtype=np.int64)
    return at, h[at]


def masks_of(n_words: int, masks: tuple[_Mask, ...]) -> tuple[_Mask, ...]:
    """The masks under which an item of so many words gives seeds."""
    return (*SHORT_MASKS.get(n_words, ()), *(m for m in masks if m[-1] < n_words))


def longest_stretch(equal: np.ndarray, similarity: float) -> tuple[int, int, int]:
    """start, length, matches of the longest stretch that starts and ends with a match and agrees in the asked share
    (the first of them); zeros if nothing matches."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0, 0
    share = round(similarity * 1000)
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1000 - share, -share))])
    low = np.minimum.accumulate(total[at])  # the first start that reaches a sum is the farthest that an end can go with
    first = np.minimum(np.searchsorted(-low, -total[at + 1], "left"), np.arange(len(at)))
    length = at - at[first] + 1
    end = int(length.argmax())
    start = int(at[first[end]])
    return start, int(length[end]), end - int(first[end]) + 1


def diagonals(text: np.ndarray, item: np.ndarray, masks: tuple[_Mask, ...]) -> np.ndarray:
    """The distinct diagonals on which a seed of both word sequences agrees.

    A seed that stands often in both is not expanded into pairs of places: a Fourier transform of
    its places gives the differences that occur."""
    n, m = len(text), len(item)
    found = [np.zeros(0, dtype=np.int64)]
    for mask in masks:
        a, b = _seeds(text, mask), _seeds(item, mask)
        order = np.argsort(b, kind="stable")
        b = b[order]
        low, high = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
        often = high - low > 64
        for start in np.unique(low[often]):
            places, others = np.flatnonzero(often & (low == start)), order[start : high[low == start][0]]
            if len(places) <= 64:
                found.append((places[:, None] - others[None, :]).ravel())
                continue
            size = 1 << (n + m).bit_length()
            x, y = np.zeros(size), np.zeros(size)
            x[places], y[m - others] = 1, 1
            found.append(np.flatnonzero(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size) > 0.5) - m)
        at = np.flatnonzero((high > low) & ~often)
        count, first = (high - low)[at], low[at]
        found.append(np.repeat(at, count) - order[np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])
        found = [np.unique(np.concatenate(found))]
    return found[0]


def best_leak(text: np.ndarray, item: np.ndarray, masks: tuple[_Mask, ...], min_words: int, similarity: float) -> tuple[int, int, int] | None:
    """(start, words, equal words) of the leak with the most equal words, of these the first one and then the longest."""
    n, m = len(text), len(item)
    d = diagonals(text, item, masks_of(m, masks))
    overlap = np.minimum(n, m + d) - np.maximum(0, d)
    best = None  # (equal words, -start, words)
    for i in np.lexsort((d, -overlap)):
        start, size = max(0, int(d[i])), int(overlap[i])
        if best and (size < best[0] or size == best[0] and start >= -best[1]):
            if size < best[0]:
                break
            continue
        equal = text[start : start + size] == item[start - d[i] : start - d[i] + size]
        same = int(equal.sum())
        if best and same < best[0]:
            continue
        leaks = []
        if size == m and same * 1000 >= round(similarity * 1000) * m:
            leaks.append((same, -start, m))
        if size >= min_words:
            at, length, agree = longest_stretch(equal, similarity)
            if length >= min_words:
                leaks.append((agree, -(start + at), length))
        best = max([*leaks, *([best] if best else [])], default=None)
    return (-best[1], best[2], best[0]) if best else None


def _item_seeds(masks: tuple[_Mask, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = cut(batch.column("text"), ALNUM, lower=True)
            hashes, rows, counts = words.hashes, words.rows(), words.counts
            for length in np.unique(counts):
                for mask in masks_of(int(min(length, masks_from)), masks):
                    at, h = _row_seeds(hashes, rows, mask)
                    own = counts[rows[at]] == length
                    row, h = np.unique(np.stack([rows[at[own]], h[own].view(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(h.copy()), batch.column("item").take(pa.array(row)), pa.array(np.full(len(row), min(length, 6), np.int32))], names=["seed", "item", "n_words"])

    masks_from = 1 + max(max(m) for m in masks)
    return run


def _text_seeds(filter_bits, masks: tuple[_Mask, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = filter_bits.value
        slot = np.uint64(len(marked) * 8 - 1)

        def is_marked(s: np.ndarray) -> np.ndarray:
            return (marked[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 > 0

        for batch in slices(batches, "text"):
            words = cut(batch.column("text"), ALNUM, lower=True)
            hashes, rows = words.hashes, words.rows()
            row, seed = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for mask in masks:
                h = _seeds(hashes, mask)
                at = np.flatnonzero(is_marked(h & slot))
                at = at[rows[at] == rows[at + mask[-1]]]
                at = at[is_marked(h[at] >> np.uint64(32) & slot)]
                row.append(rows[at])
                seed.append(h[at].view(np.int64))
            both = np.unique(np.stack([np.concatenate(row), np.concatenate(seed)]), axis=1)
            at = pa.array(both[0].copy())
            yield pa.RecordBatch.from_arrays([batch.column("t1").take(at), batch.column("t2").take(at), pa.array(both[1].copy())], names=["t1", "t2", "seed"])

    return run


def _compare(masks: tuple[_Mask, ...], min_words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = cut(batch.column("text"), ALNUM, lower=True)
            for r in range(batch.num_rows):
                text = words.hashes[words.first[r] : words.first[r + 1]]
                held = batch.column("items")[r].values
                items = cut(held.field("text"), ALNUM, lower=True)
                out = []
                for k, item in enumerate(held.field("id").to_pylist()):
                    leak = best_leak(text, items.hashes[items.first[k] : items.first[k + 1]], masks, min_words, similarity)
                    if leak:
                        out.append((item, *leak))
                if out:
                    own = [pa.array([batch.column(c)[r].as_py()] * len(out), pa.int64()) for c in ("t1", "t2")]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))], names=["t1", "t2", "item_id", "start", "n_words", "n_equal"])

    return run


def _text_keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_words: int = 13, similarity: float = 0.8, masks: tuple[_Mask, ...] = MASKS,
) -> DataFrame:
    """docs with leaks: for each benchmark item found in the text, its id, where its best stretch starts (words from 0),
    the stretch's length and equal words, in the order of ids.

    A stretch needs min_words words, of which the share of similarity agrees; an item that stands as a whole needs
    that share of its own words, however few it has. Items without an id, text or word are never found. Null and
    empty texts have no leaks; an older leaks column gives way. Repeated rows are each answered.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).dropna().distinct()
    items = written(items.withColumn("item", F.xxhash64("id", "text")), "benchmark")
    seeds = written(items.select("item", "text").mapInArrow(_item_seeds(masks), "seed long, item long, n_words int"), "seeds")
    lengths = sorted(r[0] for r in seeds.select("n_words").distinct().collect())  # 1 to 6 (6 and more)
    bits = _filter(seeds)
    used = list(dict.fromkeys(m for n in lengths for m in (*SHORT_MASKS.get(n, ()), *(masks if n == 6 else masks_of(n, masks)))))

    t1, t2 = _text_keys(F.col(f"`{text_col}`").cast("string"))
    texts = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hits = written(texts.mapInArrow(_text_seeds(spark.sparkContext.broadcast(bits), tuple(used)), "t1 long, t2 long, seed long"), "text-seeds")
    pairs = written(hits.join(seeds.select("seed", "item"), "seed").select("t1", "t2", "item").distinct(), "leak-candidates")
    # a text meets its items in rows of about ITEMS_A_ROW
    parts = pairs.groupBy("t1", "t2").agg(F.ceil(F.count("*") / ITEMS_A_ROW).cast("int").alias("parts"))
    dealt = pairs.join(parts, ["t1", "t2"]).withColumn("part", F.pmod("item", F.col("parts"))).join(items, "item")
    rows = dealt.groupBy("t1", "t2", "part").agg(F.collect_list(F.struct("id", "text")).alias("items"))
    found_texts = texts.join(parts, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    compared = rows.join(found_texts, ["t1", "t2"]).select("t1", "t2", "text", "items").mapInArrow(_compare(masks, min_words, similarity), "t1 long, t2 long, item_id long, start long, n_words long, n_equal long")
    best = compared.groupBy("t1", "t2", "item_id").agg(F.max(F.struct("n_equal", (-F.col("start")).alias("start"), "n_words")).alias("best"))
    leak = F.struct("item_id", (-F.col("best.start")).alias("start"), F.col("best.n_words").alias("n_words"), F.col("best.n_equal").alias("n_equal"))
    out = docs.drop(*[c for c in docs.columns if c.lower() == "leaks"])
    k1, k2 = unused(out, "t1", "t2")
    leaks = written(best.groupBy(F.col("t1").alias(k1), F.col("t2").alias(k2)).agg(F.array_sort(F.collect_list(leak)).cast(LEAKS).alias("leaks")), "leaks")
    joined = out.withColumns({k1: t1, k2: t2}).join(leaks, [k1, k2], "left")
    return joined.select(*(F.col(f"`{c}`") for c in out.columns), F.coalesce("leaks", F.array().cast(LEAKS)).alias("leaks"))


def _filter(seeds: DataFrame) -> np.ndarray:
    """The filter's bytes: two marked slots for each seed. Set in Spark, so at most MOST_FILTER_BITS / 64 rows arrive."""
    n = seeds.select(F.approx_count_distinct("seed")).first()[0]
    bits = min(MOST_FILTER_BITS, max(1 << 16, 1 << math.ceil(math.log2(max(1, n * FILTER_BITS_A_SEED)))))
    slots = F.array(F.col("seed").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(bits - 1)))
    words = seeds.select(F.explode(slots).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype="<i8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)
