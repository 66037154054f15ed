"""N-gram Jaccard join by vertical partitioning.

The global order of all shingles is the order of their 64-bit hashes, and fragments are
equal ranges of it, so cutting needs no statistics and no broadcast. Texts fall into size
classes; a class fixes how many fragments its sets are cut into:

* Two sets with J >= t differ in at most D = (1 - t) / (1 + t) * (|A| + |B|) shingles, and each
  differing shingle spoils one fragment. With more than D fragments at least one is equal in
  both, so equal fragments (class, number, hash of the content) find all pairs.
* A fragment may be empty in both. The class has some fragments to spare: a set with no
  more empty fragments than that still shares a filled one with every partner. Only sets
  with more empty ones also give those.
* Leaving a fixed set of shingles out of every set differs no pair by more, so the most
  frequent shingles are left out of fragments: a passage in many texts brings none of them
  together. A set that they leave too empty gives the fragments of its whole set besides.
  Which shingles these are (and how many are sent to the tasks) does not change the result.
* A set gives fragments for its own class and for each larger class where a partner can be.

Equal sets collapse to the smallest id first. In a group of sets with one fragment in
common each meets only the group's first (a link to it is all that components need). A
pair is dropped if its sizes, those of its vertical fragments, or the bits in which two parity
sketches differ (each stands for a shingle of only one set), exceed what the threshold allows.

The sets of the pairs that are left are cut vertically into FRAGMENTS ranges of the global
order. A pair meets both sets' fragments, partial overlaps are counted fragment by fragment, and
their sum decides. They stay within the pair's row: a row for each pair and fragment would make
sixteen times as many, most where groups of copies are largest.

Groups that the links have not made one component then meet another member, drawn by hash for
each group, and another, for as long as what is apart would be many pairs. The rest is compared
across components, block by block on sketches, and only pairs that these let link become rows;
so no link that joins two components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import NULL_ID, id_key, partitions, removed, runs, slices, unused, written
from .words import Words, cut, mix

GROWTH = 1.5
#: Shingles in this many texts or more, the most frequent first, are left out of fragments.
HOT_TEXTS = 1000
MOST_HOT = 200_000
SKETCH_BITS = 1 << 20
BLOCK = 256
#: Pairs of sketches that are compared without drawing members again, and how many turns come before that at most.
FEW_PAIRS, MOST_TURNS = 20_000_000, 3
#: Vertical fragments in which overlaps are counted.
FRAGMENTS = 16


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, and where each row's start and the last ends.

    A row of fewer than n words has one shingle, of all of them; a row without words none.
    """
    rows = words.rows()
    at, h = words.windows(n)
    row = rows[at]
    for short in range(1, n):
        few = np.flatnonzero(words.counts == short)
        if len(few):
            s_at, s_h = words.windows(short)
            own = words.counts[rows[s_at]] == short
            row, h = np.concatenate([row, rows[s_at[own]]]), np.concatenate([h, s_h[own]])
            order = np.argsort(row, kind="stable")
            row, h = row[order], h[order]
    ends = np.searchsorted(row, np.arange(len(words.first)))
    for s, e in zip(ends, ends[1:], strict=False):
        h[s:e].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(len(words.first)))


class Classes:
    """Size classes for a threshold of `percent`; class k holds sizes low[k] .. low[k + 1] - 1."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        low = [1]
        while low[-1] <= largest * 100 // percent + 1:
            low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
        self.low = np.array(low, dtype=np.int64)
        top = self.low[1:] - 1
        differ = (100 - percent) * 2 * top // (100 + percent)
        self.spare = np.array([_spare(int(d), int(x)) for d, x in zip(differ, self.low, strict=False)])
        self.fragments = differ + 1 + self.spare

    def of(self, size: int) -> list[int]:
        """The size's own class, and larger ones in which a partner can be."""
        k = int(np.searchsorted(self.low, size, "right")) - 1
        out = [k]
        while 100 * size >= self.percent * self.low[out[-1] + 1]:
            out.append(out[-1] + 1)
        return out


def _spare(differ: int, size: int) -> int:
    """Enough fragments to spare that few sets have more empty ones: the mean of the smallest sets that a class gets,
    and four deviations."""
    spare = 1 if differ else 0
    while differ:
        f = differ + 1 + spare
        empty = f * np.exp(-0.85 * size / f)
        if spare >= empty + 4 * np.sqrt(empty) or spare > differ:
            break
        spare += 1
    return spare


def _fragment_of(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def fragment_keys(hashes: np.ndarray, classes: Classes, hot: np.ndarray) -> np.ndarray:
    """The keys under which a set (sorted hashes) meets its partners; hot: sorted hashes that are left out."""
    rest = hashes
    if len(hot):
        rest = hashes[hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] != hashes]
    keys = []
    for k in classes.of(len(hashes)):
        key, size = _fragments(rest, int(classes.fragments[k]), k, 0)
        keys.append(key[size > 0])
        if (size == 0).sum() > classes.spare[k]:
            key, size = _fragments(hashes, int(classes.fragments[k]), k, 1)
            keys.append(key if (size == 0).sum() > classes.spare[k] else key[size > 0])
    return np.concatenate(keys)


def _fragments(hashes: np.ndarray, f: int, k: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The key and the size of each fragment."""
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes), out=total[1:])
    ends = np.searchsorted(_fragment_of(hashes, f), np.arange(f + 1))
    size = np.diff(ends)
    place = (np.arange(f, dtype=np.uint64) << np.uint64(32)) + np.uint64((2 * k + kind) << 20) + size.astype(np.uint64)
    return mix(mix(total[ends[1:]] - total[ends[:-1]] + np.uint64(0x1234567)) + mix(place)), size


def parity_sketch(hashes: np.ndarray) -> bytes:
    """A bit for each residue: whether an odd number of hashes has it. Two bits or more for each hash."""
    bits = min(SKETCH_BITS, max(64, 1 << (2 * len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A number of hashes that are in one of the sets only, at least; a longer sketch folds to the other's length."""
    x, y = (np.frombuffer(v, dtype=np.uint64) for v in (a, b))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _sets_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(cut(column, lower=True), n)


def _describe(n: int):
    """(doc, n_shingles, s1, s2, sketch, parts): each set's size, 128-bit hash, sketch and fragments' sizes; and, with hot,
    (s1, n_shingles) of shingles in several texts of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, first = _sets_of(batch.column("text"), n)
            sums = []
            for salt in (1, 2):
                total = np.zeros(len(h) + 1, dtype=np.uint64)
                np.cumsum(mix(h + np.uint64(salt)), out=total[1:])
                sums.append(mix(total[first[1:]] - total[first[:-1]]).view(np.int64))
            shingle, texts = np.unique(h, return_counts=True)
            shingle, texts = shingle[texts > 2].view(np.int64), texts[texts > 2]
            none = len(shingle)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            parts = np.bincount(row * FRAGMENTS + _fragment_of(h, FRAGMENTS), minlength=batch.num_rows * FRAGMENTS).astype(np.int32)
            sketches = [parity_sketch(h[s:e]) for s, e in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc": pa.array(batch.column("doc").to_pylist() + [None] * none, pa.int64()),
                    "n_shingles": pa.array(np.concatenate([np.diff(first), texts])),
                    "s1": pa.array(np.concatenate([sums[0], shingle])),
                    "s2": pa.array(np.concatenate([sums[1], np.zeros(none, np.int64)])),
                    "sketch": pa.array(sketches + [None] * none, pa.binary()),
                    "parts": pa.array([*parts.reshape(-1, FRAGMENTS), *[None] * none], pa.list_(pa.int32())),
                    "hot": pa.array(np.arange(batch.num_rows + none) >= batch.num_rows),
                }
            )

    return run


def _keys(n: int, percent: int, largest: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(percent, largest)
        for batch in slices(batches, "text"):
            h, first = _sets_of(batch.column("text"), n)
            ids = batch.column("doc").to_numpy()
            least: dict[bytes, int] = {}  # of equal sets in a slice only the smallest id can be the one that stands for them
            for row in np.argsort(ids, kind="stable")[::-1].tolist():
                if first[row + 1] > first[row]:
                    least[h[first[row] : first[row + 1]].tobytes()] = row
            rows = sorted(least.values())
            keys = [fragment_keys(h[first[r] : first[r + 1]], classes, hot.value) for r in rows]
            doc = np.repeat(ids[rows], [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, h[:0]]).view(np.int64)), pa.array(doc)], names=["key", "doc"])

    return run


def _near(percent: int):
    """Pairs whose sketches differ, and whose fragments' sizes overlap, as a link's can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (np.array(batch.column(c)) for c in ("n_a", "n_b"))
            parts = [batch.column(c).flatten().to_numpy().reshape(-1, FRAGMENTS) for c in ("parts_a", "parts_b")]
            ok = (100 + percent) * np.minimum(*parts).sum(1, dtype=np.int64) >= percent * (m + n)
            for k in np.flatnonzero(ok):
                ok[k] = least_difference(batch.column("sketch_a")[k].as_py(), batch.column("sketch_b")[k].as_py()) <= (100 - percent) * (m[k] + n[k]) // (100 + percent)
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _cut_vertically(n: int):
    """(doc, fragments): the sorted shingles of each of a set's FRAGMENTS fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, first = _sets_of(batch.column("text"), n)
            at = np.repeat(np.arange(batch.num_rows), np.diff(first)) * FRAGMENTS + _fragment_of(h, FRAGMENTS)
            ends = np.searchsorted(at, np.arange(batch.num_rows * FRAGMENTS + 1))
            inner = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
            outer = pa.ListArray.from_arrays(pa.array((np.arange(batch.num_rows + 1) * FRAGMENTS).astype(np.int32)), inner)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), outer], names=["doc", "fragments"])

    return run


def _verified(pairs: DataFrame, reps: DataFrame, source: DataFrame, n: int, percent: int, step: str) -> DataFrame:
    """Of pairs (a, b) of different sets those that link. Sketches meet pairs, and fragments what these leave, in joins that
    adaptive execution can split; the fragments of those few are written first, so that all texts are shuffled once."""
    side = lambda x: reps.select(F.col("doc").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "sketch", "parts")))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    near = written(sized.mapInArrow(_near(percent), "a long, b long, n_a long, n_b long"), f"near-{step}")
    needed = near.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    cut_up = written(source.join(needed.hint("shuffle_hash"), "doc", "left_semi").mapInArrow(_cut_vertically(n), "doc long, fragments array<array<long>>"), f"vertical-{step}")
    left, right = (cut_up.select(F.col("doc").alias(x), F.col("fragments").alias(f"fragments_{x}")) for x in "ab")
    partial = F.zip_with("fragments_a", "fragments_b", lambda x, y: F.size(F.array_intersect(x, y)).cast("long"))
    total = near.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", F.aggregate(partial, F.lit(0).cast("long"), lambda s, v: s + v).alias("both"))
    links = written(total.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"), f"links-{step}")
    removed(near)
    removed(cut_up)
    return links


def _id(key: str) -> Column:
    return F.when(F.col(key) != F.lit(NULL_ID), F.col(key))


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The distinct (id, text) of docs, each with a first column, a key (long) that no other has; of rows that repeat both, the largest
    of the other columns stays. The key is a hash, salted until none is shared."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    key, row_col = unused(docs, "key", "row")
    row = (F.max(F.struct(*(f"`{c}`" for c in rest))) if rest else F.lit(None)).alias(row_col)
    docs = written(docs.groupBy(f"`{id_col}`", f"`{text_col}`").agg(row), "documents")
    # null and empty texts hash alike without the flags
    parts = [x for c in (id_col, text_col) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    for salt in range(16):
        keyed = docs.withColumn(key, F.xxhash64(F.lit(salt), *parts))
        n, n_keys, least = keyed.agg(F.count("*"), F.count_distinct(key), F.min(key)).first()
        if n == n_keys and least != NULL_ID:
            return keyed.select(key, f"`{id_col}`", f"`{text_col}`", *(F.col(f"`{row_col}`.`{c}`") for c in rest))
    raise RuntimeError("no salt gives each document a key of its own")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document of docs: the size of its set of distinct n-word shingles, and the
    smallest id that it reaches over links of 100 * intersection >= percent * union.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Texts without words (null too) have no
    shingles and link with nothing. Rows that repeat both id and text are one document; each other
    text of an id is a document, and a row of the result, of its own. Null ids come before all
    others, and are null in the result.
    """
    source = docs.select(id_key(id_col).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n_rows, n_ids = source.agg(F.count("*"), F.count_distinct("doc")).first()
    if n_rows != n_ids:
        keyed = with_keys(source.withColumnRenamed("doc", "id"), "id", "text")
        groups = written(jaccard_components(keyed, "key", "text", n, percent).join(keyed.select("key", "id"), "key"), "groups")
        least = groups.where("n_shingles > 0").groupBy("component_id").agg(F.min("id").alias("least"))
        linked = groups.join(least, "component_id").select("id", "n_shingles", "least")
        out = groups.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("least")).unionAll(linked)
        return out.select(_id("id").alias(id_col), "n_shingles", _id("least").alias("component_id"))
    described = written(source.mapInArrow(_describe(n), "doc long, n_shingles long, s1 long, s2 long, sketch binary, parts array<int>, hot boolean"), "sets")
    sets = described.where("not hot").select("doc", "n_shingles", "s1", "s2")
    classes = written(sets.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc").alias("rep")), "classes")
    reps = written(described.where("not hot").join(classes.select(F.col("rep").alias("doc")), "doc", "left_semi").select("doc", F.col("n_shingles").alias("n"), "sketch", "parts"), "representatives")
    largest = reps.agg(F.max("n")).first()[0] or 1
    frequent = described.where("hot").groupBy("s1").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= HOT_TEXTS).orderBy(F.desc("n"), "s1").limit(MOST_HOT)
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["s1"] for r in frequent.collect()], dtype=np.int64).view(np.uint64)))
    # counted and joined in one partitioning: Spark reuses the exchange, and the fragments are made once
    keys = source.mapInArrow(_keys(n, percent, largest, hot), "key long not null, doc long not null").repartition("key")
    groups = keys.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).where("hub <> last").select("key", "hub")
    # the least id of a group is a representative; other copies of its members end here
    shared = written(keys.join(groups, "key").join(reps.select("doc"), "doc"), "fragments")
    links = _verified(shared.where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct(), reps, source, n, percent, "1")
    for turn in range(2, MOST_TURNS + 2):
        comp = connected_components(links)
        member = shared.select("key", "doc").join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        drawn = F.min(F.struct(F.xxhash64(F.lit(turn), "key", "doc"), "doc", "component")).alias("drawn")
        parts = member.groupBy("key", "component").agg(F.count("*").alias("n"), drawn)
        apart = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max("n").alias("most"), F.min("drawn").alias("drawn")).where("parts > 1")
        apart = written(apart.drop("parts"), f"apart-{turn}")
        # pairs of which at least one is outside the group's largest component
        work = apart.agg(F.sum((F.col("size") - F.col("most")).cast("double") * F.col("size"))).first()[0]
        if work is None:
            break
        last = turn > 2 and work <= FEW_PAIRS or turn > MOST_TURNS
        if last:
            pairs = _apart(member.join(apart.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "key").join(reps, "doc"), percent)
        else:
            member = member.join(apart.select("key", F.col("drawn.doc").alias("other"), F.col("drawn.component").alias("other_component")), "key")
            pairs = member.where("component <> other_component").select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b"))
        pairs = written(pairs.distinct(), f"pairs-{turn}")
        before, more = links, _verified(pairs, reps, source, n, percent, str(turn))
        links = written(before.union(more), "links")
        for table in (before, more, pairs, apart):
            removed(table)
        if last:
            break
    comp = connected_components(links).withColumnRenamed("node", "rep")
    of_class = classes.join(comp, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    return sets.join(of_class, ["s1", "s2"], "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc"))).select(_id("doc").alias(id_col), "n_shingles", _id("component").alias("component_id"))


def _apart(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a group and that sizes and sketches let link.

    Large groups are cut into blocks, and each pair of blocks is compared as arrays, by a task of its own: only pairs
    that pass become rows."""
    blocks = members.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("key", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "doc", "component", "n", "sketch")
    dealt = blocks.repartition(partitions(members), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for group in runs(batches, ["key", "i", "j"]):
            doc, comp, n = (np.array(group.column(c)) for c in ("doc", "component", "n"))
            sketches = [np.frombuffer(x, dtype=np.uint64) for x in group.column("sketch").to_pylist()]
            least = min(map(len, sketches))
            bits = np.stack([np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in sketches])
            block, i, j = np.array(group.column("block")), group.column("i")[0].as_py(), group.column("j")[0].as_py()
            for k in np.flatnonzero(block == i):
                rest = np.flatnonzero((block == j) & (comp != comp[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])))
                if i == j:
                    rest = rest[rest > k]
                differ = np.bitwise_count(bits[rest] ^ bits[k]).sum(1)
                rest = rest[differ <= (100 - percent) * (n[rest] + n[k]) // (100 + percent)]
                if len(rest):
                    found.append(np.stack([np.minimum(doc[rest], doc[k]), np.maximum(doc[rest], doc[k])], 1))
            if sum(map(len, found)) > 50_000:
                yield _pair_batch(found)
                found = []
        if found:
            yield _pair_batch(found)

    return dealt.mapInArrow(run, "a long, b long")


def _pair_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])
