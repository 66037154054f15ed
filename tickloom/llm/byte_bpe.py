"""Byte-level BPE as a tree reduction, over texts of any length.

Two monoids, both reduced from halves:

* Within a piece (one match of the split pattern) an element is a list of token ids. Two
  neighbours join by encoding a window of tokens around their border again; the window
  grows until the tokens at its edges stand against their outer neighbours. A token pair
  stands if encoding its bytes gives that pair. Merges inside a token never depend on
  bytes outside it as long as no merge crosses its edges, so a sequence whose tokens and
  neighbouring pairs all stand is the encoding: tokens outside the window keep their ids.
* Within a text an element is a list of pieces and their ids. A piece of the left part is
  final if it ends before the part does and starts three or more characters before that
  end (no alternative of the pattern looks further). The rest, and a growing stretch of
  the right part, are split again until a border falls on one that the right part has.

Decoding concatenates the tokens' bytes up the same tree. Null and empty texts have no tokens.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import put, schema_with, slices

#: Leaves of the trees. What a piece was reduced to is kept for the next time that it comes.
LEAF_CHARS = 512
LEAF_BYTES = 4
CACHED_PIECES, CACHED_WINDOWS, CACHED_CHARS = 400_000, 150_000, 32
#: How far before its middle a text is cut if there is a space.
NEAR = 64
CACHED_PAIRS = 150_000
#: Characters from its start that decide on a piece besides its own: the longest contraction.
LOOK = 3


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """A tiktoken rank file: a token in base 64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines.splitlines() if x)}


class _Cache(dict):
    """What make gives for each key, kept for keys of up to longest, until there are most of them."""

    def __init__(self, make, most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.packed = _Cache(lambda piece: _pack(self.piece(piece.encode())), CACHED_PIECES, CACHED_CHARS)
        self._pairs = _Cache(lambda pair: self.merged(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]), CACHED_PAIRS, 2)
        self._windows = _Cache(self.merged, CACHED_WINDOWS, CACHED_CHARS)
        #: How often elements were joined: of token ids, and of pieces.
        self.joins = [0, 0]

    # Token ids within a piece.

    def merged(self, data: bytes) -> list[int]:
        """The lowest-ranked neighbours merge, leftmost first, until no pair is a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get, none = self.ranks.get, len(self.ranks) + 1
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def halves(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self._windows[data]
        middle = len(data) // 2
        return self.joined(self.halves(data[:middle]), self.halves(data[middle:]))

    def joined(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b:
            return a or b
        self.joins[0] += 1
        window = self._pairs[a[-1], b[0]]
        if len(window) == 2 and window[0] == a[-1]:  # it stands, and so do the pairs within either part
            return a + b
        left = right = 1
        while True:
            grow_left = left < len(a) and not self._stands(a[-left - 1], window[0])
            grow_right = right < len(b) and not self._stands(window[-1], b[right])
            if not grow_left and not grow_right:
                return a[:-left] + window + b[right:]
            left = min(len(a), left * 2) if grow_left else left
            right = min(len(b), right * 2) if grow_right else right
            window = self._windows[b"".join(map(self.bytes_of.__getitem__, (*a[-left:], *b[:right])))]

    def _stands(self, i: int, j: int) -> bool:
        own = self._pairs[i, j]
        return len(own) == 2 and own[0] == i

    def piece(self, data: bytes) -> list[int]:
        return [self.ranks[data]] if data in self.ranks else self.halves(data)

    # Pieces within a text.

    def pieces(self, text: str) -> tuple[list[str], list[bytes]]:
        """The pieces of a text, and the ids of each as little-endian 32-bit integers."""
        if len(text) <= LEAF_CHARS:
            found = self.split(text)
            return found, list(map(self.packed.__getitem__, found))
        middle = len(text) // 2
        space = text.rfind(" ", middle - NEAR, middle)  # before a space the halves seldom cut a piece in two
        middle = space if space > 0 else middle
        return self.joined_texts(text[:middle], self.pieces(text[:middle]), text[middle:], self.pieces(text[middle:]))

    def joined_texts(self, ta: str, a: tuple[list[str], list[bytes]], tb: str, b: tuple[list[str], list[bytes]]) -> tuple[list[str], list[bytes]]:
        (pa_, ia), (pb, ib) = a, b
        self.joins[1] += 1
        tail = open_ = 0
        for p in reversed(pa_):
            if tail and tail + len(p) >= LOOK:  # it ends before the part, and starts early enough
                break
            tail += len(p)
            open_ += 1
        grow = 64
        while True:
            window = ta[len(ta) - tail :] + tb[:grow]
            found = self.split(window)
            if (end := self._border(found, len(window) if grow < len(tb) else 0, tail, pb)) is not None:
                break
            grow *= 2
        taken, skipped = end
        new_p, new_i = found[:taken], []
        for p in new_p:
            if open_ and skipped and len(p) > CACHED_CHARS and p == pa_[-1] + pb[0]:
                ids = self.joined(np.frombuffer(ia[-1], "<u4").tolist(), np.frombuffer(ib[0], "<u4").tolist())
                new_i.append(_pack(ids))
            else:
                new_i.append(self.packed[p])
        keep = len(pa_) - open_
        pa_[keep:], ia[keep:] = new_p, new_i
        pa_ += pb[skipped:]
        ia += ib[skipped:]
        return pa_, ia

    @staticmethod
    def _border(found: list[str], cut: int, tail: int, right: list[str]) -> tuple[int, int] | None:
        """How many window pieces and right pieces end at the first border that both have, past the tail.

        cut: where the window breaks off inside the right part; 0 if it reaches its end.
        """
        at, own, n = 0, tail, 0
        if not tail:
            return 0, 0
        for k, p in enumerate(found):
            if cut and (at + len(p) >= cut or at + LOOK > cut):
                return None
            at += len(p)
            while own < at and n < len(right):
                own += len(right[n])
                n += 1
            if at == own and at >= tail:
                return k + 1, n
        return None

    def forget(self) -> None:
        """Empties the caches: a worker that lives on after its task keeps only the vocabulary."""
        self.packed.clear()
        self._windows.clear()
        self._pairs.clear()

    # Whole texts.

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(text)[1]), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


_codecs: dict[tuple, Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    key = (id(ranks), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(ranks.value), pattern)
    return _codecs[key]


#: What a rank file may have to be sent to every executor.
MOST_RANK_BYTES = 64_000_000


def _ranks(df: DataFrame, path: str):
    with open(path, "rb") as f:  # the vocabulary belongs to the installed tokenizers, not to the data
        lines = f.read(MOST_RANK_BYTES + 1)
    if len(lines) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary")
    return df.sparkSession.sparkContext.broadcast(lines)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """docs with ids (binary: the tokens of text_col as little-endian 32-bit integers), n_tokens, and the bytes that
    the ids decode to if asked for. Older columns of these names give way."""
    ranks = _ranks(docs, ranks_path)
    added = {"ids": T.BinaryType(), "n_tokens": T.LongType()} | ({"decoded": T.BinaryType()} if decoded else {})
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added]).withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    schema = schema_with(docs, **added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in slices(batches, text_col):
            ids = [codec.encode(t or "") for t in batch.column(text_col).to_pylist()]
            values = {"ids": pa.array([x.tobytes() for x in ids], pa.binary()), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
            if decoded:
                values["decoded"] = pa.array([codec.decode(x) for x in ids], pa.binary())
            yield put(batch, schema, **values)
        codec.forget()

    return docs.mapInArrow(run, schema)


def bpe_decode(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """docs with decoded (binary), the bytes of the tokens in ids_col (as bpe_encode gives them; null: none)."""
    ranks = _ranks(docs, ranks_path)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "decoded"])
    schema = schema_with(docs, decoded=T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            yield put(batch, schema, decoded=pa.array([codec.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(ids_col).to_pylist()], pa.binary()))

    return docs.mapInArrow(run, schema)
