"""Language identification by a linear-chain conditional random field over words.

Each word is scored for each language by features with learned weights: the word itself
(lexicon), its first and last bytes with the word border (affixes), and its byte n-grams.
Learned transitions score neighbouring words' languages. Forward-backward over chains of
consecutive words gives each word's probabilities, so in code-switched text every stretch is
labelled on its own. A text's chains overlap: each labels CHAIN words and sees CONTEXT more on
either side, beyond which a word hardly weighs. A text's language is the one with the largest
share of probability over all its words.

Learning takes a bounded sample of texts of each language to the driver and mixes stretches
of them into code-switched chains. Labelling is one pass over the documents without a
shuffle: each distinct word of a batch is scored once, and all chains of a batch advance
together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import fold
from .shared import put, sample_window, schema_with, slices
from .words import Words, cut, mix

CHAIN, CONTEXT = 64, 8
SLOTS = 1 << 18
#: Languages that get so many slots; with more of them, slots are fewer, so that a model's size stays.
FULL_SIZE_LANGUAGES = 200
#: The learning sample: texts of each language, texts in all, and characters of each (of longer texts a stretch).
SAMPLE_PER_LANGUAGE, SAMPLE_TEXTS, SAMPLE_CHARS = 250, 50_000, 10_000
#: Languages whose counts are sent to every task; more are joined.
MOST_BROADCAST = 100_000
EPOCHS, BATCH, RATE = 2, 64, 0.3
_LETTER = regex.compile(r"\p{L}")


def slots_for(languages: int) -> int:
    return SLOTS >> max(0, (languages - 1) // FULL_SIZE_LANGUAGES).bit_length()


def word_features(words: list[bytes], n_slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all words in one array, and where each word's start: n-grams of 2 and 3 bytes (those at the
    ends hold the border, so they are short affixes), the 4 bytes at either end, and the whole word."""
    data = np.frombuffer(b"\0\0\0" + b"".join(w + b"\0\0\0" for w in words), dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    start = 3 + np.concatenate([[0], np.cumsum(lengths + 3)[:-1]]).astype(np.int64)
    per = 2 * lengths + 4  # 2-grams from -1, 3-grams from -1 but the last, two affixes, the word
    first = np.concatenate([[0], np.cumsum(per)])
    row = np.repeat(np.arange(len(words)), per)
    k = np.arange(first[-1]) - first[row]
    n = lengths[row]
    at = start[row] - 1 + np.where(k <= n, k, k - n - 1)
    gram = data[at] | data[at + 1] << np.uint64(8)
    gram |= np.where(k > n, data[np.minimum(at + 2, len(data) - 1)] << np.uint64(16) | np.uint64(1 << 60), np.uint64(0))
    pre = data[start] | data[start + 1] << np.uint64(8) | data[start + 2] << np.uint64(16) | data[np.minimum(start + 3, len(data) - 1)] << np.uint64(24)
    end = start + lengths
    suf = data[end - 1] | data[end - 2] << np.uint64(8) | data[end - 3] << np.uint64(16) | data[np.maximum(end - 4, 0)] << np.uint64(24)
    gram[first[1:] - 3] = pre | np.uint64(2 << 60)
    gram[first[1:] - 2] = suf | np.uint64(3 << 60)
    whole = np.array([hash_bytes(w) for w in words], dtype=np.uint64)
    gram[first[1:] - 1] = whole
    return (mix(gram) & np.uint64(n_slots - 1)).astype(np.int64), first[:-1]


def hash_bytes(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


@dataclass
class Chain:
    languages: list[str]
    weights: np.ndarray  # slots x languages
    moves: np.ndarray  # from x to
    start: np.ndarray

    def emissions(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[slots], first, axis=0) if len(first) else np.zeros((0, len(self.languages)))

    def forward_backward(self, scores: np.ndarray, lengths: np.ndarray):
        """Word probabilities, and expected numbers of moves, of padded chains (chain x place x language)."""
        n, places, m = scores.shape
        inside = np.arange(places)[None, :] < lengths[:, None]
        e = np.exp(np.clip(scores - scores.max(2, keepdims=True), -50, 0))
        e[~inside] = 1
        move = np.exp(self.moves - self.moves.max())
        keep = np.eye(m)
        a, b = np.empty_like(e), np.empty_like(e)
        x = np.exp(self.start - self.start.max()) * e[:, 0]
        a[:, 0] = x / x.sum(1, keepdims=True)
        for t in range(1, places):
            x = np.where(inside[:, t, None], (a[:, t - 1] @ move) * e[:, t], a[:, t - 1])
            a[:, t] = x / x.sum(1, keepdims=True)
        b[:, -1] = 1 / m
        for t in range(places - 2, -1, -1):
            x = np.where(inside[:, t + 1, None], (b[:, t + 1] * e[:, t + 1]) @ move.T, b[:, t + 1])
            b[:, t] = x / x.sum(1, keepdims=True)
        p = a * b
        p /= p.sum(2, keepdims=True)
        return p, (a, b, e, move, inside, keep)


def _slots_of(words: Words, n_slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots of the distinct words, where each starts, and which distinct word stands at each place."""
    _, one, which = np.unique(words.hashes, return_index=True, return_inverse=True)
    data = words.data.tobytes()
    slots, first = word_features([data[words.starts[i] : words.ends[i]] for i in one], n_slots) if len(one) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return slots, first, which


def _chains(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each chain: the first and the end of the words that it labels, and of those that it sees."""
    counts = words.counts
    per = -(-counts // CHAIN)
    row = np.repeat(np.arange(len(counts)), per)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = words.first[row] + k * CHAIN
    end = np.minimum(start + CHAIN, words.first[row + 1])
    return start, end, np.maximum(start - CONTEXT, words.first[row]), np.minimum(end + CONTEXT, words.first[row + 1])


def label_words(model: Chain, words: Words) -> np.ndarray:
    """Each word's probabilities of the languages."""
    slots, first, which = _slots_of(words, len(model.weights))
    scores = model.emissions(slots, first)
    out = np.empty((len(words.starts), len(model.languages)))
    chains = _chains(words)
    for k in range(0, len(chains[0]), 4096):
        start, end, low, high = (c[k : k + 4096, None] for c in chains)
        at = low + np.arange(CHAIN + 2 * CONTEXT)[None, :]
        p, _ = model.forward_backward(scores[which[np.minimum(at, len(which) - 1)]], (high - low)[:, 0])
        own = (at >= start) & (at < end)
        out[at[own]] = p[own]
    return out


def learn(texts: list[bytes], languages: list[str], seed: int = 1) -> Chain:
    """Fits the field by stochastic gradient ascent (AdaGrad) on code-switched chains mixed from the texts."""
    names = sorted(set(languages))
    m, rng = len(names), np.random.default_rng(seed)
    n_slots = slots_for(m)
    model = Chain(names, np.zeros((n_slots, m)), np.zeros((m, m)), np.zeros(m))
    if m < 2:
        return model
    words = cut(pa.array(texts, pa.binary()).cast(pa.string()), lower=True)
    slots, first, which = _slots_of(words, n_slots)
    ends = np.append(first[1:], len(slots))
    label = np.array([names.index(x) for x in languages])[words.rows()]
    # stretches of 4 to 24 words, in random order, make the chains
    cuts, at = [], 0
    while at < len(which):
        cuts.append(at)
        at += int(rng.integers(4, 25))
    pieces = [np.arange(s, e) for s, e in zip(cuts, [*cuts[1:], len(which)], strict=True)]
    seen_w, seen_m, seen_s = np.full((n_slots, m), 1e-3), np.full((m, m), 1e-3), np.full(m, 1e-3)
    for _ in range(EPOCHS):
        order = np.concatenate([pieces[i] for i in rng.permutation(len(pieces))])
        order = order[: max(CHAIN, len(order) // CHAIN * CHAIN)]
        n_chains = -(-len(order) // CHAIN)
        for s in range(0, n_chains, BATCH):
            own = order[s * CHAIN : (s + BATCH) * CHAIN]
            n = -(-len(own) // CHAIN)
            lengths = np.full(n, CHAIN)
            lengths[-1] = len(own) - (n - 1) * CHAIN
            place = np.append(own, np.zeros(n * CHAIN - len(own), dtype=np.int64)).reshape(n, CHAIN)
            distinct, back = np.unique(which[own], return_inverse=True)
            sizes = ends[distinct] - first[distinct]
            feature = slots[np.repeat(first[distinct], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            offsets = np.cumsum(sizes) - sizes
            e = model.emissions(feature, offsets)
            scores = e[np.append(back, np.zeros(n * CHAIN - len(own), dtype=np.int64))].reshape(n, CHAIN, m)
            p, (a, b, ex, move, inside, _) = model.forward_backward(scores, lengths)
            truth = np.zeros_like(p)
            np.put_along_axis(truth, label[place][:, :, None], 1, 2)
            g = (truth - p)[inside]
            g_word = np.zeros((len(distinct), m))
            np.add.at(g_word, back, g)
            g_slot = np.repeat(g_word, sizes, 0)
            used, of = np.unique(feature, return_inverse=True)
            total = np.zeros((len(used), m))
            np.add.at(total, of, g_slot)
            both = inside[:, 1:]
            pair = a[:, :-1, :, None] * move[None, None] * (b[:, 1:] * ex[:, 1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            g_move = (truth[:, :-1, :, None] * truth[:, 1:, None, :] - pair)[both].sum(0)
            g_start = (truth[:, 0] - p[:, 0]).sum(0)
            seen_w[used] += total**2
            seen_m += g_move**2
            seen_s += g_start**2
            model.weights[used] += RATE * total / np.sqrt(seen_w[used])
            model.moves += RATE * g_move / np.sqrt(seen_m)
            model.start += RATE * g_start / np.sqrt(seen_s)
    model.weights = model.weights.astype(np.float32)
    return model


def learn_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE, most_texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS,
) -> Chain:
    """Learns from up to per_language rows of each language, the first by a hash of their ids, outside the held-out third,
    and of a text longer than chars from a stretch of so many characters.

    If languages are so many that this makes over most_texts rows, each gives fewer. Rows without id, language or text
    teach nothing. Rows are counted and drawn over ids and languages alone; one pass reads the drawn ones' texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (fold("id") != 1))
    drawn = rows.select("id", "lang")
    counts = drawn.groupBy("lang").agg(F.count("*").alias("rows"))
    small = F.broadcast if counts.count() <= MOST_BROADCAST else lambda df: df
    # by its rows' number a language lets about twice per_language of them through, so no task ranks all of one
    place = F.pmod(F.xxhash64("id"), F.lit(2**32)).cast("double") * F.col("rows")
    drawn = drawn.join(small(counts), "lang").where(place < 2 * per_language * 2**32)
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")))
    # the first of all languages go before the second
    picked = ranked.where(F.col("rank") <= per_language).orderBy("rank", F.xxhash64("id"), "id", "lang").limit(most_texts).select("id", "lang").collect()
    if not picked:
        return learn([], [])
    ids = spark.createDataFrame(sorted({tuple(r) for r in picked}), "id long, lang string")
    texts = rows.join(F.broadcast(ids), ["id", "lang"]).select("id", "lang", sample_window(F.col("text"), F.col("id"), chars).alias("text"))
    sample = sorted(map(tuple, texts.groupBy("id", "lang").agg(F.max("text").alias("text")).dropna().collect()))
    return learn([t.encode() for _, _, t in sample], [name for _, name, _ in sample])


def predict_language(docs: DataFrame, model: Chain, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1, the share of probability of lang_pred over all words).

    lang_pred is "und", with score 0, if the text is null or has no letter, or if nothing was learned. Ties go to the
    first language by name. Older columns of these names give way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    schema = schema_with(docs, lang_pred=T.StringType(), score=T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text_col):
            words = cut(batch.column(text_col), lower=True)
            total = np.zeros((len(words.starts) + 1, max(1, len(model.languages))))
            if model.languages and len(words.starts):
                np.cumsum(label_words(model, words), axis=0, out=total[1:])
            share = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(words.counts, 1)[:, None]
            best = share.argmax(1)
            named = np.array([bool(model.languages) and t is not None and _LETTER.search(t) is not None for t in batch.column(text_col).to_pylist()], dtype=bool)
            lang = [model.languages[k] if ok else "und" for k, ok in zip(best, named, strict=True)]
            score = np.where(named, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0)
            yield put(batch, schema, lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()))

    return docs.mapInArrow(run, schema)
