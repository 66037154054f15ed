"""License scans over a positional index of rare licence words, in DataFrame functions only.

Templates are licence notices, each with a mandatory key phrase; base phrases are templates of
their own. All of them are rows of small tables, so the plan is the same for ten or a thousand.

1. One pass splits the texts and writes, for each file, where words of templates stand.
2. These words are counted over all files. The rarest (highest IDF) words of each template's
   key phrase are its postings: (word, template, offset). The rarest of all is its anchor.
3. A file's anchors look up templates; one stays if the file has all words of its key phrase.
   The file's places of posted words, less their offsets, are starts, and a start at which
   every posting of the template agrees goes on.
4. Template words meet the file's places in a join by (file, place, word): a start is verified
   if the whole key phrase stands there, and its score is the IDF share of the template's
   words that stand at theirs.

Files are known by 128 bits of hash of their text, so that copies are scanned once. Only files
that an anchor looked up take part in shuffles, with their places of template words.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES, Template
from .shared import unused, written

#: Phrases and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
POSTED = 3
LABEL_SCORE = 0.8
#: Template words that are sent to every task (some 50 bytes each); more are joined.
BROADCAST_WORDS = 200_000
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(low, F.lit(f"({_WORD})"), F.lit(1))


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def key_place(template: Template) -> int:
    """Where the key phrase starts among the template's words."""
    words, key = words_of(template.text), words_of(template.key)
    for i in range(len(words) - len(key) + 1):
        if key and words[i : i + len(key)] == key:
            return i
    raise ValueError(f"the key phrase of {template.label} must stand in its text")


def rarity(n_files: int, n_with: int) -> float:
    """IDF of a word: more than zero even if every file has it."""
    return math.log(1 + max(1, n_files) / (1 + n_with))


def _tables(files: DataFrame, templates: list[Template]) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """anchors (w, template, needed, posted), postings (w, template, offset, n_postings), words (template, w, offset, weight,
    in_key, n_key, label, base), and the anchor words. Offsets count from the start of the key phrase."""
    spark, n = files.sparkSession, files.count()
    counts = dict(files.select(F.explode(F.array_distinct("places.w")).alias("w")).groupBy("w").count().collect())  # a row for each template word at most
    anchors, postings, rows = [], [], []
    for t, template in enumerate(templates):
        words, key, at = words_of(template.text), words_of(template.key), key_place(template)
        idf = {w: rarity(n, counts.get(w, 0)) for w in words}
        posted = sorted(set(key), key=lambda w: (-idf[w], w))[:POSTED]  # noqa: B023
        anchors.append((posted[0], t, sorted(set(key)), posted))
        own = [(w, i) for i, w in enumerate(key) if w in posted]
        postings += [(w, t, i, len(own)) for w, i in own]
        total = sum(idf[w] for w in words)
        base = t < len(BASE_PHRASES)
        rows += [(t, w, i - at, idf[w] / total, at <= i < at + len(key), len(key), template.label, base) for i, w in enumerate(words)]
    small = F.broadcast if len(rows) <= BROADCAST_WORDS else lambda df: df
    return (
        small(spark.createDataFrame(anchors, "w string, template int, needed array<string>, posted array<string>")),
        small(spark.createDataFrame(postings, "w string, template int, offset int, n_postings int")),
        small(spark.createDataFrame(rows, "template int, w string, offset int, weight double, in_key boolean, n_key int, label string, base boolean")),
        sorted({w for w, *_ in anchors}),
    )


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, keep_text: bool = True) -> DataFrame:
    """docs (without keep_text: but for its text) with n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places where a base phrase's words stand one after another; first_word and
    last_word are the least and largest of them (null without any). base_labels are those phrases'
    labels; labels also have those of templates with a verified key phrase and a score of
    LABEL_SCORE or more. score is the best template's, from 0 to 1. Null and empty texts have no
    words, no labels and score 0. Older columns of these names give way. Repeated rows are each
    answered.
    """
    every = [*(Template(label, phrase, phrase) for phrase, label in BASE_PHRASES.items()), *templates]
    vocabulary = sorted({w for t in every for w in words_of(t.text)})
    gone = {c for c in docs.columns if c.lower() in RESULTS and c != text_col} | (set() if keep_text else {text_col})
    kept = [c for c in docs.columns if c not in gone]
    words = unused(docs, "words")[0]
    text = F.col(f"`{text_col}`").cast("string")
    placed = F.array_compact(F.transform(F.col(words), lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("p")))))
    names = {c: f"c{k}" for k, c in enumerate(kept)}  # so that none of docs' names matters below
    files = docs.withColumn(words, license_words(text)).select(
        *(F.col(f"`{c}`").alias(a) for c, a in names.items()), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"), F.size(words).cast("long").alias("n_words"), placed.alias("places")
    )
    files = written(files, "licence-words")

    anchors, postings, template_words, anchor_words = _tables(files, every)
    places = files.select("t1", "t2", "places").withColumn("w", F.explode(F.filter(F.array_distinct("places.w"), lambda w: w.isin(anchor_words))))
    fetched = places.join(anchors, "w").where(F.size(F.array_except("needed", "places.w")) == 0).select("t1", "t2", "template", "posted", "places")
    fetched = written(fetched.dropDuplicates(["t1", "t2", "template"]), "licence-candidates")
    hits = fetched.select("t1", "t2", "template", F.explode(F.filter("places", lambda h: F.array_contains("posted", h["w"]))).alias("h")).select("t1", "t2", "template", "h.w", "h.p")
    starts = hits.join(postings, ["template", "w"]).groupBy("t1", "t2", "template", (F.col("p") - F.col("offset")).alias("start")).agg(F.count("*").alias("n"), F.first("n_postings").alias("n_postings"))
    starts = starts.where("n = n_postings and start >= 0").select("t1", "t2", "template", "start")
    expected = starts.join(template_words, "template").withColumn("p", F.col("start") + F.col("offset"))
    standing = fetched.select("t1", "t2", "places").dropDuplicates(["t1", "t2"]).select("t1", "t2", F.explode("places").alias("h")).select("t1", "t2", "h.w", "h.p")
    met = expected.join(standing, ["t1", "t2", "p", "w"]).groupBy("t1", "t2", "template", "start").agg(
        F.sum("weight").alias("share"), F.count_if("in_key").alias("key_words"), F.first("n_key").alias("n_key"), F.first("label").alias("label"), F.first("base").alias("base")
    )
    good = met.where("key_words = n_key")
    place, labelled = F.when(F.col("base"), F.col("start")), F.col("base") | (F.col("share") >= LABEL_SCORE - 1e-9)
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    found = good.groupBy("t1", "t2").agg(
        F.count(place).alias("n_base"), F.min(place).cast("long").alias("first_word"), F.max(place).cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(labelled).alias("labels"), F.least(F.coalesce(F.max(F.when(~F.col("base"), F.col("share"))), F.lit(0.0)), F.lit(1.0)).alias("score"),
    )
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    out = files.drop("places").join(written(found, "licences"), ["t1", "t2"], "left")
    return out.select(*(F.col(a).alias(c) for c, a in names.items()), *(F.coalesce(c, F.lit(none[c])).alias(c) if c in none else F.col(c) for c in RESULTS))
