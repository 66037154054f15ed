"""From raw documents to tokens: quality, repeated lines, near duplicates, benchmark leaks, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but
the last return the columns of documents; n_chars follows the text. Null and empty texts and
null ids are handled as the operators say. The near-duplicate stage takes each text of an id, or
of the null id, as a document of its own; only rows that repeat both id and text become one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.byte_bpe import bpe_encode
from tickloom.llm.decontaminate import find_leaks
from tickloom.llm.jaccard_join import jaccard_components, with_keys
from tickloom.llm.line_dedup import line_dedup
from tickloom.llm.quality import learn_quality, score_quality
from tickloom.llm.shared import id_key, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, does not reject."""
    net = learn_quality(docs, _table(spark, sf_dir, "labels"))
    return score_quality(docs, net).where("predicted = 1").select(docs.columns)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the last of them only."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    n_rows, n_ids = docs.agg(F.count("*"), F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).first()
    if n_rows != n_ids:
        columns, docs = docs.columns, with_keys(docs, "doc_id", "text")
        key = docs.columns[0]
        groups = jaccard_components(docs, key, n=5, percent=80).join(docs.select(key, "doc_id"), key)
        kept = groups.groupBy("component_id").agg(F.min(F.struct(id_key("doc_id").alias("doc_id"), F.col(key).alias("key"))).alias("first")).select(F.col("first.key").alias(key))
        return docs.join(kept.hint("shuffle_hash"), key, "left_semi").select(columns)
    groups = jaccard_components(docs, n=5, percent=80)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def no_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage was found."""
    return find_leaks(docs, _table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers), and whether they decode to the text again."""
    coded = bpe_encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", unrepeated_lines),
    ("near_duplicates", no_near_duplicates),
    ("decontamination", no_benchmark_leaks),
    ("byte_bpe", tokens),
]

#: The classifier is not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
