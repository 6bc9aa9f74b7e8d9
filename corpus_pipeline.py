"""A training corpus from raw documents: good texts, one of each group of copies, without personal data, mixed by source, as token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm import bpe, mixing, nearcopies, pii, quality
from lithic.llm.common import table
from lithic.session import cut

#: Part of the encoder's memory that its workers use after the stages before, when Spark's heap has grown to its limit.
ENCODER_SHARE = 1 / 6
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars after `text` has changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects; it learns from the labels of the documents at hand."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, verified similarity of 0.8."""
    return nearcopies.representatives(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return _measured(pii.redacted(docs))


def mixed_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take words of each source near its target; a document taken twice is there twice, one taken in part is cut."""
    return _measured(mixing.mixed(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): the ids of each text, and whether they decode to it."""
    keyed = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    coded = bpe.encoded(keyed, RANKS, public_tokenizers.PATTERN, ("doc_id", "lang", "source", "sha"), ENCODER_SHARE)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [
    ("quality classifier", good_texts),
    ("near-dedup", one_of_each_group),
    ("PII", without_personal_data),
    ("mixing sources", mixed_by_source),
    ("BPE encoding", token_ids),
]
#: The classifier, the field and the byte pairs cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
