"""The registered queries of the corpus operators and the SQL that states the same result, where SQL can."""

from __future__ import annotations

from zlib import crc32

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm import ballkmeans, bpe, imatch, kdtree, language, mixing, passages, periodic, pii, quality, setjoin, simhash, substrings
from lithic.llm.common import table


def op1_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.summary(table(spark, sf_dir, "documents"))


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.with_next(table(spark, sf_dir, "documents"))


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op5_bwt_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents")).drop("spans")


def pii_rows(docs: DataFrame) -> DataFrame:
    found = pii.detect(docs)
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_rows(table(spark, sf_dir, "documents"))


def op7_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: The rank file of the registered query and of the pipeline.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def bpe_rows(docs: DataFrame) -> DataFrame:
    coded = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_rows(table(spark, sf_dir, "documents"))


def op11_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballkmeans.compress(table(spark, sf_dir, "embeddings"))


def stretched(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document, by crc32 of its id, from one place on replaced by repetitions of those that follow it."""
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_dyadic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.detect(table(spark, sf_dir, "documents"), stretched))


def op13_toccurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.groups(table(spark, sf_dir, "documents"))


_ALL = (
    op1_collinear_passages, op2_imatch_fingerprints, op3_ppm_language, op4_simhash_gray, op5_bwt_substrings, op6_pii_crf, op7_rff_quality, op8_mixing_schedule,
    op9_kdtree_topk, op10_bpe_transducer, op11_ball_codes, op12_dyadic_runs, op13_toccurrence_join,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op8_mixing_schedule": mixing.SQL.strip(), "op9_kdtree_topk": kdtree.SQL.strip(), "op11_ball_codes": ballkmeans.sql(), "op13_toccurrence_join": setjoin.SQL.strip()}
