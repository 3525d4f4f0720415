"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest, markov, matroska, periods, ppm, ring, seeds, store, subword, suffixes, templates, viterbi, whitening
from .common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = templates.dedup_lines(spark, read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.tokenised(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.leaks(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.shard(spark, read(spark, sf_dir, "documents"), shards=16, slack=None)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(spark, read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(spark, read(spark, sf_dir, "documents")).drop("kept")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(spark, read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.classify(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify(spark, read(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark, read(spark, sf_dir, "embeddings"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.digest(markov.scan(spark, read(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.with_runs(spark, periods.looped(read(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_store": op2_token_store,
    "op3_decontamination": op3_decontamination,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_sharding": op5_sharding,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_media_columns": op8_media_columns,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_secret_scan": op12_secret_scan,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": templates.SQL, "op12_secret_scan": markov.SQL, "op13_periodic_runs": periods.SQL}
