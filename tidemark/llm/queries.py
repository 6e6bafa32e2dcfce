"""The queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, quality_rules, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, with_crc

    return with_crc(pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nn_descent import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import digests, write_shards

    shards = write_shards(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
    return digests(spark, shards)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import codec_digests

    return codec_digests(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged, ledger

    return judged(ledger(table(spark, sf_dir, "documents")), "v1")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import classified

    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removed

    return removed(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import digests, write_archives

    return digests(spark, write_archives(table(spark, sf_dir, "pages")))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosen_path import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents")).drop("text_hash")


OPERATORS = (
    op1_packing, op2_quality_rules, op3_quality_classifier, op4_embedding_near_dedup, op5_token_output,
    op6_license_scan, op7_bpe, op8_suffix_dedup, op9_warc, op10_ngram_jaccard_join,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

ORACLES: dict[str, str] = {"op2_quality_rules": quality_rules.oracle("v1"), "op6_license_scan": licenses.oracle(), "op9_warc": warc.ORACLE}
