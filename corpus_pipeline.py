"""From raw documents to packed training sequences, in stages that are written and read again one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chosen_path, classifier, packing, quality_rules, store, suffix_dedup

TOKENIZER = "byte_bpe_50k.json"
POLICY = "v1"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, predicts to be good."""
    return classifier.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' policy keeps."""
    return quality_rules.kept_documents(docs, POLICY)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return chosen_path.first_of_groups(docs)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the strings that repeat; ``n_chars`` follows the text."""
    left = suffix_dedup.without_repeats(docs)
    return left.withColumn("n_chars", F.char_length("text").cast(left.schema["n_chars"].dataType)) if "n_chars" in left.columns else left


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length sequences."""
    return packing.with_crc(packing.pack(docs, TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_filter),
    ("n-gram Jaccard join", ngram_jaccard),
    ("suffix-array dedup", suffix_array),
    ("packing", pack),
]

#: Training, chosen paths and tokenizers have no SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
