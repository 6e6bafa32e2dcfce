"""The pipeline against a plain version of its stages over whole documents."""

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import classifier, quality_rules, store
from tokenizers import Tokenizer

from tests.llm.test_chosen_path import brute as links
from tests.llm.test_suffix_dedup import kept_bytes
from tidemark.llm import tokens

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    good = {r.doc_id for r in classifier.classified(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect() if r.predicted}
    now = store.written(spark, stages["quality classifier"](spark, docs, DATA), "t")
    assert now.columns == columns and {r.doc_id for r in now.collect()} == good
    kept = {r.doc_id for r in quality_rules.judged(quality_rules.ledger(now), "v1").collect() if r.kept}
    now = store.written(spark, stages["quality rules"](spark, now, DATA), "t")
    assert now.columns == columns and {r.doc_id for r in now.collect()} == kept
    rows = [(r.doc_id, r.text) for r in now.collect()]
    groups = {d: g for d, g, _ in links(rows)}
    now = store.written(spark, stages["n-gram Jaccard join"](spark, now, DATA), "t")
    assert now.columns == columns and {r.doc_id for r in now.collect()} == {d for d, g in groups.items() if d == g}
    rows = [(r.doc_id, r.text) for r in now.collect()]
    want = {d: b.decode("utf-8", "ignore") for (d, _), b in zip(rows, kept_bytes([t for _, t in rows]))}
    now = store.written(spark, stages["suffix-array dedup"](spark, now, DATA), "t")
    left = {r.doc_id: r for r in now.collect()}
    assert now.columns == columns and {d: (r.text, r.n_chars) for d, r in left.items()} == {d: (t, len(t)) for d, t in want.items()}
    pieces = stages["packing"](spark, now, DATA)
    lib = Tokenizer.from_file(tokens.resolve(corpus_pipeline.TOKENIZER))
    total = sum(len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in left.values())
    assert pieces.agg(F.sum("length")).first()[0] == total and pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n < 2048").count() <= 1


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0
