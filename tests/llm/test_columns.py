"""Stages of the pipeline over tables with clashing and odd column names, nulls, repeated rows and no rows."""

from pyspark.sql import functions as F

from tidemark.llm import chosen_path, classifier, packing, quality_rules

DATA = "/root/testdata/sf0.001"
ODD = ["a.b", "th", "own", "_id", "_h", "_row", "k0", "fp", "text_hash", "score"]


def odd(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 2000").limit(40)
    docs = docs.union(docs.limit(1)).union(docs.limit(1).withColumn("doc_id", F.lit(None)).withColumn("text", F.lit(None)))
    return docs.withColumns({c: F.lit(f"own {c}") for c in ODD})


def test_filters_keep_every_column(spark):
    docs, labels = odd(spark), spark.read.parquet(f"{DATA}/labels.parquet")
    for stage in (lambda d: classifier.kept(d, labels), lambda d: quality_rules.kept_documents(d, "v1"), chosen_path.first_of_groups):
        rows = stage(docs)
        assert rows.columns == docs.columns
        kept = rows.collect()
        assert kept and all(r[c] == f"own {c}" for r in kept for c in ODD)
        assert stage(docs.limit(0)).collect() == []
    once = [r.doc_id for r in kept]  # of the last stage: one of each repeated row, and the null text
    assert len(once) == len(set(once)) and None in once


def test_registered_packing_over_a_table(spark):
    from tidemark.llm import queries, tokens

    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    own = tokens.ChunkEncoder("byte_bpe_50k.json")
    want = {d.doc_id: len(own.library.encode(d.text or "", add_special_tokens=False).ids) + 1 for d in docs}
    pieces = queries.op1_packing(spark, DATA).collect()
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
        assert p.doc_tokens == want[p.doc_id] and 0 <= p.offset < p.offset + p.length <= 2048
    assert got == want
    assert packing.pack(odd(spark), "byte_bpe_50k.json").count() >= 42
