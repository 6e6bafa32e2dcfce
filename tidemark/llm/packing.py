"""Packing: concatenate all documents' tokens and cut them into fixed windows.

First pass: each partition encodes its documents and writes their ids with the running total inside the partition.
The partitions' totals (one number each) are added up in order, which gives every partition, and so every document,
its global offset.  Second pass: each document is cut, on its own row, where the fixed windows end; a piece is a
boundary record (sequence, offset there, start in the document, length).  No row is shuffled, whatever the skew: a
very long document is cut into many pieces, and copies are documents like any other.  The ids are encoded once: the
first pass is a table in the shared folder, so a lost executor repeats a task and not the offsets.

Defined results: a null text is an empty one and gives the end id alone; a null id is kept; repeated rows are packed
each; an empty table gives no rows; other columns are ignored.  Only the last sequence is shorter than the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, tokens


def encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """part, start_in_part, id, n_tokens, ids (unsigned 32-bit little-endian) of every document, lazily."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        own, part, so_far = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in tokens.small_batches(whole, 1):
                ids, counts = tokens.with_end(*own.encode_all(batch.column(1)), end_id)
                starts = so_far + np.cumsum(counts) - counts
                so_far += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(counts), part, np.int32)), pa.array(starts), batch.column(0), pa.array(counts), tokens.binaries(ids, counts)],
                    names=["part", "start_in_part", "doc_id", "n_tokens", "ids"],
                )
        tokens.tidy()

    chosen = docs.select(store.column(id_col).alias("doc_id"), store.column(text_col).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"part int, start_in_part long, doc_id {kind}, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (of the piece)."""
    spark: SparkSession = docs.sparkSession
    store.importable(spark)
    table = store.written(spark, encoded(docs, tokenizer, id_col, text_col, end_id), "packing")
    totals = [(r[0], r[1]) for r in table.groupBy("part").agg(F.sum("n_tokens")).collect()]  # a number for each input split
    before = spark.createDataFrame(store.prefix_sums(totals), "part int, before long")
    at = table.join(F.broadcast(before), "part").select("doc_id", "n_tokens", "ids", (F.col("before") + F.col("start_in_part")).alias("at"))
    upto = F.col("at") + F.col("n_tokens")

    def piece(s):
        begin = F.greatest(F.col("at"), s * length)
        n = F.least(upto, (s + 1) * length) - begin
        start = begin - F.col("at")
        return F.struct(
            start.alias("start"), n.alias("length"), s.alias("sequence_id"), (begin - s * length).alias("offset"),
            F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (n * 4).cast("int")).alias("ids"),
        )

    windows = F.sequence(F.floor(F.col("at") / length).cast("long"), F.floor((upto - 1) / length).cast("long"))
    cut = at.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.transform(windows, piece).alias("pieces"))
    return cut.select("doc_id", "doc_tokens", F.inline("pieces")).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
