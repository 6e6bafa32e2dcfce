"""Connected components by alternating large and small stars, on DataFrames.

Each round every node points its neighbours to the smallest node it sees; sums and minima are pre-aggregated before
they are shuffled and each round is a written table.  Nothing of the graph comes to the driver but a count and a
checksum for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    small = large.join(least, F.col("u") == F.col("w"))
    return small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component for every node of ``edges`` (its first two columns, longs): component is its smallest node."""
    spark = edges.sparkSession
    u, v = (F.col(c) for c in edges.columns[:2])
    now = store.written(spark, edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, last = mark, now
        now = store.written(spark, _round(now), "edges")
        store.dropped(spark, last)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
