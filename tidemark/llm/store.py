"""Shared work folder: where lineage is cut and where operators put their files.

The folder is the one the session names in ``spark.checkpoint.dir``; only when that is unset (tests, notebooks) a
local folder is made.  Every table is written through Spark's commit protocol, so a lost executor costs the retry of
its tasks and never half a file.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def base_dir(spark: SparkSession) -> str:
    """The shared folder's URI; a local, temporary one only where the session names none and all of Spark is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name for one use of an operator."""
    return f"{base_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and fixes the rows."""
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # shuffle files that only the written plan needed can go
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def column(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where driver and workers share the code's folder."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def open_out(uri: str):
    """A binary stream for writing ``uri`` on whatever file system it names."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path, compression=None)


def open_in(uri: str):
    """A seekable binary file for reading ``uri``."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def one_per_task(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """``rows`` (a driver-side list of shards, a few fields each), one to a partition, in order."""
    n = max(1, len(rows))
    small = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_i long, " + schema)
    return spark.range(0, n, 1, n).join(F.broadcast(small), F.col("id") == F.col("_i")).drop("id", "_i")


def prefix_sums(totals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(part, what comes before it) from (part, total), in the order of the parts."""
    out, so_far = [], 0
    for part, total in sorted(totals):
        out.append((part, so_far))
        so_far += total
    return out
