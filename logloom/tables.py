"""Tables between steps, written to the folder that driver and executors share.

A written table ends the lineage of what it holds: later plans stay small, several readers cost one
computation, and a lost executor costs only the tasks that it ran.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where it is unset and the master is this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    # local, local[n] and local[n, f] are this machine alone; local-cluster has executors with folders of their own.
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written and read again; ``by`` names a column of few values that gets a folder each, so that one of them can be read alone."""
    spark = df.sparkSession
    path = f"{folder(spark)}/logloom/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> None:
    """Delete what this process wrote, once nothing reads it any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Narrow rows dealt out over all tasks, by columns if any. Where a row costs much more than its bytes tell, or becomes many times as wide, the size
    of a file or of an exchange says too little: a given number of partitions is neither joined nor cut by it."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *by)
