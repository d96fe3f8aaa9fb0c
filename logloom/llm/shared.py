"""Tables between the phases of an operator.

They live in the folder that the cluster names in ``spark.checkpoint.dir``, which driver and
executors share, so a lost executor costs the tasks that it ran and nothing that was written.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local one only where none is set and the master is this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    # local, local[n] and local[n, f] are this machine alone; local-cluster has executors with folders of their own.
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/logloom/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (or at ``path``) and read it back; lineage ends here."""
    path = path or new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession, after: int = 0) -> None:
    """Delete the tables that this process wrote (after the first ``after``); call it after the last action that reads them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while len(_written) > after:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are written inside go when the block ends, but for those given to the function that it yields."""
    began, kept = len(_written), set()
    yield lambda *tables: kept.update(path for t in tables for path in t.inputFiles())
    later, _written[began:] = _written[began:], []
    stay = [p for p in later if any(f"/{os.path.basename(p)}/" in f for f in kept)]
    _written.extend(p for p in later if p not in stay)
    cleanup(spark, began)
    _written.extend(stay)


_owner: list = ["", None]


def own_worker(name: str, drop=None) -> None:
    """Called where a task begins: a Python worker, which outlives its tasks, keeps the cache of one operator at a time."""
    if _owner[0] != name:
        if _owner[1] is not None:
            _owner[1]()
        _owner[:] = [name, drop]
    _give_back()


def _give_back() -> None:
    """What the last task freed goes back to the machine, which the worker shares with others."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def column(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def doc_hash(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(modulus))
