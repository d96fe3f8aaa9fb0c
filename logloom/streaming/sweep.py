"""Incremental analysis with Structured Streaming.

A file source finds new lines; as redaction needs a session as a whole, each micro-batch only says
which sessions changed, and ``foreachBatch`` reads the files of those sessions alone and re-emits them. Signals are keyed by call,
so a late sub-agent adds to a session without renumbering what was shown. ``sweep_alone`` keeps two sweeps
apart by a lock beside the checkpoint, which a sweep that died loses after five minutes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import incremental, redact
from ..plans import analyze
from ..sources import logs
from ..versions import Lock


def changed_paths(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """A stream of (session_path, modified) of files that appeared or grew."""
    raw = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    own = F.col("_metadata.file_path")
    return raw.select(F.coalesce(logs.owning_session(own), own).alias("session_path"), F.col("_metadata.file_modification_time").alias("modified")).distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name)


def sweep(spark: SparkSession, path: str, checkpoint: str, emit: Callable[[DataFrame, DataFrame, int], None], lock: Lock | None = None) -> StreamingQuery:
    """Analyse what changed below ``path`` and hand (gated, signals, batch) to ``emit``; ends when all is done. A ``lock`` is renewed with each batch, or ends the sweep."""

    def one(batch: DataFrame, number: int) -> None:
        if lock is not None and not lock.take():
            raise TimeoutError("another sweep took the lock")
        # The names of changed sessions: at most as many as files in a micro-batch.
        names = [r.session_path for r in batch.select("session_path").distinct().collect()]
        read = [p for n in names for p in (n, n.removesuffix(".jsonl")) if _exists(spark, p)]
        if read:
            lines = analyze.streams(spark, read)
            gated, signals = analyze.detect(analyze.parsed(redact.redacted(analyze.merged(lines)).select("session_id", "line_no", "line")))
            emit(gated, signals, number)

    stream = changed_paths(spark, path)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sweep_alone(spark: SparkSession, path: str, checkpoint: str, emit: Callable[[DataFrame, DataFrame, int], None], expiry: float = 300) -> bool:
    """A whole sweep unless another one is under way, also on another machine; whether it ran."""
    lock = Lock(spark, f"{checkpoint.rstrip('/')}-lock", expiry)
    with lock.held() as mine:
        if mine:
            sweep(spark, path, checkpoint, emit, lock).awaitTermination()
    return mine


def activity_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Work between pauses as session windows of a stream or table (session_id, ts)."""
    return events.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("calls")).select("session_id", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "calls")


def new_signals(signals: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals not shown yet, and the table of shown keys with theirs added."""
    fresh = incremental.unseen(signals, shown)
    return fresh, shown.unionByName(fresh.select("session_id", incremental.signal_key().alias("key"))).distinct()
