"""Reports over sessions and signals, and golden snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(gated: DataFrame, signals: DataFrame) -> DataFrame:
    """files, eligible, silent and candidates of a corpus: one row."""
    n = signals.groupBy("session_id").agg(F.count("*").alias("n"))
    g = gated.join(n, "session_id", "left")
    eligible = F.col("reason").isNull()
    return g.agg(
        F.count("*").alias("files"), F.count_if(eligible).alias("eligible"), F.count_if(eligible & F.col("n").isNull()).alias("silent"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("candidates"),
    )


def snapshots(gated: DataFrame, signals: DataFrame) -> DataFrame:
    """(session_id, snapshot): one JSON document per session, its signals in order."""
    entry = F.struct("record_index", "category", F.coalesce("file_path", F.lit("")).alias("_path"), "file_path", "weight", "detail")
    per = signals.groupBy("session_id").agg(F.sort_array(F.collect_list(entry)).alias("s"))
    shown = F.transform(F.coalesce("s", F.array().cast("array<struct<record_index:int,category:string,_path:string,file_path:string,weight:double,detail:string>>")), lambda x: F.struct(x["category"].alias("category"), x["file_path"].alias("filePath"), x["record_index"].alias("recordIndex"), x["weight"].alias("weight"), x["detail"].alias("detail")))
    doc = F.struct(F.col("session_id").alias("session"), F.col("reason").isNull().alias("eligible"), "reason", F.col("known_gap_reachable").alias("knownGapReachable"), shown.alias("candidates"))
    return gated.join(per, "session_id", "left").select("session_id", F.to_json(doc).alias("snapshot"))


def compare(found: DataFrame, expected: DataFrame) -> DataFrame:
    """ok, changed, new (no snapshot is stored) or missing (a stored session is not among ``found``) for each session of either."""
    e = expected.select("session_id", F.col("snapshot").alias("_expected"))
    both = found.join(e, "session_id", "full")
    status = F.when(F.col("snapshot").isNull(), "missing").when(F.col("_expected").isNull(), "new").when(F.col("_expected") == F.col("snapshot"), "ok").otherwise("changed")
    return both.select("session_id", status.alias("status"))


def as_json(gated: DataFrame, signals: DataFrame) -> DataFrame:
    """(line) of a report for programs: a document per session, then one with the totals. Write it with ``write.text``."""
    one = snapshots(gated, signals).select(F.col("snapshot").alias("line"))
    return one.unionByName(totals(gated, signals).select(F.to_json(F.struct("files", "eligible", "silent", "candidates")).alias("line")))


def lines(signals: DataFrame) -> DataFrame:
    """A line of text per signal."""
    path = F.coalesce("file_path", F.lit("-"))
    return signals.select("session_id", "record_index", F.format_string("%s  %.2f  %s  #%d  %s", F.col("category"), F.col("weight"), path, F.col("record_index"), F.col("detail")).alias("line"))


def apply_settings(signals: DataFrame, categories: list[str] | None = None, ignore_paths: list[str] | None = None, least_weight: float = 0.0, most_signals: int | None = None) -> DataFrame:
    """A user's settings as a filter: categories, paths (by pattern), weight and number of signals."""
    out = signals.where(F.col("weight") >= least_weight)
    out = out.where(F.col("category").isin(categories)) if categories is not None else out
    for pattern in ignore_paths or []:
        out = out.where(~F.coalesce(F.col("file_path").rlike(pattern), F.lit(False)))
    return out.orderBy(F.desc("weight"), "session_id", "record_index").limit(most_signals) if most_signals is not None else out
