"""Incremental re-runs: what changed, what to retry, what was shown, and what to forget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def fingerprint(files: DataFrame) -> DataFrame:
    """Total size and latest change of a session and its sub-agents (session_id, length, modified)."""
    return files.groupBy("session_id").agg(F.sum("length").alias("size_bytes"), F.max("modified").alias("modified"))


def looks_unchanged(state_prefix: str = "s", file_prefix: str = "f") -> Column:
    """Whether a file is as it was when it was last sent or refused, at the same commit mark."""
    s, f = (lambda c: F.col(f"{state_prefix}.{c}")), (lambda c: F.col(f"{file_prefix}.{c}"))
    settled = s("uploaded_hash").isNotNull() | s("rejected_hash").isNotNull()
    same = s("size_bytes").eqNullSafe(f("size_bytes")) & s("modified").eqNullSafe(f("modified"))
    return F.coalesce(settled & s("last_commit").eqNullSafe(s("uploaded_commit")) & same, F.lit(False))


def changed(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files without a settled, equal state, smallest first. State is small and keyed; the join prunes nothing it needs."""
    joined = files.alias("f").join(state.alias("s"), F.col("f.path") == F.col("s.path"), "left")
    return joined.where(~looks_unchanged()).select("f.*").orderBy("size_bytes")


def is_due(attempts: Column, queued_ms: Column, last_ms: Column, now_ms: Column) -> Column:
    """Whether the wait, ten minutes doubled with each attempt, is over; an unknown time is due."""
    since = F.coalesce(last_ms, queued_ms)
    return since.isNull() | (now_ms - since >= fixed.QUEUE_BASE_MS * F.pow(F.lit(2), attempts))


def record_failures(queue: DataFrame, failed: DataFrame) -> DataFrame:
    """The queue with one more attempt for each failed entry (key, error, at_ms); the eighth is the last."""
    q = queue.join(failed, "key", "left")
    hit = F.col("at_ms").isNotNull()
    attempts = F.col("attempts") + hit.cast("int")
    return q.select(
        "key", "queued_ms", attempts.alias("attempts"), F.coalesce("at_ms", "last_ms").alias("last_ms"), F.coalesce("error", "last_error").alias("last_error"),
        (attempts >= fixed.QUEUE_ATTEMPTS).alias("abandoned"),
    )


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(~F.col("abandoned")).alias("pending"), F.count_if("abandoned").alias("failed"))


def prune(state: DataFrame, most: int = fixed.STATES_KEPT) -> DataFrame:
    """The most recently touched states: a top-k, not a sort of all."""
    return state.orderBy(F.desc(F.coalesce("touched_ms", F.lit(0))), "path").limit(most)


def upsert(state: DataFrame, patches: DataFrame, most: int = fixed.STATES_KEPT) -> DataFrame:
    """State with patches in place of rows of equal path, then pruned."""
    kept = state.join(patches.select("path"), "path", "left_anti")
    return prune(kept.unionByName(patches, allowMissingColumns=True), most)


def with_mark(marks: Column, sha: Column, records: Column, most: int = fixed.MARKS_KEPT) -> Column:
    """Commit marks with one more at the end; a mark of the same commit goes, old ones beyond ``most`` too."""
    mark = F.struct(sha.alias("sha"), records.cast("int").alias("records"))
    others = F.filter(F.coalesce(marks, F.array().cast("array<struct<sha:string,records:int>>")), lambda m: m["sha"] != sha)
    added = F.concat(others, F.array(mark))
    return F.when(sha.isNull(), marks).otherwise(F.slice(added, F.greatest(F.size(added) - most + 1, F.lit(1)), most))


def signal_key() -> Column:
    """What a signal is known by: its call or record; the index only where it has neither."""
    anchor = F.coalesce("tool_use_id", "uuid")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws("\x00", "category", blank(F.col("file_path")), blank(anchor), F.when(anchor.isNull(), F.col("record_index").cast("string")).otherwise(""))


def indexed_key() -> Column:
    """The older key, with the record's index."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws("\x00", "category", blank("file_path"), blank("uuid"), blank("tool_use_id"), F.col("record_index").cast("string"))


def unseen(signals: DataFrame, shown: DataFrame) -> DataFrame:
    """Signals whose keys, old and new, were not shown (session_id, key)."""
    s = signals.withColumn("_key", signal_key()).withColumn("_old", indexed_key())
    keys = shown.select("session_id", F.col("key").alias("_key")).distinct()
    left = s.join(keys, ["session_id", "_key"], "left_anti")
    return left.join(keys.withColumnRenamed("_key", "_old"), ["session_id", "_old"], "left_anti").select(signals.columns)


def content_hash(lines: DataFrame) -> DataFrame:
    """sha256 of each session's lines, each closed by a line end (session_id, record_index, line)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("record_index", "line"))), lambda x: x["line"])
    body = F.concat(F.array_join(ordered, "\n"), F.lit("\n"))
    return lines.groupBy("session_id").agg(F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256)).alias("content_hash"), F.sum(F.octet_length("line") + 1).alias("body_bytes"))


def unresolved_errors(journal: DataFrame) -> DataFrame:
    """Errors of a journal (at, level, message) after its last success."""
    last = journal.where("level = 'success'").agg(F.max("at").alias("last"))
    return journal.where("level = 'error'").crossJoin(F.broadcast(last)).where("last IS NULL OR at > last").drop("last")


def journal(lines: DataFrame) -> DataFrame:
    """at, level, message of journal lines ``<time> <level> <message>``; others are left out."""
    pattern = r"^(\S+)\s+(error|warn|info|success)\s+(.*)\z"
    out = lines.select(*(F.regexp_extract("line", pattern, k).alias(c) for k, c in ((1, "at"), (2, "level"), (3, "message"))))
    return out.where("at <> ''")


def latest_per_window(sessions: DataFrame, by: str, at: str, within_ms: int) -> DataFrame:
    """The newest row of each group, and all within a time of it."""
    w = Window.partitionBy(by)
    newest = F.max(at).over(w)
    return sessions.withColumn("_newest", newest).where(F.col("_newest") - F.col(at) <= within_ms).drop("_newest")


def enqueue(queue: DataFrame, found: DataFrame) -> DataFrame:
    """The queue with entries (key, queued_ms) that it doesn't have yet; those that are there keep their attempts, those given up start anew."""
    live = queue.where("NOT abandoned")
    fresh = found.join(live.select("key"), "key", "left_anti").select("key", "queued_ms", F.lit(0).alias("attempts"), F.lit(None).cast("long").alias("last_ms"), F.lit(None).cast("string").alias("last_error"), F.lit(False).alias("abandoned"))
    return live.unionByName(fresh)


def status_by_agent(sessions: DataFrame) -> DataFrame:
    """(agent, sessions, newest, newest_of_all) of sessions (agent, session_id, modified): how many each client has, and when the latest of any was."""
    per = sessions.groupBy("agent").agg(F.countDistinct("session_id").alias("sessions"), F.max("modified").alias("newest"))
    return per.crossJoin(F.broadcast(sessions.agg(F.max("modified").alias("newest_of_all"))))


def upload_timeout_ms(body_bytes: Column, bytes_per_second: int = 100_000, least_ms: int = 30_000, most_ms: int = 600_000) -> Column:
    """How long an upload may take: half a minute, or what its size needs, up to ten minutes."""
    return F.least(F.greatest(F.ceil(body_bytes * 1000 / bytes_per_second), F.lit(least_ms)), F.lit(most_ms)).cast("long")


def rotated(journal_lines: DataFrame, most_bytes: int) -> DataFrame:
    """The newest lines (line_no, line) of a journal that has outgrown ``most_bytes``: at most half of that stays."""
    total = Window.orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = journal_lines.withColumn("_so_far", F.sum(F.octet_length("line") + 1).over(total))
    whole = journal_lines.agg(F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("_whole"))
    return sized.crossJoin(F.broadcast(whole)).where((F.col("_whole") <= most_bytes) | (F.col("_so_far") <= most_bytes // 2)).drop("_so_far", "_whole")
