"""Commit attribution over tables of commits, their files, blobs and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, shell
from ..functions.text import line_words


def ancestors(path: Column) -> Column:
    """A path and every folder above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def sessions_editing(commit_files: DataFrame, edits: DataFrame) -> DataFrame:
    """(sha, session_id) where a session edited a committed file, or a file in a committed folder (a submodule)."""
    held = edits.select("session_id", F.explode(ancestors(F.col("file_path"))).alias("file")).distinct()
    return commit_files.select("sha", "file").join(held, "file").select("sha", "session_id").distinct()


def moved_blobs(head: DataFrame, marked: DataFrame) -> DataFrame:
    """(sha, session_id) where a commit holds a blob that a session's marked commits hold; a zero blob counts only in the same file."""
    zero = F.col("blob").rlike(r"^0+\z")
    # Each side once for what it is joined by; a blob that isn't zero meets by itself what it would meet in its file.
    once = lambda side, name, *by: side.select(name, *by).distinct()
    by_blob = once(head.where(~zero), "sha", "blob").join(once(marked.where(~zero), "session_id", "blob"), "blob").select("sha", "session_id")
    by_file = once(head.where(zero), "sha", "file", "blob").join(once(marked.where(zero), "session_id", "file", "blob"), ["file", "blob"]).select("sha", "session_id")
    return by_blob.union(by_file).distinct()


def shared_lines(head_lines: DataFrame, work_lines: DataFrame) -> DataFrame:
    """(sha, session_id, shared, carries) by lines as letters and digits: shared with a tenth of the smaller side or more."""
    h = head_lines.select("sha", line_words(F.col("line")).alias("w")).where("w <> ''").distinct()
    s = work_lines.select("session_id", line_words(F.col("line")).alias("w")).where("w <> ''").distinct()
    both = h.join(s, "w").groupBy("sha", "session_id").agg(F.count("*").alias("shared"))
    n_h, n_s = h.groupBy("sha").agg(F.count("*").alias("in_head")), s.groupBy("session_id").agg(F.count("*").alias("in_work"))
    out = both.join(n_h, "sha").join(n_s, "session_id")
    return out.withColumn("carries", 100 * F.col("shared") >= fixed.SHARED_LINES_PERCENT * F.least("in_head", "in_work")).select("sha", "session_id", "shared", "carries")


def running_limit_ms(own_timeout: Column) -> Column:
    """How long a shell call may run: its own limit or two minutes, ten at most, and half a minute."""
    return F.least(F.when(own_timeout > 0, own_timeout).otherwise(120_000), F.lit(600_000)) + 30_000


def is_running(name: Column, has_result: Column, started_ms: Column, own_timeout: Column, now_ms: Column) -> Column:
    return name.isin("Bash", "PowerShell") & ~has_result & (now_ms - started_ms < running_limit_ms(own_timeout))


def makes_commit(command: Column) -> Column:
    return F.arrays_overlap(shell.git_commands_of(command), F.array(*(F.lit(x) for x in ("commit", "rebase", "cherry-pick", "revert", "am", "pull"))))


def moves_branch(command: Column) -> Column:
    return F.arrays_overlap(shell.git_commands_of(command), F.array(F.lit("switch"), F.lit("checkout")))


def words_of(text: Column) -> Column:
    return F.split(text, r"\\.|[\s/\"'`$=:;,|&<>(){}\[\]*?!#]+")


def may_own(own_branch: Column, head_branch: Column, leaves_unknown: Column, moved: Column, branch_gone: Column) -> Column:
    """Whether a session on a branch can own a commit on another: only if something could have moved it there."""
    same = head_branch.isNull() | own_branch.isNull() | (own_branch == "HEAD") | (own_branch == head_branch)
    return same | leaves_unknown | moved | branch_gone


def choose_session(tiers: DataFrame) -> DataFrame:
    """One session per commit: the lowest tier (running, carrying, may own) and in it the newest (sha, session_id, tier, active_at)."""
    w = Window.partitionBy("sha").orderBy("tier", F.desc("active_at"), "session_id")
    return tiers.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def report_rows(signals: DataFrame, most_per_category: int = 2, most: int = 6) -> DataFrame:
    """Rows to print: a category's signals, or one row for its files if there are more than two; strongest categories first."""
    by = Window.partitionBy("session_id", "category")
    order = by.orderBy(F.desc("weight"), "record_index")
    s = signals.withColumn("n", F.count("*").over(by)).withColumn("place", F.row_number().over(order))
    s = s.withColumn("files", F.size(F.collect_set(F.coalesce("file_path", F.lit(""))).over(by)))
    s = s.withColumn("top", F.first(F.struct((-F.col("weight")).alias("w"), "record_index")).over(order))
    s = s.where((F.col("n") <= most_per_category) | (F.col("place") == 1))
    many = F.concat(F.col("files").cast("string"), F.when(F.col("files") == 1, " file").otherwise(" files"))
    subject = F.when(F.col("n") <= most_per_category, F.coalesce("file_path", F.lit(""))).otherwise(many)
    line = F.row_number().over(Window.partitionBy("session_id").orderBy("top.w", "top.record_index", "category", "place"))
    return s.withColumn("line", line).where(F.col("line") <= most).select("session_id", "line", "category", subject.alias("subject"), "detail")
