"""From log files to signals: read, normalise, merge, redact, parse, detect, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.paths import in_tree_of
from ..operators import contents, detectors, graph, order, parse, redact
from ..sources import logs
from ..tables import keep
from .normalise import canonical


@dataclass
class Session:
    """The derived tables of a corpus."""

    numbered: DataFrame
    records: DataFrame
    blocks: DataFrame
    calls: DataFrame
    edits: DataFrame
    reads: DataFrame
    meta: DataFrame


def streams(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(session_id, stream, seq, at, line, start_seq, start_at) of all files below a path, in canonical records."""
    lines = logs.read_lines(spark, path)
    kinds = logs.formats(lines)
    kept = logs.expand(lines.select("path").distinct())
    owner = F.coalesce(logs.owning_session(F.col("path")), F.col("path"))
    own = lines.join(kinds, "path").withColumn("session_id", F.regexp_extract(owner, r"([^/]+?)(?:\.jsonl)?\z", 1))
    listed = own.join(kept.select(F.col("path").alias("_kept")), F.col("_kept") == owner, "left_semi")
    made = canonical(listed.select("path", "format", "session_id", "line_no", "line"))
    return made.withColumn("owner", F.coalesce(logs.owning_session(F.col("path")), F.col("path"))).withColumn("stream", logs.agent_id(F.col("path"))).withColumn("session_id", F.regexp_extract("owner", r"([^/]+?)(?:\.jsonl)?\z", 1))


def merged(made: DataFrame) -> DataFrame:
    """(session_id, line_no, line): a session's lines with its sub-agents' lines where they belong in time."""
    told = made.where("line IS NOT NULL")
    parent = told.where("stream IS NULL").select("session_id", "seq", "at", "line")
    started = made.where("stream IS NULL AND spawned IS NOT NULL").groupBy("session_id", F.col("spawned").alias("stream")).agg(F.min("seq").alias("start_seq"), F.min_by("at", "seq").alias("start_at"))
    # A call's result names the sub-agent that ran it; the call is where the sub-agent starts.
    linked = parent.select("session_id", "seq", "at", F.get_json_object("line", "$.toolUseResult.agentId").alias("stream"), F.get_json_object("line", "$.message.content[0].tool_use_id").alias("call")).where("stream IS NOT NULL")
    asked = parent.select("session_id", F.col("seq").alias("_seq"), F.col("at").alias("_at"), F.explode(F.from_json(F.get_json_object("line", "$.message.content[*].id"), "array<string>")).alias("call"))
    by_result = linked.join(asked, ["session_id", "call"], "left").groupBy("session_id", "stream").agg(F.min(F.coalesce("_seq", "seq")).alias("r_seq"), F.min(F.coalesce("_at", "at")).alias("r_at"))
    child = told.where("stream IS NOT NULL").select("session_id", "stream", "seq", "at", "line").join(started, ["session_id", "stream"], "left").join(by_result, ["session_id", "stream"], "left")
    # Of a sub-agent that nothing names, the lines come last.
    child = child.withColumn("start_seq", F.coalesce("start_seq", "r_seq", F.lit((1 << 31) - 1))).withColumn("start_at", F.coalesce("start_at", "r_at"))
    placed = order.merge_streams(parent.drop("line"), child.select("session_id", "stream", "seq", "at", "start_seq", "start_at"))
    texts = told.select("session_id", "stream", "seq", "line")
    joined = placed.alias("p").join(texts.alias("t"), (F.col("p.session_id") == F.col("t.session_id")) & F.col("p.stream").eqNullSafe(F.col("t.stream")) & (F.col("p.seq") == F.col("t.seq")))
    return joined.select("p.session_id", F.col("p.record_index").alias("line_no"), "t.line")


def parsed(lines: DataFrame) -> Session:
    """The derived tables of lines (session_id, line_no, line), all of them; eight detectors read them, so they are written once."""
    numbered = keep(parse.lines(lines).select("session_id", "line_no", "record_index", "status", "oversize", "raw"), "lines")
    records = parse.records(numbered)
    blocks = parse.blocks(records)
    calls = keep(parse.calls(blocks), "calls")
    edits, reads = keep(parse.edits(calls), "edits"), keep(parse.reads(calls), "reads")
    return Session(numbered, records, blocks, calls, edits, reads, keep(parse.session_meta(numbered, calls), "meta"))


def flat(calls: DataFrame) -> DataFrame:
    """Calls with their result's fields beside them, as the detectors want them."""
    r = lambda c: F.col(f"result.{c}").alias(c)
    return calls.select(
        "session_id", "record_index", "call_seq", "tool_use_id", "name", "command", "file_path", "uuid", "ts", "ts_raw", "input", "result",
        F.col("result").isNotNull().alias("has_result"), r("is_error"), r("stdout"), r("stderr"), r("text"),
    )


def looks(calls: DataFrame, reads: DataFrame) -> DataFrame:
    """What each call saw: reads of tools and commands, and the files of edits."""
    seq = calls.select("session_id", "record_index", "call_seq").groupBy("session_id", "record_index").agg(F.max("call_seq").alias("call_seq"))
    seen = reads.join(seq, ["session_id", "record_index"]).select("session_id", "path", "call_seq", "record_index")
    edited = calls.where(F.col("name").isin(*fixed.EDIT_TOOLS)).select("session_id", F.coalesce("file_path", F.try_variant_get("input", "$.notebook_path", "string")).alias("path"), "call_seq", "record_index").where("path IS NOT NULL")
    return seen.union(edited)


def detect(s: Session) -> tuple[DataFrame, DataFrame]:
    """(gated sessions, signals in order). Only eligible sessions reach the detectors, of whatever size."""
    gated = detectors.gate(s.meta)
    eligible = gated.where("reason IS NULL").select("session_id")
    calls = flat(s.calls).join(eligible, "session_id", "left_semi")
    edits = s.edits.join(eligible, "session_id", "left_semi")
    reads = s.reads.join(eligible, "session_id", "left_semi")
    calls, edits, reads = keep(calls, "eligible-calls"), keep(edits, "eligible-edits"), keep(reads, "eligible-reads")
    walked = graph.graph(s.records.join(eligible, "session_id", "left_semi"))
    back = contents.returned(contents.steps_of(calls))
    left = detectors.abandoned(detectors.returned_states(calls, back), detectors.revert_pairs(edits), detectors.git_reverts(calls, edits), detectors.abandoned_branches(edits, walked))
    left = keep(left, "abandoned")
    parts = [
        left, detectors.test_modified(calls, edits), detectors.external_dependencies(calls, edits), detectors.never_read(edits, reads),
        detectors.unverified_fix(calls, edits), detectors.error_suppressed(calls, edits), detectors.stale_context(calls, looks(calls, reads)),
        detectors.without_reported(detectors.destructive(calls), left),
    ]
    signals = parts[0]
    for k, part in enumerate(parts[1:]):
        signals = signals.unionByName(keep(part, f"signals-{k}"))
    signals = signals.join(s.meta.select("session_id", "cwd"), "session_id", "left")
    # Only absolute paths can lie outside of the project.
    signals = signals.where(F.col("file_path").isNull() | ~F.col("file_path").rlike(r"^(?:\\\\|[\\/]|[A-Za-z]:[\\/])") | in_tree_of(F.col("file_path"), F.col("cwd"))).drop("cwd", "seq")
    return gated, detectors.in_order(signals)


def analyze(spark: SparkSession, path: str | list[str], extra_patterns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Gate and signals of all sessions below a path."""
    lines = redact.redacted(merged(streams(spark, path)), extra_patterns)
    return detect(parsed(lines.select("session_id", "line_no", "line")))
