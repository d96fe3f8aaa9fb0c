"""The detectors: each takes calls and edits and returns weighted signals.

``calls``: session_id, record_index, call_seq, tool_use_id, name, command, file_path, uuid, ts,
ts_raw, is_error, stdout, stderr, text. ``edits``: session_id, file_path, file_order, edit_seq,
record_index, call_seq, tool, tool_use_id, uuid, old_string, new_string, content, ts_raw. All
windows and joins are by session_id, so the tables are exchanged once.

Signals: session_id, category, file_path, record_index, uuid, tool_use_id, started_at, ended_at,
weight, detail, and seq, the order in which ties are broken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dependencies, fixed, marks, shell
from ..functions import text as t
from ..functions.globs import matched
from .order import dedupe

SIGNAL = ("session_id", "category", "file_path", "record_index", "uuid", "tool_use_id", "started_at", "ended_at", "weight", "detail", "seq")


def _signal(df: DataFrame, category: str, weight: Column, detail: Column, file_path: Column | None = None, started: Column | None = None, ended: Column | None = None, seq: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        "session_id", F.lit(category).alias("category"), (none if file_path is None else file_path).alias("file_path"), "record_index", "uuid", "tool_use_id",
        (F.col("ts_raw") if started is None else started).alias("started_at"), (F.col("ts_raw") if ended is None else ended).alias("ended_at"),
        weight.cast("double").alias("weight"), detail.alias("detail"), (F.col("call_seq") if seq is None else seq).cast("long").alias("seq"),
    )


def failures(calls: DataFrame) -> DataFrame:
    """(session_id, record_index, failed_ts) of the first failing shell call of each record, by final results."""
    said = t.failed(F.col("is_error"), F.col("stdout"), F.col("stderr"), F.col("text"))
    bad = calls.where((F.col("name") == "Bash") & F.col("has_result") & said)
    return bad.groupBy("session_id", "record_index").agg(F.min_by(F.struct("ts_raw"), "call_seq").alias("failed"))


def _marks(rows: DataFrame, events: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the earliest of ``events`` in the ten records before each: a window over both, not a range join."""
    marks = events.select("session_id", "record_index", value.alias("_value"), F.lit(True).alias("_is_event"))
    both = rows.withColumn("_is_event", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("session_id").orderBy("record_index").rangeBetween(-fixed.LOOKBACK_RECORDS, -1)
    found = F.min(F.when(F.col("_is_event"), F.struct("record_index", "_value"))).over(w)
    return both.withColumn(name, found).where("NOT _is_event").drop("_value", "_is_event")


def with_failure(edits: DataFrame, calls: DataFrame) -> DataFrame:
    """Edits with ``failure``: the earliest failing command of the ten records before."""
    return _marks(edits, failures(calls), F.col("failed.ts_raw"), "failure")


def test_modified(calls: DataFrame, edits: DataFrame) -> DataFrame:
    e = with_failure(edits.where(t.is_test_file(F.col("file_path"))), calls)
    hit = F.col("failure").isNotNull()
    shelled = (F.col("tool") == "Bash") & hit
    reason = F.when(F.col("tool") != "Bash", marks.weakened_of(F.col("old_string"), F.col("new_string")))
    e = e.withColumn("reason", reason).where(shelled | F.col("reason").isNotNull())
    weight = F.when(F.col("tool") == "Bash", 0.5).when(hit, 0.9).otherwise(0.6)
    detail = F.when(F.col("tool") == "Bash", "test rewritten in place by a shell command shortly after a failing command").when(hit, F.concat("reason", F.lit(", shortly after a failing command"))).otherwise(F.col("reason"))
    seq = F.col("file_order") * (1 << 31) + F.col("edit_seq")
    return dedupe(_signal(e, "test_modified_to_pass", weight, detail, F.col("file_path"), F.coalesce("failure._value", "ts_raw"), seq=seq))


def revert_pairs(edits: DataFrame) -> DataFrame:
    """Edits that undo an earlier edit of the same file: a semi-join of digests, as of the earlier one."""
    e = edits.where("old_string IS NOT NULL AND new_string IS NOT NULL")
    made = e.groupBy("session_id", "file_path", t.sides(F.col("old_string"), F.col("new_string")).alias("key")).agg(F.min("edit_seq").alias("first"))
    undone = e.withColumn("key", t.sides(F.col("new_string"), F.col("old_string"))).join(made, ["session_id", "file_path", "key"]).where("first < edit_seq")
    seq = F.col("file_order") * (1 << 31) + F.col("edit_seq")
    return _signal(undone, "abandoned_approach", F.lit(0.7), F.lit("an earlier edit to this file was undone by a later one"), F.col("file_path"), seq=seq)


def git_reverts(calls: DataFrame, edits: DataFrame) -> DataFrame:
    """Commands that discard edits made before them; one signal a command."""
    c = calls.where((F.col("name") == "Bash") & F.col("command").rlike(r"\bgit\s+(reset|stash|checkout|restore)\b")).withColumn("targets", shell.revert_targets_of(F.col("command"))).where("targets.everything IS NOT NULL")
    # A file's first edit is its earliest, so only that one can come before a command.
    files = edits.groupBy("session_id", "file_path").agg(F.min("edit_seq").alias("file_order"), F.min_by(F.struct("record_index", "ts_raw"), "edit_seq").alias("earliest"))
    files = files.withColumn("base", t.basename(F.col("file_path")))
    slim = c.select("session_id", "record_index", "call_seq", "uuid", "tool_use_id", "ts_raw", "targets")
    # Names meet files by equality.
    named = slim.where("NOT targets.everything").select("*", F.explode("targets.names").alias("base")).join(files, ["session_id", "base"])
    met = named.where(F.col("earliest.record_index") < F.col("record_index"))
    call = ["session_id", "record_index", "call_seq", "uuid", "tool_use_id", "ts_raw"]
    some = met.groupBy(*call).agg(F.sort_array(F.collect_list(F.struct("file_order", "file_path", "base"))).alias("files"), F.min("earliest.ts_raw").alias("since")).withColumn("n", F.size("files"))
    # What discards everything meets the files that were edited before it, and those are the first ones of its session: how many, and since when, are
    # running values over files and commands together, and the names that are listed are among the session's first five.
    first = files.withColumn("_rank", F.row_number().over(Window.partitionBy("session_id").orderBy("file_order"))).where(F.col("_rank") <= 5)
    first = first.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("file_order", "file_path", "base"))).alias("files"))
    marks_ = files.select("session_id", F.col("earliest.record_index").alias("record_index"), F.lit(True).alias("_file"), F.col("earliest.ts_raw").alias("_since"))
    both = slim.where("targets.everything").select(*call, F.lit(False).alias("_file")).unionByName(marks_, allowMissingColumns=True)
    so_far = Window.partitionBy("session_id").orderBy("record_index", "_file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = both.withColumn("n", F.count_if("_file").over(so_far).cast("int")).withColumn("since", F.min("_since").over(so_far)).where("NOT _file AND n > 0")
    whole = whole.join(first, "session_id").select(*call, F.slice("files", F.lit(1), F.least("n", F.lit(5))).alias("files"), "since", "n")
    per, n = some.select(*call, "files", "since", "n").unionByName(whole), F.col("n")
    many = F.concat(F.lit("edits to "), n.cast("string"), F.lit(" files were discarded by a git command: "), t.listed(F.transform("files", lambda x: x["base"]), 5, n))
    detail = F.when(n == 1, "edits to this file were discarded by a git command").otherwise(many)
    return _signal(per, "abandoned_approach", F.lit(0.75), detail, F.when(n == 1, F.get("files", F.lit(0))["file_path"]), F.col("since"))


def abandoned_branches(edits: DataFrame, walked: DataFrame) -> DataFrame:
    left = walked.where("abandoned").select("session_id", "uuid").distinct()
    e = edits.join(left, ["session_id", "uuid"], "left_semi")
    seq = F.col("file_order") * (1 << 31) + F.col("edit_seq")
    return _signal(e, "abandoned_approach", F.lit(0.4), F.lit("edit sits on a conversation branch the session did not continue"), F.col("file_path"), seq=seq)


def returned_states(calls: DataFrame, returned: DataFrame) -> DataFrame:
    own = returned.select("session_id", "file_path", "call_seq")
    c = calls.drop("file_path").join(own, ["session_id", "call_seq"])
    return _signal(c, "abandoned_approach", F.lit(0.8), F.lit("file returned to a state it already had earlier in the session"), F.col("file_path"))


def abandoned(*parts: DataFrame) -> DataFrame:
    """All kinds of abandoned approaches; in ties those given first come first."""
    all_parts = None
    for k, part in enumerate(parts):
        own = part.withColumn("seq", F.col("seq") + F.lit(k) * F.lit(1 << 58))
        all_parts = own if all_parts is None else all_parts.unionByName(own)
    return dedupe(all_parts)


def external_dependencies(calls: DataFrame, edits: DataFrame) -> DataFrame:
    """Names added to manifests, then installs of names that nothing before reported."""
    m = edits.where(t.is_manifest(F.col("file_path")))
    m = m.withColumn("added", dependencies.added_of(F.col("file_path"), F.col("old_string"), F.coalesce("new_string", "content"))).where("size(added) > 0")
    first = F.col("file_order") * (1 << 31) + F.col("edit_seq")
    listed = _signal(m, "external_dependency", F.lit(0.7), F.concat(F.lit("added to "), t.basename(F.col("file_path")), F.lit(": "), F.array_join("added", ", ")), F.col("file_path"), seq=first)
    c = calls.where((F.col("name") == "Bash") & F.col("command").rlike(r"\b(?:install|i|add|get)\b")).withColumn("installed", shell.installed_of(F.col("command"))).where("installed.packages IS NOT NULL")
    names = c.select("session_id", "call_seq", F.explode("installed.packages").alias("package")).withColumn("package", t.package_name(F.col("package"))).distinct()
    # A name is new to a command unless a manifest or an earlier command of the session reported it.
    by_manifest = m.select("session_id", F.explode("added").alias("package")).select("session_id", t.package_name(F.col("package")).alias("package")).distinct()
    earliest = names.groupBy("session_id", "package").agg(F.min("call_seq").alias("first"))
    new = names.join(by_manifest, ["session_id", "package"], "left_anti").join(earliest, ["session_id", "package"]).where("first = call_seq").select("session_id", "call_seq").distinct()
    c = c.join(new, ["session_id", "call_seq"], "left_semi")
    ran = _signal(c, "external_dependency", F.lit(0.7), F.concat(F.lit("installed with "), F.col("installed.manager"), F.lit(": "), F.array_join("installed.packages", ", ")), seq=F.col("call_seq") + F.lit(1 << 62))
    return dedupe(listed.unionByName(ran))


def first_and_last(edits: DataFrame) -> DataFrame:
    """One row per file: its first edit, with the last edit's place and time."""
    own = F.struct("record_index", "uuid", "tool_use_id", "ts_raw", "tool")
    per = edits.groupBy("session_id", "file_path").agg(F.min_by(own, "edit_seq").alias("first"), F.max_by(own, "edit_seq").alias("last"), F.min("edit_seq").alias("file_order"))
    return per


def never_read(edits: DataFrame, reads: DataFrame) -> DataFrame:
    """Files whose first edit wasn't a Write and that no look of the session names.

    Looks that equal a path, end like it or start it are joined by equality of the path or of its
    ending folders; a session's globs are one index, which each of its files walks once.
    """
    per = first_and_last(edits).where(F.col("first.tool").isin("Edit", "MultiEdit", "Bash"))
    seen = same_paths(per.select("session_id", "file_path").distinct(), reads.select("session_id", "path").distinct())
    e = per.join(seen.select("session_id", "file_path").distinct(), ["session_id", "file_path"], "left_anti")
    e = e.select("session_id", "file_path", "file_order", "first.*", F.col("last.ts_raw").alias("last_ts"))
    return _signal(e, "unverified_assumption", F.lit(0.35), F.lit("file was edited without ever being read or searched in this session"), F.col("file_path"), ended=F.col("last_ts"), seq=F.col("file_order"))


def same_paths(files: DataFrame, looks: DataFrame) -> DataFrame:
    """Pairs (session_id, file_path, path) in which a look names an edited file."""
    is_glob = F.col("path").rlike(r"[*?]")
    plain, globs = looks.where(~is_glob), looks.where(is_glob)
    # A file is named by itself, by each folder above it, and (one of the two relative) by a shared ending.
    up = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.array_join(F.slice(F.split(c, "/"), F.lit(1), k), "/"))
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.array_join(F.slice(F.split(c, "/"), k, F.size(F.split(c, "/"))), "/"))
    bare = F.regexp_replace("path", r"(?<=.)/+\z", "")
    above = files.select("session_id", "file_path", F.explode(up(F.col("file_path"))).alias("key"))
    named = above.join(plain.select("session_id", "path", bare.alias("key")), ["session_id", "key"])
    shorter = files.select("session_id", "file_path", F.explode(ends(F.col("file_path"))).alias("key")).join(plain.where(~F.col("path").startswith("/")).select("session_id", "path", F.col("path").alias("key")), ["session_id", "key"])
    longer = plain.select("session_id", "path", F.explode(ends(F.col("path"))).alias("key")).join(files.where(~F.col("file_path").startswith("/")).select("session_id", "file_path", F.col("file_path").alias("key")), ["session_id", "key"])
    globbed = matched(globs, files)
    parts = [x.select("session_id", "file_path", "path") for x in (named, shorter, longer, globbed)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()


def unverified_fix(calls: DataFrame, edits: DataFrame) -> DataFrame:
    """Code whose last edit comes after the last check: one signal a session."""
    checks = calls.where(marks.checks(F.col("name"), F.col("command"))).groupBy("session_id").agg(F.max("record_index").alias("last_check"))
    code = edits.where(t.is_code_file(F.col("file_path")) & ~t.is_test_file(F.col("file_path")))
    last = F.max_by(F.struct("record_index", "uuid", "tool_use_id", "ts_raw"), "edit_seq").alias("last")
    per = code.groupBy("session_id", "file_path").agg(last, F.min("edit_seq").alias("file_order")).join(checks, "session_id", "left")
    stale = per.where(F.col("last.record_index") > F.coalesce("last_check", F.lit(-1)))
    # Only the first three names, the first file and the last one are told, so no list of all files is made.
    place = F.struct("last.record_index", "file_order")
    bases = stale.groupBy("session_id", t.basename(F.col("file_path")).alias("base")).agg(F.min(place).alias("place"))
    ranked = bases.withColumn("_rank", F.row_number().over(Window.partitionBy("session_id").orderBy("place", "base"))).where(F.col("_rank") <= 3)
    names = ranked.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "base"))), lambda x: x["base"]).alias("names"))
    counted = bases.groupBy("session_id").agg(F.count("*").cast("int").alias("n_names"))
    file = F.struct("last.record_index", "file_order", "file_path", "last")
    one = stale.groupBy("session_id").agg(F.min(file).alias("start"), F.max(file).alias("end"), F.count("*").alias("n"), F.max("last_check").alias("last_check"))
    one = one.join(names, "session_id").join(counted, "session_id")
    none = F.col("last_check").isNull()
    detail = F.concat(F.when(none, "no test, build or lint command ran in the whole session: ").otherwise("edited after the last test or build run, never checked again: "), t.listed(F.col("names"), 3, F.col("n_names")))
    # Of equal record indexes the later file comes last, as a stable sort leaves it.
    e = one.select("session_id", "start", "n", "last_check", "end.last.*", F.col("end.file_path").alias("end_path"), detail.alias("why"))
    return _signal(e, "unverified_fix", F.when(F.col("last_check").isNull(), 0.5).otherwise(0.6), F.col("why"), F.when(F.col("n") == 1, F.col("end_path")), F.col("start.last.ts_raw"), seq=F.lit(0))


def error_suppressed(calls: DataFrame, edits: DataFrame) -> DataFrame:
    before, after = F.coalesce("old_string", F.lit("")), F.coalesce("new_string", "content", F.lit(""))
    e = edits.where(~t.is_test_file(F.col("file_path"))).withColumn("_old", before).withColumn("_new", after).where("_new <> ''")
    failing = calls.where(marks.checks(F.col("name"), F.col("command")) & F.coalesce("is_error", F.lit(False))).where(shell.failed_check_of(F.col("command")))
    e = _marks(with_failure(e, calls), failing.select("session_id", "record_index").distinct(), F.lit(True), "check")
    old, new = F.col("_old"), F.col("_new")
    # Only texts in question go to Python, the others as nulls.
    asked = t.is_code_file(F.col("file_path")) & F.col("check").isNotNull() & marks.silenced_of(new, old).isNull() & new.rlike("catch|except")
    logged = F.when(shell.logged_only_of(F.when(asked, old), F.when(asked, new)), F.lit(fixed.LOGGED))
    e = e.withColumn("reason", F.coalesce(marks.silenced_of(old, new), logged)).where("reason IS NOT NULL")
    hit = F.col("failure").isNotNull()
    detail = F.when(hit, F.concat("reason", F.lit(", shortly after a failing command"))).otherwise(F.col("reason"))
    seq = F.col("file_order") * (1 << 31) + F.col("edit_seq")
    edited = _signal(e, "error_suppressed", F.when(hit, 0.7).otherwise(0.45), detail, F.col("file_path"), F.coalesce("failure._value", "ts_raw"), seq=seq)
    discards = (F.col("name") == "Bash") & t.like(F.col("command"), r"\|\|\s*true\b")
    ran_past = (F.col("name") == "Bash") & F.coalesce(marks.bypasses_of(F.col("command")), F.lit(False))
    c = calls.withColumn("_ignored", F.coalesce(marks.runs_check_of(F.when(discards, F.col("command"))), F.lit(False))).withColumn("_past", ran_past).where("_ignored OR _past")
    ignored = F.col("_ignored")
    ran = _signal(c, "error_suppressed", F.lit(0.5), F.when(ignored, "a check was run with its failure discarded by `|| true`").otherwise("a command was run with its safety check switched off"), seq=F.col("call_seq") + F.lit(1 << 62))
    return dedupe(edited.unionByName(ran))


def pauses(calls: DataFrame, millis: Callable[[Column], Column] = t.millis) -> DataFrame:
    """Calls with the number, first record, length and start of the last pause before them.

    A gap is to the call before, even one without a time, which hides it; ``millis`` says how a time becomes whole milliseconds.
    """
    by = Window.partitionBy("session_id").orderBy("call_seq")
    gap = millis(F.col("ts")) - millis(F.lag("ts").over(by))
    c = calls.withColumn("gap", gap).withColumn("paused_at", F.lag("ts_raw").over(by)).withColumn("opens", F.coalesce(F.col("gap") >= fixed.PAUSE_MS, F.lit(False)))
    running = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("pause", F.count_if("opens").over(running))
    return c.withColumn("last_pause", F.last(F.when(F.col("opens"), F.struct("record_index", "gap", "paused_at")), ignorenulls=True).over(running))


def stale_context(calls: DataFrame, looks: DataFrame) -> DataFrame:
    """The longest pause after which a file was edited whose latest look was before the pause.

    ``looks`` has (session_id, path, call_seq, record_index) of all that calls saw, edits included.
    """
    c = pauses(calls)
    e = c.where(F.col("name").isin(*fixed.EDIT_TOOLS) & F.col("file_path").isNotNull() & (F.col("pause") > 0))
    pairs = same_paths(e.select("session_id", "file_path").distinct(), looks.select("session_id", "path").distinct())
    known = looks.join(pairs, ["session_id", "path"]).select("session_id", "file_path", F.col("call_seq").alias("seen_seq"), F.col("record_index").alias("seen_index"), "path")
    # Looks and edits of a file in one order; a path's latest look counts, and an edit sees what comes before its own call.
    seen = known.select("session_id", "file_path", F.col("seen_seq").alias("call_seq"), "seen_index", F.lit(True).alias("is_look"))
    both = seen.unionByName(e.select("session_id", "file_path", "call_seq", F.lit(None).cast("int").alias("seen_index"), F.lit(False).alias("is_look")))
    so_far = Window.partitionBy("session_id", "file_path").orderBy("call_seq", "is_look").rowsBetween(Window.unboundedPreceding, -1)
    last = both.withColumn("looked", F.max("seen_index").over(so_far)).where("NOT is_look").select("session_id", "call_seq", "looked")
    hits = e.join(last, ["session_id", "call_seq"]).where(F.col("looked") < F.col("last_pause.record_index"))
    once = Window.partitionBy("session_id", "pause").orderBy("call_seq")
    hits = hits.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    one = hits.groupBy("session_id").agg(
        F.max_by(F.struct("record_index", "uuid", "tool_use_id", "ts_raw", "file_path", "last_pause"), F.struct(F.col("last_pause.gap"), -F.col("call_seq"))).alias("worst"),
        F.sort_array(F.collect_list(F.struct("call_seq", "file_path"))).alias("all"),
    )
    names = F.array_distinct(F.transform("all", lambda x: t.basename(x["file_path"])))
    n = F.size("all")
    detail = F.concat(
        F.lit("work resumed after a "), t.break_length(F.col("worst.last_pause.gap")), F.lit(" break and edited "), t.listed(names, 3), F.lit(" without reading "),
        F.when(F.size(names) > 1, "them").otherwise("it"), F.lit(" again"),
        F.when(n > 1, F.concat(F.lit(", and "), n.cast("string"), F.lit(" breaks in this session read that way"))).otherwise(""),
    )
    out = one.select("session_id", "worst.*", detail.alias("why"))
    return _signal(out, "stale_context", F.lit(0.4), F.col("why"), F.col("file_path"), F.col("last_pause.paused_at"), seq=F.lit(0))


def destructive(calls: DataFrame) -> DataFrame:
    hint = r"(?i)\brm\b|\bdrop\b|\btruncate\b|\bdelete\b|\bgit\b"
    c = calls.where((F.col("name") == "Bash") & F.col("command").rlike(hint)).withColumn("found", shell.destruction_of(F.col("command"))).where("found.detail IS NOT NULL")
    return dedupe(_signal(c, "destructive_command", F.col("found.weight"), F.col("found.detail")))


def gate(meta: DataFrame) -> DataFrame:
    """session_id, reason (null: eligible), known_gap_reachable."""
    reason = F.when(~F.col("has_file_edits"), "no-file-edits").when(F.col("calls") < fixed.LEAST_CALLS, "too-short")
    return meta.select("session_id", "cwd", reason.alias("reason"), "thinking_blocks", (F.col("thinking_blocks") > 0).alias("known_gap_reachable"))


def too_many_pairs(meta: DataFrame, edits: DataFrame, reads: DataFrame, most: int = fixed.SESSION_PAIRS) -> DataFrame:
    """Sessions with more pairs of edits and what they are held up to; the analysis leaves none of them out."""
    n = edits.groupBy("session_id").agg(F.count("*").alias("n_edits"))
    r = reads.groupBy("session_id").agg(F.countDistinct("path").alias("n_reads"))
    m = meta.join(n, "session_id", "left").join(r, "session_id", "left")
    both = F.col("edit_tool_uses") + F.coalesce("n_edits", F.lit(0))
    return m.where(both * (both + F.col("calls") + F.coalesce("n_reads", F.lit(0)) + F.col("records")) > most).select("session_id")


def without_reported(destructions: DataFrame, reported: DataFrame) -> DataFrame:
    """Less those whose call is already an abandoned approach; a missing call id equals a missing one."""
    ids = reported.select("session_id", F.col("tool_use_id").alias("_id")).distinct()
    return destructions.join(ids, (destructions.session_id == ids.session_id) & destructions.tool_use_id.eqNullSafe(ids._id), "left_anti")


def count_by_category(signals: DataFrame) -> DataFrame:
    return signals.groupBy("category").agg(F.count("*").alias("n"))


def strongest_first(signals: DataFrame) -> DataFrame:
    return signals.orderBy(F.desc("weight"), "record_index")


def in_order(signals: DataFrame) -> DataFrame:
    """By record, category and path in binary order."""
    return signals.orderBy("session_id", "record_index", "category", F.coalesce("file_path", F.lit("")))
