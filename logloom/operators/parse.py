"""From lines to records, blocks, calls, edits, reads and one row of metadata per session.

Every table carries (session_id, record_index, ...), for Spark rows have no order of their own. All
joins and windows are on session_id, so one exchange by session serves them. A table derived from another
reads it once: what a line, a call or a session is told by is gathered in one pass, not by joining passes.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import fixed, shell
from ..functions.text import as_string


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _text(v: Column | str, path: str) -> Column:
    """A string as written; null if the value is of another type."""
    at = _get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", _get(v, path))


def _true(v: Column | str, path: str) -> Column:
    """Strictly the JSON value true."""
    at = _get(v, path, "variant")
    return F.coalesce((F.schema_of_variant(at) == "BOOLEAN") & _get(v, path, "boolean"), F.lit(False))


def _is_object(v: Column | str) -> Column:
    """Whether a value is an object, without spelling out the schema of all that it holds."""
    return _get(v, "$", "struct<type:variant>").isNotNull()


#: What JSON and line readers call white space.
_BLANK = (" ", "\t", "\n", "\x0b", "\f", "\r", "\ufeff", "\xa0")


def _trimmed(line: Column) -> Column:
    """A line without the white space around it; most have none and never meet the pattern."""
    blank = functools.reduce(lambda a, b: a | b, (line.startswith(x) | line.endswith(x) for x in _BLANK))
    return F.when(blank, F.regexp_replace(line, r"^[\s\x{FEFF}\x{A0}]+|[\s\x{FEFF}\x{A0}]+\z", "")).otherwise(line)


def read(raw: DataFrame) -> DataFrame:
    """Lines (line) with status (blank, malformed, not_an_object, record) and the record as VARIANT; each line by itself.

    A line that is too long, or that a budget has ``refused``, isn't parsed.
    """
    unread = F.length("line") > fixed.LINE_CHARS
    unread = unread | F.col("refused") if "refused" in raw.columns else unread
    own = F.col("_trimmed")
    parsed = F.when((F.length(own) <= fixed.LINE_CHARS) & ~unread, F.try_parse_json(own))
    # Exploded, for a filter moves below what explodes only without its columns; below a projection it would parse each line anew for each use.
    out = raw.withColumn("_trimmed", _trimmed(F.col("line"))).withColumn("_read", F.explode_outer(F.array(F.struct(own.alias("trimmed"), parsed.alias("raw")))))
    out, trimmed = out.withColumn("raw", F.col("_read.raw")), F.col("_read.trimmed")
    # JSON that begins with a brace is an object.
    status = (
        F.when(trimmed == "", "blank").when(F.col("raw").isNull(), "malformed")
        .when(~trimmed.startswith("{"), "not_an_object").otherwise("record")
    )
    return out.withColumn("status", status).withColumn("oversize", unread).drop("_trimmed", "_read")


def lines(raw: DataFrame) -> DataFrame:
    """(session_id, line_no, line) as ``read`` tells them, and each record's index, which counts the records before it."""
    out = read(raw)
    before = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    index = F.when(F.col("status") == "record", F.count_if(F.col("status") == "record").over(before) - 1)
    return out.withColumn("record_index", index.cast("int"))


def records(numbered: DataFrame, *more: str) -> DataFrame:
    return numbered.where("status = 'record'").select("session_id", "record_index", *_fields(), "raw", *more)


def _fields() -> list[Column]:
    return [
        F.coalesce(as_string(_text("raw", "$.type")), F.lit("unknown")).alias("type"),
        _text("raw", "$.uuid").alias("uuid"),
        F.coalesce(_text("raw", "$.parentUuid"), _text("raw", "$.logicalParentUuid")).alias("parent"),
        as_string(_text("raw", "$.sessionId")).alias("own_session"),
        as_string(_text("raw", "$.timestamp")).alias("ts_raw"),
        F.try_to_timestamp(as_string(_text("raw", "$.timestamp"))).alias("ts"),
        _true("raw", "$.isSidechain").alias("is_sidechain"),
        as_string(_text("raw", "$.cwd")).alias("cwd"),
        as_string(_text("raw", "$.gitBranch")).alias("git_branch"),
        as_string(_text("raw", "$.version")).alias("version"),
        _text("raw", "$.parentToolUseID").alias("parent_call"),
    ]


def _joined_parts(content: Column) -> Column:
    """Text of a result's content: a string, or the strings and texts of its parts by line."""
    parts = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(parts, lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).otherwise(_text(p, "$.text")))
    joined = F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")
    return F.when(parts.isNotNull(), joined).when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise("")


def _items() -> Column:
    """The items of a record's content; a string is one text item."""
    content = _get("raw", "$.message.content", "variant")
    listed = _get("raw", "$.message.content", "array<variant>")
    whole = F.to_json(F.struct(F.lit("text").alias("type"), _get("raw", "$.message.content").alias("text")))
    return F.when(listed.isNotNull(), listed).when(F.schema_of_variant(content) == "STRING", F.array(F.parse_json(whole)))


def time_of() -> Column:
    return as_string(_text("raw", "$.timestamp"))


def call_events() -> Column:
    """Of a line as ``read`` tells it: (block, uses, id) of its calls with id and name and of its results with an id, in order."""
    of = lambda x: as_string(_text(x, "$.type"))
    numbered = F.transform(_items(), lambda x, i: F.struct(i.alias("block"), (of(x) == "tool_use").alias("uses"), of(x).alias("kind"), as_string(_text(x, "$.id")).alias("id"), as_string(_text(x, "$.name")).alias("name"), as_string(_text(x, "$.tool_use_id")).alias("target")))
    told = F.filter(numbered, lambda e: ((e["kind"] == "tool_use") & e["id"].isNotNull() & e["name"].isNotNull()) | ((e["kind"] == "tool_result") & e["target"].isNotNull()))
    events = F.transform(told, lambda e: F.struct(e["block"].alias("block"), e["uses"].alias("uses"), F.coalesce(F.when(e["uses"], e["id"]), e["target"]).alias("id")))
    counts = (F.col("status") == "record") & ~F.coalesce(_text("raw", "$.type"), F.lit("")).isin(*fixed.REQUEST_RECORDS)
    return F.when(counts, events)


def blocks(recs: DataFrame) -> DataFrame:
    """Content blocks; a string is one text block, items that are no objects are left out, requests have none."""
    r = recs.where(~F.col("type").isin(*fixed.REQUEST_RECORDS))
    # An outer explode, for an inner one would make the items again to see whether there are any.
    out = r.select("*", F.posexplode_outer(_items()).alias("block_index", "block")).where(_is_object("block"))
    return _told(out)


def _told(out: DataFrame) -> DataFrame:
    """Blocks with their type and text."""
    out = out.withColumn("block_type", F.coalesce(as_string(_text("block", "$.type")), F.lit("unknown")))
    text = (
        F.when(F.col("block_type") == "text", as_string(_text("block", "$.text")))
        .when(F.col("block_type") == "thinking", as_string(_text("block", "$.thinking")))
        .when(F.col("block_type") == "tool_result", _joined_parts(_get("block", "$.content", "variant")))
    )
    return out.withColumn("text", text)


_DETAIL = "$.toolUseResult"


def _result() -> Column:
    first, n, total = (_get("raw", f"{_DETAIL}.file.{k}", "bigint") for k in ("startLine", "numLines", "totalLines"))
    return F.struct(
        "record_index",
        _true("block", "$.is_error").alias("is_error"),
        F.coalesce(as_string(F.col("text")), _text("raw", _DETAIL), F.lit("")).alias("text"),
        _text("raw", f"{_DETAIL}.stdout").alias("stdout"),
        _text("raw", f"{_DETAIL}.stderr").alias("stderr"),
        F.when((first == 1) & (n == total), _text("raw", f"{_DETAIL}.file.content")).alias("file_content"),
        _true("raw", f"{_DETAIL}.interrupted").alias("interrupted"),
    )


def _edited_files() -> Column:
    return _get("raw", f"{_DETAIL}.toolStats.editFileCount", "double")


def calls(blks: DataFrame, *more: str) -> DataFrame:
    """Tool calls with id and name, numbered in order, with their final result.

    A result goes to the latest call of its id before it; of a call's results the last one stays. Calls and results are read in one pass and
    stay where their session is: running counts of calls, over the session and over an id, tell which results are whose.
    """
    e = call_rows(blks, *more)
    within = lambda *by: Window.partitionBy("session_id", *by).orderBy("record_index", "block_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("call_seq", (F.count_if("uses").over(within()) - 1).cast("int"))
    e = e.withColumn("turn", F.count_if("uses").over(within("tool_use_id"))).where("turn > 0")
    return with_arguments(with_results(e, within("tool_use_id", "turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).drop("turn"))


def call_rows(blks: DataFrame, *more: Column | str) -> DataFrame:
    """Calls with id and name (``uses``) and results with an id, a row each."""
    of = F.col("block_type")
    b = blks.where(of.isin("tool_use", "tool_result")).withColumn("uses", of == "tool_use")
    asked = lambda c: F.when(F.col("uses"), c)
    return b.select(
        "session_id", "record_index", "block_index", "uses", as_string(F.when(F.col("uses"), _text("block", "$.id")).otherwise(_text("block", "$.tool_use_id"))).alias("tool_use_id"),
        asked(as_string(_text("block", "$.name"))).alias("name"), asked(_input()).alias("input"), "uuid", "ts_raw", "ts", "is_sidechain", "cwd",
        F.when(~F.col("uses"), _result()).alias("result"), F.when(~F.col("uses"), _edited_files().isNotNull()).alias("counted"), *more,
    ).where("tool_use_id IS NOT NULL AND (name IS NOT NULL OR NOT uses)")


def with_results(e: DataFrame, whole: WindowSpec) -> DataFrame:
    """The calls of such rows with the last of the results that ``whole`` puts beside each."""
    e = e.withColumn("result", F.last("result", ignorenulls=True).over(whole)).withColumn("counted", F.coalesce(F.max("counted").over(whole), F.lit(False)))
    return e.where("uses").drop("uses")


def _input() -> Column:
    given = _get("block", "$.input", "variant")
    return F.when(_is_object(given), given).otherwise(F.parse_json(F.lit("{}")))


def with_arguments(uses: DataFrame) -> DataFrame:
    """Calls with their command, unless it is too long to be read, and their file."""
    command = F.when(F.col("name") == "Bash", _text("input", "$.command"))
    uses = uses.withColumn("command", F.when(F.length(command) <= fixed.COMMAND_CHARS, command)).withColumn("unread", F.length(command) > fixed.COMMAND_CHARS)
    return uses.withColumn("file_path", as_string(_text("input", "$.file_path")))


def edits(uses: DataFrame) -> DataFrame:
    """File edits: of edit tools, one per step, and of shell commands that rewrite files in place, without sides."""
    tool = F.col("name").isin(*fixed.EDIT_TOOLS)
    path = F.when(tool, F.coalesce("file_path", as_string(_text("input", "$.notebook_path"))))
    # Python is given only what it has to read; other rows go to it as nulls and come back as null.
    shelled = F.when(~tool & F.col("command").rlike("sed|awk|perl|ruby"), F.col("command"))
    found = uses.withColumn("_path", path).withColumn("_shelled", shelled).where("_path IS NOT NULL OR _shelled IS NOT NULL")
    found = found.withColumn("_paths", shell.edit_paths_of(F.col("_shelled"), F.when(F.col("_shelled").isNotNull(), F.coalesce("cwd", F.lit("")))))
    none = F.lit(None).cast("string")
    side = lambda step, file, old, new, content: F.struct(step.cast("int").alias("step"), file.alias("file_path"), old.alias("old_string"), new.alias("new_string"), content.alias("content"))
    steps = F.try_variant_get("input", "$.edits", "array<variant>")
    numbered = F.filter(F.transform(steps, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: _is_object(s["x"]))
    several = F.transform(numbered, lambda s: side(s["i"], F.col("_path"), as_string(_text(s["x"], "$.old_string")), _text(s["x"], "$.new_string"), none))
    single = F.array(side(F.lit(0), F.col("_path"), as_string(_text("input", "$.old_string")), F.coalesce(_text("input", "$.new_string"), _text("input", "$.new_source")), as_string(_text("input", "$.content"))))
    in_place = F.transform("_paths", lambda p, i: side(i, p, none, none, none))
    made = F.when(F.col("_path").isNull(), in_place).when(steps.isNotNull(), several).otherwise(single)
    made = found.select("session_id", "record_index", "block_index", "call_seq", "tool_use_id", F.col("name").alias("tool"), "uuid", "ts_raw", "ts", F.explode_outer(made).alias("e")).where("e IS NOT NULL")
    return order_edits(made.select(*(c for c in made.columns if c != "e"), "e.*"))


def order_edits(found: DataFrame) -> DataFrame:
    """edit_seq inside a session and file_order, the place of a file's first edit among files."""
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("record_index", "block_index", "call_seq", "step")) - 1
    out = found.withColumn("edit_seq", seq)
    return out.withColumn("file_order", F.min("edit_seq").over(Window.partitionBy("session_id", "file_path")))


def reads(uses: DataFrame) -> DataFrame:
    """(session_id, path, record_index) of everything that a call looked at; commands by their words."""
    looked = F.when(F.col("name").isin(*fixed.LOOKUP_TOOLS), F.coalesce("file_path", as_string(_text("input", "$.path"))))
    asked = F.when(F.col("command").rlike(r"\b(cat|head|tail|less|more|bat|nl|wc|sed|awk|rg|grep|egrep|fgrep|jq|yq|xxd|od|file|stat|diff|git)\b"), F.col("command"))
    found = uses.select("session_id", "record_index", looked.alias("looked"), asked.alias("asked")).where("looked IS NOT NULL OR asked IS NOT NULL")
    found = found.withColumn("paths", shell.read_paths_of(F.col("asked")))
    own = F.when(F.col("looked").isNotNull(), F.array("looked")).otherwise(F.col("paths"))
    return found.select("session_id", F.explode_outer(own).alias("path"), "record_index").where("path IS NOT NULL")


#: What a command that writes can't do without: a redirection, or one of these programs.
_MAY_WRITE = ">|<<|" + "|".join((*fixed.MOVERS, *fixed.IN_PLACE_EDITORS, "tee", "git"))


def session_meta(numbered: DataFrame, uses: DataFrame) -> DataFrame:
    """One row per session: where, when, counts, and whether files were edited."""
    own = ~F.col("is_sidechain")
    last = lambda c: F.coalesce(F.max_by(c, F.when(own & F.col(c).isNotNull(), F.col("record_index"))), F.min_by(c, F.when(F.col(c).isNotNull(), F.col("record_index"))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("record_index")))
    # One pass over the lines: a row a block, and one for a line without blocks. Lines and records count at their first row.
    told = numbered.select("session_id", "record_index", "status", "oversize", "raw", *_fields())
    items = F.when((F.col("status") == "record") & ~F.col("type").isin(*fixed.REQUEST_RECORDS), _items())
    told = _told(told.select("*", F.posexplode_outer(items).alias("block_index", "block")))
    head, record = F.coalesce(F.col("block_index") == 0, F.lit(True)), F.col("status") == "record"
    counted, is_block = (lambda c: F.count_if(head & c)), _is_object("block")
    thinking = is_block & (F.col("block_type") == "thinking")
    shown = thinking & (F.trim(F.coalesce("text", F.lit(""))) != "")
    base = told.groupBy("session_id").agg(
        first("own_session").alias("own_session"), last("cwd").alias("cwd"), last("git_branch").alias("git_branch"), last("version").alias("version"),
        first("ts_raw").alias("started_at"), F.max("ts_raw").alias("ended_at"), counted(record & (F.col("type") == "assistant")).alias("assistant_records"),
        counted(record & ~own).alias("sidechain_records"), counted(record).alias("records"), counted(F.lit(True)).alias("lines"),
        *(counted(F.col("status") == kind).alias(kind) for kind in ("blank", "malformed", "not_an_object")), F.max("oversize").alias("opaque"),
        F.max(F.when(record & (F.col("type") == "cost-state") & own, F.col("record_index"))).alias("stop"),
        F.count_if(shown).alias("thinking_blocks"), F.count_if((thinking & ~shown) | (is_block & (F.col("block_type") == "redacted_thinking"))).alias("hidden_thinking_blocks"),
        F.max(is_block & (F.col("block_type") == "tool_result") & F.coalesce(_edited_files() > 0, F.lit(False))).alias("delegated_edits"),
        F.collect_set(F.when(record & ~own, F.col("parent_call"))).alias("linked"),
    )
    base = base.withColumn("last_stop", F.when(F.col("records") > 0, F.coalesce("stop", F.lit(-1))))
    ok = ~F.coalesce(F.col("result.is_error"), F.lit(False))
    keys = F.expr("json_object_keys(to_json(input))")
    named = (*fixed.EDIT_TOOLS, *fixed.LOOKUP_TOOLS, *fixed.BYSTANDER_TOOLS, "Bash")
    # Python is given only what it has to read; other rows go to it as nulls and come back as null.
    other = ~F.col("name").isin(*named)
    writer = F.col("name").isin(*fixed.EDIT_TOOLS) | F.coalesce("unread", F.lit(False))
    writer = writer | F.coalesce(shell.writes_of(F.when(F.col("command").rlike(_MAY_WRITE), F.col("command"))), F.lit(False))
    writer = writer | F.coalesce(shell.may_write_of(F.when(other, F.col("name")), F.when(other, keys)), F.lit(False))
    commits = F.array_contains(shell.git_commands_of(F.when(F.col("command").contains("commit"), F.col("command"))), "commit")
    u = uses.withColumn("_wrote", writer | (commits & ok)).withColumn("_away", F.col("name").isin(*fixed.DELEGATION_TOOLS) & ok & ~F.col("counted"))
    # Calls that ran as far as they tell themselves; the others ran if they come after the last stop, which the other pass knows.
    ran = F.col("result").isNotNull() | F.col("is_sidechain")
    acts = u.groupBy("session_id").agg(
        F.count("*").alias("calls"), F.count_if(F.col("name").isin(*fixed.EDIT_TOOLS)).alias("edit_tool_uses"),
        F.max(ran & F.col("_wrote")).alias("wrote"), F.max(F.when(F.col("_wrote"), F.col("record_index"))).alias("last_write"),
        F.collect_list(F.when(F.col("_away"), F.struct("tool_use_id", ran.alias("ran"), "record_index"))).alias("away"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = base.join(acts, "session_id", "left")
    # Delegations whose sub-agent's records aren't in the session.
    ran_away = F.transform(F.filter("away", lambda d: d["ran"] | (d["record_index"] > F.col("last_stop"))), lambda d: d["tool_use_id"])
    unseen = F.size(F.array_except(ran_away, F.col("linked"))) > 0
    parts = (F.col("wrote"), F.col("last_write") > F.col("last_stop"), F.when(F.size("away") > 0, unseen), F.col("opaque"), F.col("delegated_edits"))
    flag = functools.reduce(lambda a, b: a | b, (F.coalesce(p, F.lit(False)) for p in parts))
    return out.select(
        "session_id", "own_session", "cwd", "git_branch", "version", "started_at", "ended_at", "last_stop",
        *(zero(c) for c in ("records", "assistant_records", "sidechain_records", "thinking_blocks", "hidden_thinking_blocks", "calls", "edit_tool_uses", "lines", "blank", "malformed", "not_an_object")),
        flag.alias("has_file_edits"),
    )


def unknown_types(recs: DataFrame) -> DataFrame:
    """Histogram of record types outside the known list, one map per session."""
    counted = recs.where(~F.col("type").isin(*fixed.RECORD_TYPES)).groupBy("session_id", "type").count()
    return counted.groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "count")))).alias("unknown_types"))


def has_skips(meta: DataFrame, unknown: DataFrame) -> DataFrame:
    known = meta.join(unknown.select("session_id", F.lit(True).alias("_odd")), "session_id", "left")
    return known.select("session_id", ((F.col("malformed") > 0) | (F.col("not_an_object") > 0) | F.col("_odd").isNotNull()).alias("has_skips"))
