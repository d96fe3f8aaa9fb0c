"""Reading log files: lines in order, headers, formats, listings, and the files that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import project_slug
from ..tables import keep


#: Splits of files up to which their list is sent to all tasks: 128 TB of logs at Spark's usual 128 MB a split.
MOST_SPLITS = 1_000_000


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """(path, line_no, line) of all files below a path. Only ``\\n`` ends a line; one ``\\r`` before it goes.

    Files may be split between tasks. The text is read once and written as a table in the order of the splits; a line's number is its
    place in its split and the lines of the splits before, of which there is a row a split: that list is counted and sent to the tasks, and
    no text is exchanged. With more splits than ``MOST_SPLITS`` the list is joined.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "\r\\z", "").alias("line"))
    # Places are numbers of one scan, so the scan is written: a second one could be cut otherwise.
    raw = keep(raw, "lines-read")
    splits = raw.groupBy(F.col("path").alias("_path"), F.col("_start").alias("_from")).agg(F.min("_at").alias("_first"), F.count("*").alias("_lines"))
    before = Window.partitionBy("_path").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    splits = keep(splits.select("_path", "_from", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before")), "splits-read")
    splits = F.broadcast(splits) if splits.count() <= MOST_SPLITS else splits
    joined = raw.join(splits, (F.col("path") == F.col("_path")) & (F.col("_start") == F.col("_from")))
    return joined.select("path", (F.col("_before") + F.col("_at") - F.col("_first")).cast("int").alias("line_no"), "line")


def first_lines(lines: DataFrame, n: int = 1) -> DataFrame:
    return lines.where(F.col("line_no") < n)


def first_cwd(lines: DataFrame, most: int = 40) -> DataFrame:
    """The first folder named in the first lines of each file."""
    cwd = F.nullif(F.get_json_object("line", "$.cwd"), F.lit(""))
    return lines.where(F.col("line_no") < most).withColumn("cwd", cwd).where("cwd IS NOT NULL").groupBy("path").agg(F.min_by("cwd", "line_no").alias("cwd"))


def formats(lines: DataFrame) -> DataFrame:
    """(path, format) by the first line: b, c_context, c_events, c_old_events or a.

    An old event log has its kinds inside ``message``, so its second line decides.
    """
    get = F.get_json_object
    head = lines.where("line_no < 2").groupBy("path").agg(F.min_by("line", "line_no").alias("one"), F.max(F.when(F.col("line_no") == 1, F.col("line"))).alias("two"))
    header = (get("one", "$.type") == "metadata") & get("one", "$.protocol_version").isNotNull()
    kind = (
        F.when(get("one", "$.type") == "session_meta", "b").when(get("one", "$.role") == "_system_prompt", "c_context")
        .when(header & get("two", "$.message.type").isNotNull(), "c_old_events").when(header, "c_events").otherwise("a")
    )
    return head.select("path", kind.alias("format"))


def owning_session(path: Column) -> Column:
    """The session file that a sub-agent's file belongs to, or null for a session's own file."""
    hit = F.regexp_extract(path, r"^(.*?)/(?:subagents/)?agent-[^/]+\.jsonl\z", 1)
    return F.when(hit != "", F.concat(hit, F.lit(".jsonl")))


def agent_id(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"/agent-([^/]+)\.jsonl\z", 1), F.lit(""))


def rollout_id(path: Column) -> Column:
    """The id at the end of a format B file's name."""
    return F.nullif(F.regexp_extract(path, r"rollout-.*?([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl\z", 1), F.lit(""))


def expand(files: DataFrame) -> DataFrame:
    """The files to analyse: each once, without sub-agents of a listed session and contexts that an event log shadows."""
    own = files.select("path").distinct().withColumn("owner", owning_session(F.col("path"))).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*\z", 1))
    listed = own.select(F.col("path").alias("owner")).distinct()
    kept = own.where("owner IS NULL").unionByName(own.where("owner IS NOT NULL").join(listed, "owner", "left_anti").select(own.columns))
    events = own.where(F.col("path").rlike(r"/(wire|events)\.jsonl\z")).select("folder").distinct()
    context = F.col("path").rlike(r"/context\.jsonl\z")
    shadowed = kept.where(context).join(events, "folder", "left_semi").select("path")
    return kept.select("path").join(shadowed, "path", "left_anti").orderBy("path")


def listing(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, project, session_id, size_bytes, modified) of session files; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.regexp_extract("path", r"/([^/]+)/[^/]+\z", 1).alias("project"), F.regexp_extract("path", r"([^/]+)\.jsonl\z", 1).alias("session_id"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def sessions_of(files: DataFrame, cwd: str, below: bool = False) -> DataFrame:
    """Sessions of a folder (``below``: and of the folders below it), newest first, by the folder's slug.

    A slug can't tell a folder below from one beside it with a longer name; ``first_cwd`` decides among the few that are left.
    """
    slug = project_slug(F.lit(cwd))
    own = F.col("project") == slug
    return files.where(own | F.col("project").startswith(F.concat(slug, F.lit("-"))) if below else own).orderBy(F.desc("modified"), "path")


def within_days(files: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Files that changed in the last days."""
    return files.where(F.col("modified") >= now - F.make_interval(days=F.lit(days)))


def state_files(spark: SparkSession, path: str) -> DataFrame:
    """Format C sessions by their ``state.json``: folder, id, cwd, workspace (the folder above), forked_from and created_at."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "state.json").text(path, wholetext=True)
    get = lambda k: F.nullif(F.get_json_object("value", f"$.{k}"), F.lit(""))
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*\z", 1)
    return raw.select(folder.alias("folder"), F.coalesce(get("id"), F.element_at(F.split(folder, "/"), -1)).alias("session_id"), get("cwd").alias("cwd"), F.element_at(F.split(folder, "/"), -2).alias("workspace"), get("forkedFrom").alias("forked_from"), get("createdAt").alias("created_at"))


def work_dirs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path) of the work folders that the ``kimi.json`` of one or several homes name."""
    raw = spark.read.text(paths, wholetext=True)
    found = F.from_json(F.get_json_object("value", "$.work_dirs"), "array<struct<path:string>>")
    return raw.select(F.explode(found).alias("d")).select("d.path").where("path IS NOT NULL").distinct()


def newest(files: DataFrame, most: int = fixed.LISTED_B) -> DataFrame:
    return files.orderBy(F.desc("modified"), "path").limit(most)


def survey(files: DataFrame, most: int = fixed.SURVEYED) -> DataFrame:
    """Sessions per project, most first, over the newest files."""
    return newest(files, most).groupBy("project").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "project")


def subagents(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Sub-agent files with the call that started them, from their ``.meta.json`` where there is one."""
    meta = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "agent-*.meta.json").text(path, wholetext=True)
    meta = meta.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.meta\.json\z", "").alias("stem"), F.get_json_object("value", "$.toolUseId").alias("call"))
    own = files.withColumn("owner", owning_session(F.col("path"))).where("owner IS NOT NULL").withColumn("stem", F.regexp_replace("path", r"\.jsonl\z", ""))
    return own.join(meta, "stem", "left").select("path", F.col("owner").alias("session_path"), agent_id(F.col("path")).alias("agent_id"), "call")


def linked_calls(agents: DataFrame, results: DataFrame) -> DataFrame:
    """The call of each sub-agent: of its meta file, else of a result that names its agent id or its run."""
    by_agent = results.where("agent_id IS NOT NULL").groupBy("session_id", "agent_id").agg(F.min("tool_use_id").alias("by_agent"))
    by_run = results.where("run_id IS NOT NULL").groupBy("session_id", F.col("run_id").alias("run")).agg(F.min("tool_use_id").alias("by_run"))
    out = agents.join(by_agent, ["session_id", "agent_id"], "left").join(by_run, ["session_id", "run"], "left")
    return out.withColumn("call", F.coalesce("call", "by_agent", "by_run")).drop("by_agent", "by_run")


def workspaces(state: DataFrame, dirs: DataFrame) -> DataFrame:
    """Format C sessions with their folder: of their state, else of the workspace whose path has their folder's md5, else of the prompt."""
    known = dirs.select(F.md5(F.col("path").cast("binary")).alias("workspace"), F.col("path").alias("by_md5")).distinct()
    said = F.nullif(F.regexp_extract("system_prompt", r"(?:working directory|cwd)[^\n]*?[`:]\s*`?(/[^\s`]+)", 1), F.lit(""))
    return state.join(known, "workspace", "left").withColumn("cwd", F.coalesce("cwd", "by_md5", said)).drop("by_md5")


def last_runs(log: DataFrame, tangled_ms: int = 10_000) -> DataFrame:
    """The last run of each session in a client's log (session_id, opened_ms, run); runs opening within ten seconds of each other tell nothing."""
    w = Window.partitionBy("session_id").orderBy("opened_ms", "run")
    near = F.coalesce(F.col("opened_ms") - F.lag("opened_ms").over(w) < tangled_ms, F.lit(False)) | F.coalesce(F.lead("opened_ms").over(w) - F.col("opened_ms") < tangled_ms, F.lit(False))
    clear = log.withColumn("_near", near).where("NOT _near")
    return clear.groupBy("session_id").agg(F.max_by("run", F.struct("opened_ms", "run")).alias("run"))


def after_copy(events: DataFrame) -> DataFrame:
    """Events of a forked session after the part that was copied (session_id, seq, at, copied_until)."""
    filled = F.last("at", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("_at", filled).where("copied_until IS NULL OR _at > copied_until").drop("_at")
