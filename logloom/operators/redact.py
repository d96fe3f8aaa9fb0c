"""Redaction of whole sessions. One of usual length is read in order and redacted in one go; a longer one is never gathered: what needs the session is worked out
from narrow tables first. Both give the same lines.

For long sessions pass one reads each line by itself: the folder it names, the values that its commands write into dotenv files, and an event a call,
result and background task. Which results show a dotenv file is a fixpoint over call and task ids: a call that touches such
a file taints its id, a result of a tainted call taints the task that it started, and a later call that follows the task is tainted
too. A session's calls and tasks of usual number are walked in one group; of longer sessions a round is one join of the newly tainted ids with the events, so
there are as many rounds as links in the longest chain.
Pass two redacts each line by itself again, given its session's folder, its tainted blocks, and an automaton of its session's learned
values. A session may be of any size and lie in any number of tasks. What tasks are sent is learned values, in portions of bounded bytes.

``redact_session`` does the same to one session's lines in order; the tables must give the same lines.

Cases: a blank line goes; a line that isn't JSON is redacted as a text, JSON that is no object as a value, both counted in ``unparsed_lines``;
a null line is blank; a record that is nested too deep to be walked goes whole; line numbers are kept, with gaps; lines of a session that share a number are redacted each, in no order between them;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dotenv, fixed, paths, redaction
from ..functions.paths import Roots, marker
from ..tables import keep, spread

#: All values of a session are cut; a number here would keep its first so many.
MOST_LEARNED: int | None = None
#: Tainted calls and tasks of a session up to which it is one group: about 100 MB.
MOST_IN_GROUP = 1_000_000
#: Rows up to which a narrow table is sent to all tasks, and bytes of learned values that are sent at once.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Characters of a session up to which it is held and redacted in one go: about 40 MB with all that is made of it.
HELD_CHARS = 4 << 20
#: Characters of learned values that are looked for at once: an automaton of about 200 MB.
AUTOMATON_CHARS = 4 << 20
_ACCOUNT = frozenset(fixed.ACCOUNT_FIELDS)
_SAYS_WHAT = frozenset((*fixed.SAYS_WHAT, *fixed.PATH_KEYS))
_INPUT = re.compile(r"\s*<bash-input>(.*)</bash-input>\s*\Z", re.S)


# --- one record --------------------------------------------------------------------------------
def _content(record: dict):
    message = record.get("message")
    return message.get("content") if isinstance(message, dict) else None


def typed_command(record: dict) -> str | None:
    """The command that a person typed behind ``!``."""
    said = _content(record)
    found = _INPUT.match(said) if isinstance(said, str) and "<bash-input>" in said else None
    return found.group(1) if found else None


def typed_output(record: dict) -> bool:
    said = _content(record)
    return isinstance(said, str) and said.lstrip().startswith("<bash-stdout>")


def _strings(value) -> Iterator[str]:
    pending = [value]
    while pending:
        x = pending.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, list):
            pending += x
        elif isinstance(x, dict):
            pending += x.values()


def cut_call(block: dict) -> tuple[dict, list[str], int, bool]:
    """A call's block without what it writes into dotenv files, the values, how many texts went, and whether it touches such a file."""
    given, values, n, touches = block["input"], [], 0, False
    command = given.get("command")
    if isinstance(command, str):
        cut, values = dotenv.cut_writes(command)
        if cut != command:
            given, n, touches = {**given, "command": cut}, 1, True
        touches |= dotenv.reads(command)
    if dotenv.call_names_one(block.get("name"), given):
        given, more, m = dotenv.cut_input(given)
        values, n, touches = values + more, n + m, True
    return (block if given is block["input"] else {**block, "input": given}), values, n, touches


def _calls_and_results(record: dict) -> Iterator[tuple[int, dict]]:
    content = _content(record)
    for k, block in enumerate(content if isinstance(content, list) else ()):
        if isinstance(block, dict) and ((block.get("type") == "tool_use" and isinstance(block.get("input"), dict)) or (block.get("type") == "tool_result" and isinstance(block.get("tool_use_id"), str))):
            yield k, block


def _written_out(text: str) -> str:
    """A text that UTF-8 can hold: half of a surrogate pair, which JSON may escape, can't be stored."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def facts_of(record: dict) -> tuple[str | None, bool | None, list[str], list[tuple]]:
    return _facts_and_cuts(record)[:4]


def _facts_and_cuts(record: dict) -> tuple[str | None, bool | None, list[str], list[tuple], dict[int, tuple[dict, int]]]:
    """(folder, typed, values written, events, what ``cut_call`` changes by block): ``typed`` is whether a typed command touches a dotenv file, None if there is none;
    an event is (block, kind, id, other id): ``taints`` by itself, ``follows`` a task, ``starts`` a task, ``answers`` a call.
    """
    cwd = record.get("cwd")
    cwd = cwd if isinstance(cwd, str) and paths.is_absolute(cwd) else None
    typed, values, events, cuts = None, [], [], {}
    command = typed_command(record)
    if command is not None:
        cut, values = dotenv.cut_writes(command)
        typed = cut != command or dotenv.reads(command)
    for k, block in _calls_and_results(record):
        if block["type"] == "tool_use":
            cut, more, n, touches = cut_call(block)
            if n:
                cuts[k] = cut, n
            values = values + more
            name = block.get("id")
            if isinstance(name, str):
                events += [(k, "taints", name, None)] if touches else [(k, "follows", task, name) for task in dotenv.tasks_of(block["input"])]
        else:
            events.append((k, "answers", block["tool_use_id"], None))
            detail = record.get("toolUseResult")
            task = detail.get("backgroundTaskId") if isinstance(detail, dict) else None
            if isinstance(task, str):
                events.append((k, "starts", block["tool_use_id"], task))
    events = [(k, kind, _written_out(a), b and _written_out(b)) for k, kind, a, b in events]
    return cwd and _written_out(cwd), typed, [v for v in values if v == _written_out(v)], events, cuts


def shown(record: dict, blocks: Iterable[int], output: bool) -> list[str]:
    """Values in the tainted results of a record, or in what a typed command printed."""
    values: list[str] = []
    content = _content(record)
    if output and isinstance(content, str):
        return [v for v in dotenv.learned(re.sub(r"</?bash-std(?:out|err)>", "\n", content)) if v == _written_out(v)]
    for k in blocks:
        for text in (*_strings(content[k].get("content")), *_strings(record.get("mcpMeta")), *_strings(record.get("toolUseResult"))):
            values += dotenv.learned(text)
    return [v for v in values if v == _written_out(v)]


def _without_dotenv(record: dict, blocks: frozenset[int], output: bool, counts: Counter, cuts: dict[int, tuple[dict, int]] | None = None) -> dict:
    """``cuts``: what ``_facts_and_cuts`` told, if it was asked before."""
    content = _content(record)
    command = typed_command(record)
    if command is not None:
        cut, _ = dotenv.cut_writes(command)
        if cut == command:
            return record
        counts["dotenv"] += 1
        return {**record, "message": {**record["message"], "content": f"<bash-input>{cut}</bash-input>"}}
    if output:
        counts["dotenv"] += 1
        return {**record, "message": {**record["message"], "content": dotenv.MARK}}
    new = None
    for k, block in _calls_and_results(record):
        if block["type"] == "tool_use":
            if cuts is None:
                changed, _, n, _ = cut_call(block)
            else:
                changed, n = cuts.get(k, (block, 0))
        else:
            changed, n = ({**block, "content": dotenv.MARK}, 1) if k in blocks else (block, 0)
        if n:
            new = list(content) if new is None else new
            new[k] = changed
            counts["dotenv"] += n
    if new is not None:
        record = {**record, "message": {**record["message"], "content": new}}
    if blocks and "toolUseResult" in record:
        counts["dotenv"] += 1
        record = {**record, "toolUseResult": dotenv.MARK}
    return record


def stripped(record: dict, counts: Counter) -> dict:
    """A record without the payloads of requests and attachments, the harness's fields, account ids, and what the harness says in the person's place."""
    kind = record.get("type")
    if kind in fixed.STRIPPED_RECORDS:
        record = {k: v for k, v in record.items() if k in fixed.STRIPPED_KEEP}
        counts["attachment"] += 1
    elif kind == "attachment":
        given = record.get("attachment")
        of = given.get("type") if isinstance(given, dict) else None
        record = {k: v for k, v in record.items() if k not in ("rendered", "renderedRole")} | {"attachment": {"type": of} if isinstance(of, str) else {}}
        counts["attachment"] += 1
    gone = [k for k in record if k in fixed.HARNESS_FIELDS or k.lower() in _ACCOUNT]
    if gone:
        record = {k: v for k, v in record.items() if k not in gone}
        counts["attachment"] += 1
    if kind == "user" and record.get("isMeta") is True and isinstance(record.get("message"), dict):
        record = {**record, "message": {**record["message"], "content": marker("meta")}}
        counts["attachment"] += 1
    return record


def cut_values(value, values: dotenv.Values, counts: Counter, key: str | None = None):
    """A nested value without learned values, but under keys that say what a record is."""
    if isinstance(value, str):
        if key in _SAYS_WHAT:
            return value
        value, n = values.cut(value)
        counts["dotenv"] += n
        return value
    if isinstance(value, list):
        return [cut_values(x, values, counts) for x in value]
    if isinstance(value, dict):
        return {k: cut_values(v, values, counts, k) for k, v in value.items()}
    return value


class _Found:
    """Takes down where values are in each text of a line; cuts nothing."""

    def __init__(self, values: dotenv.Values):
        self.values, self.n, self.hits = values, 0, []

    def cut(self, text: str) -> tuple[str, int]:
        self.hits += [(self.n, a, b) for a, b in self.values.hits(text)]
        self.n += 1
        return text, 0


class _Told:
    """Cuts what several ``_Found`` took down together, as one automaton of all their values would."""

    def __init__(self, hits: Iterable[tuple[int, int, int]]):
        self.n, self.hits = 0, {}
        for n, a, b in sorted(hits, key=lambda h: (h[1], -h[2])):
            self.hits.setdefault(n, []).append((a, b))

    def cut(self, text: str) -> tuple[str, int]:
        self.n += 1
        return dotenv.cut_at(text, dotenv.apart(self.hits.get(self.n - 1, ())))


def parse(line: str | None):
    """(whether there is anything, what it holds as JSON or None)."""
    line = (line or "").strip()
    if not line:
        return False, None
    try:
        return True, json.loads(line)
    except (ValueError, RecursionError):
        return True, None


_encode = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def dumped(value) -> str:
    text = _encode(value)
    return text if _written_out(text) == text else json.dumps(value, separators=(",", ":"))


def redact_line(line: str, value, roots: Roots, blocks: frozenset[int], output: bool, rules, values: dotenv.Values | None, counts: Counter, cuts: dict[int, tuple[dict, int]] | None = None) -> str:
    """One line that isn't blank."""
    if not isinstance(value, dict):
        counts["unparsed_lines"] += 1
    if value is None:
        text = paths.mask_text(redaction.apply_rules(line.strip(), rules, counts), roots)
        return cut_values(text, values, counts) if values else text
    try:
        same = cuts is not None and not (cuts or blocks or output)
        if isinstance(value, dict):
            value = stripped(value if same else _without_dotenv(value, blocks, output, counts, cuts), counts)
        if not (same and rules is redaction.RULES and redaction.untouched(line)):
            value = redaction.redact_value(value, roots, rules, counts)
        text = dumped(value)
        # Where nothing is escaped, a value that one of its texts holds stands in the line too.
        return dumped(cut_values(value, values, counts)) if values and ("\\" in text or values.within(text)) else text
    except RecursionError:  # nested too deep to be looked through
        counts["oversized"] += 1
        return marker("oversized")


def _with(extra: Iterable[redaction.Rule]) -> tuple[redaction.Rule, ...]:
    """The rules with own ones; without any the rules themselves, which are known by sight."""
    return (*redaction.RULES, *extra) if extra else redaction.RULES


def in_order(lines: Iterable[str | None], rules, most: int | None = None) -> Iterator[tuple[int, str, Counter]]:
    """(place, redacted line, counts by type) of one session's lines in order, but for blank ones; ``most`` values are cut, or all."""
    roots, rooted, tainted, touched = Roots(), False, set(), False
    learned: dict[str, None] = {}
    held = []
    for n, line in enumerate(lines):
        given, record = parse(line)
        if not given:
            continue
        blocks, output, cuts = set(), False, None
        if isinstance(record, dict):
            cwd, typed, written, events, cuts = _facts_and_cuts(record)
            if cwd and not rooted:
                roots, rooted = Roots.of(cwd), True
            if typed is not None:
                touched, cuts = typed, None  # cut as a line of its own
            elif touched and typed_output(record):
                touched, output = False, True
            for k, kind, name, other in events:
                if kind == "taints":
                    tainted.add(name)
                elif name in tainted:
                    if kind == "answers":
                        blocks.add(k)
                    else:
                        tainted.add(other)
            if written or blocks or output:
                learned |= dict.fromkeys([*written, *shown(record, sorted(blocks), output)])
        held.append((n, line, record, roots, frozenset(blocks), output, cuts))
    values = dotenv.Values(list(learned)[:most]) if learned else None
    for n, line, record, r, blocks, output, cuts in held:
        counts: Counter = Counter()
        yield n, redact_line(line, record, r, blocks, output, rules, values, counts, cuts), counts


def redact_session(lines: Iterable[str], extra: Iterable[redaction.Rule] = ()) -> tuple[list[str], Counter]:
    """The redacted lines of one session in order, and counts by type."""
    out, counts = [], Counter()
    for _, line, n in in_order(lines, _with(extra), MOST_LEARNED):
        out.append(line)
        counts.update(n)
    return out, counts


# --- tables ------------------------------------------------------------------------------------
_EVENT = "block int, kind string, id string, other string"
_FACTS = f"session_id string, line_no int, cwd string, typed int, written array<string>, events array<struct<{_EVENT.replace(' int', ': int').replace(' string', ': string')}>>"
_EVENT_TYPE = pa.struct([("block", pa.int32()), ("kind", pa.string()), ("id", pa.string()), ("other", pa.string())])


def facts(lines: DataFrame) -> DataFrame:
    """A row for each line that tells anything: folder, typed (0, 1: a command, 2: an output), values written, events."""

    def run(batches):
        for batch in batches:
            out = []
            for session, line_no, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, record = parse(line)
                if not isinstance(record, dict):
                    continue
                cwd, typed, written, events = facts_of(record)
                kind = int(typed) if typed is not None else 2 if typed_output(record) else None
                if cwd or kind is not None or written or events:
                    out.append((session, line_no, cwd, kind, written, [dict(zip(("block", "kind", "id", "other"), e, strict=True)) for e in events]))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(_EVENT_TYPE))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["session_id", "line_no", "cwd", "typed", "written", "events"])

    return lines.select("session_id", F.col("line_no").cast("int"), "line").mapInArrow(run, _FACTS)


_ID_TYPE = "session_id string, id string, since struct<line_no:int,block:int>"
_PLACE_TYPE = pa.struct([("line_no", pa.int32()), ("block", pa.int32())])


def taint(known: dict[str, tuple], edges: Iterable[tuple[str, str, tuple]]) -> dict[str, tuple]:
    """Ids of one session with the place from which they are tainted; ``edges`` are (id, other, at), ``known`` those that are by themselves.

    A place spreads only to later ones, so one walk over the edges by place tells all.
    """
    known = dict(known)
    ordered = sorted(edges, key=lambda e: e[2])
    k = 0
    while k < len(ordered):
        end = k
        while end < len(ordered) and ordered[end][2] == ordered[k][2]:
            end += 1
        # Edges of one place don't follow each other.
        reached = [other for name, other, at in ordered[k:end] if name in known and known[name] < at]
        for other in reached:
            known[other] = min(known.get(other, ordered[k][2]), ordered[k][2])
        k = end
    return known


def _taint_in_groups(known: DataFrame, edges: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        starts, links = {}, []
        for name, other, at in zip(*(table.column(c).to_pylist() for c in ("id", "other", "at")), strict=True):
            at = (at["line_no"], at["block"])
            if other is None:
                starts[name] = at
            else:
                links.append((name, other, at))
        found = taint(starts, links)
        places = pa.array([{"line_no": n, "block": k} for n, k in found.values()], _PLACE_TYPE)
        session = pa.array([table.column("session_id")[0].as_py()] * len(found), pa.string())
        return pa.table({"session_id": session, "id": pa.array(list(found), pa.string()), "since": places})

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    rows = known.select("session_id", "id", F.lit(None).cast("string").alias("other"), F.col("since").alias("at")).unionByName(edges)
    return rows.groupBy("session_id").applyInArrow(run, _ID_TYPE)


def tainted_ids(events: DataFrame, most: int | None = None) -> DataFrame:
    """(session_id, id, since) of calls and tasks that show a dotenv file, from the place (line, block) where that is known.

    ``events`` has session_id, at (line, block), kind, id and other. Only sessions that have both a tainted call and tasks are looked through: those of up to
    ``most`` such ids and tasks, about 100 bytes each, as a group each in one walk, longer ones all together in rounds of joins; both give the same.
    """
    most = MOST_IN_GROUP if most is None else most
    known = keep(events.where("kind = 'taints'").groupBy("session_id", "id").agg(F.min("at").alias("since")), "tainted")
    edges = events.where("kind IN ('starts', 'follows')").select("session_id", "id", "other", "at").where("session_id IS NOT NULL")
    edges = keep(edges.join(known.select("session_id").distinct(), "session_id", "left_semi"), "task-events")
    counts = edges.select("session_id").unionByName(known.select("session_id")).groupBy("session_id").count()
    long = keep(counts.where(F.col("count") > most).select("session_id"), "long-sessions")
    with_tasks = edges.select("session_id").distinct()
    alone = known.join(with_tasks, "session_id", "left_anti")
    linked = known.join(with_tasks, "session_id", "left_semi")
    if long.isEmpty():
        return keep(alone.unionByName(_taint_in_groups(linked, edges)), "tainted")
    of = lambda df, how: df.join(long, "session_id", how)
    grouped = _taint_in_groups(of(linked, "left_anti"), of(edges, "left_anti"))
    rounds = _taint_by_rounds(keep(of(linked, "left_semi"), "tainted"), keep(of(edges, "left_semi"), "task-events"))
    return keep(alone.unionByName(grouped).unionByName(rounds), "tainted")


def _taint_by_rounds(known: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by joins of the newly tainted ids with the tasks, as many as the longest chain has links."""
    fresh = known
    while True:
        reached = fresh.join(edges, ["session_id", "id"]).where("at > since").groupBy("session_id", F.col("other").alias("id")).agg(F.min("at").alias("since"))
        before = known.select("session_id", "id", F.col("since").alias("_before"))
        fresh = keep(reached.join(before, ["session_id", "id"], "left").where("_before IS NULL OR since < _before").drop("_before"), "tainted")
        if fresh.isEmpty():
            return known
        known = keep(known.union(fresh).groupBy("session_id", "id").agg(F.min("since").alias("since")), "tainted")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def marks(facts_: DataFrame) -> DataFrame:
    """(session_id, line_no, blocks, output): the lines whose results or typed output show a dotenv file."""
    at = F.struct("line_no", F.col("e.block").alias("block"))
    events = keep(facts_.select("session_id", "line_no", F.explode("events").alias("e")).select("session_id", "line_no", at.alias("at"), "e.*"), "events")
    known = tainted_ids(events)
    answers = events.where("kind = 'answers'").join(_small(known, BROADCAST_ROWS), ["session_id", "id"]).where("at > since")
    results = answers.groupBy("session_id", "line_no").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    # Only what a person typed is in this window.
    typed = facts_.where("typed IS NOT NULL").withColumn("_last", F.lag("typed").over(Window.partitionBy("session_id").orderBy("line_no")))
    outputs = typed.where("typed = 2 AND _last = 1").select("session_id", "line_no", F.array().cast("array<int>").alias("blocks"), F.lit(True).alias("output"))
    return results.withColumn("output", F.lit(False)).unionByName(outputs)


def learned_values(lines: DataFrame, facts_: DataFrame, marked: DataFrame) -> DataFrame:
    """(session_id, value): the values that each session's dotenv files showed, each once."""

    def run(batches):
        for batch in batches:
            out = []
            for session, line_no, line, blocks, output in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, record = parse(line)
                out += [(session, line_no, k, v) for k, v in enumerate(shown(record, blocks, output))]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["session_id", "line_no", "n", "value"])

    rows = lines.join(_small(marked, BROADCAST_ROWS), ["session_id", "line_no"]).select("session_id", "line_no", "line", "blocks", "output")
    seen = rows.mapInArrow(run, "session_id string, line_no int, n int, value string").select("session_id", F.struct("line_no", F.lit(1).alias("how"), "n").alias("at"), "value")
    written = facts_.where("size(written) > 0").select("session_id", "line_no", F.posexplode("written").alias("n", "value")).select("session_id", F.struct("line_no", F.lit(0).alias("how"), "n").alias("at"), "value")
    both = seen.union(written)
    if MOST_LEARNED is None:
        return both.select("session_id", "value").distinct()
    first = both.groupBy("session_id", "value").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("at", "value"))
    return first.withColumn("_rank", rank).where(F.col("_rank") <= MOST_LEARNED).select("session_id", "value")


_OUT = "session_id string, line_no int, line string, counts map<string,int>"
_OUT_TYPES = (pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.int32()))


def _out(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT_TYPES, strict=True)], names=["session_id", "line_no", "line", "counts"])


def _done(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*_OUT_TYPES, pa.bool_()), strict=True)], names=["session_id", "line_no", "line", "counts", "done"])


def _sent(values: DataFrame):
    """Values by session, sent to all tasks; the caller bounds them."""
    by_session = {r.session_id: r["values"] for r in values.groupBy("session_id").agg(F.collect_list("value").alias("values")).collect()}
    return values.sparkSession.sparkContext.broadcast(by_session)


def _redact(rows: DataFrame, values: DataFrame, extra: list[redaction.Rule]) -> DataFrame:
    """Rows (session_id, line_no, line, cwd, blocks, output) redacted, with the sessions' values sent to all tasks."""
    sent = _sent(values)

    def run(batches):
        rules, own = _with(extra), {}
        folders: dict[str | None, Roots] = {}
        for batch in batches:
            out = []
            for session, line_no, line, cwd, blocks, output in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                given, record = parse(line)
                if not given:
                    continue
                if session not in own:
                    if len(own) > 64:
                        own.clear()
                    own[session] = dotenv.Values(sent.value[session]) if session in sent.value else None
                if cwd not in folders:
                    if len(folders) > 1000:
                        folders.clear()
                    folders[cwd] = Roots.of(cwd) if cwd else Roots()
                counts: Counter = Counter()
                text = redact_line(line, record, folders[cwd], frozenset(blocks or ()), bool(output), rules, own[session], counts)
                out.append((session, line_no, text, [(k, n) for k, n in counts.items() if n]))
            yield _out(out)

    return rows.mapInArrow(run, _OUT)


def _is_json(text: str, value) -> bool:
    """Whether a line was redacted as JSON, and wasn't nested too deep for that."""
    return value is not None and text != marker("oversized")


def _cut_in_parts(rows: DataFrame, values: DataFrame, extra: list[redaction.Rule], parts: int) -> DataFrame:
    """Rows of sessions with more values than one automaton holds: redacted first, then looked through for each part of the values, then cut."""

    def first(batches):
        rules = _with(extra)
        for batch in batches:
            out = []
            for session, line_no, line, cwd, blocks, output in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                given, record = parse(line)
                if given:
                    counts: Counter = Counter()
                    text = redact_line(line, record, Roots.of(cwd) if cwd else Roots(), frozenset(blocks or ()), bool(output), rules, None, counts)
                    out.append((session, line_no, text, [(k, n) for k, n in counts.items() if n], _is_json(text, record), record is None))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*_OUT_TYPES, pa.bool_(), pa.bool_()), strict=True)], names=["session_id", "line_no", "line", "counts", "json", "text"])

    base = keep(rows.mapInArrow(first, f"{_OUT}, json boolean, text boolean").withColumn("row", F.monotonically_increasing_id()), "redacted-lines")
    values = keep(values.withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int")), "parts", by="_part")
    found = None
    for k in range(parts):
        sent = _sent(values.where(F.col("_part") == k))

        def look(batches, sent=sent):
            own: dict[str, dotenv.Values] = {}
            for batch in batches:
                out = []
                for row, session, line, json_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if session not in sent.value:
                        continue
                    if session not in own:
                        own = {session: dotenv.Values(sent.value[session])}
                    seen = _Found(own[session])
                    try:
                        cut_values(json.loads(line) if json_ else line, seen, Counter())
                    except RecursionError:  # goes whole below
                        continue
                    out += [(row, *hit) for hit in seen.hits]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["row", "n", "a", "b"])

        one = base.where("json OR text").select("row", "session_id", "line", "json").mapInArrow(look, "row long, n int, a int, b int")
        found = one if found is None else found.union(one)
    hits = found.groupBy("row").agg(F.collect_list(F.struct("n", "a", "b")).alias("hits"))

    def cut(batches):
        for batch in batches:
            out = []
            for session, line_no, line, counts, json_, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hits or json_:
                    n, told = Counter(dict(counts)), _Told((h["n"], h["a"], h["b"]) for h in hits or ())
                    try:
                        line = dumped(cut_values(json.loads(line), told, n)) if json_ else cut_values(line, told, n)
                    except RecursionError:
                        n["oversized"] += 1
                        line = marker("oversized")
                    counts = [(k, x) for k, x in n.items() if x]
                out.append((session, line_no, line, counts))
            yield _out(out)

    return base.join(hits, "row", "left").select("session_id", "line_no", "line", "counts", "json", "hits").mapInArrow(cut, _OUT)


def redacted(lines: DataFrame, extra_patterns: list[str] | None = None, portion: int = BROADCAST_BYTES, at_once: int = AUTOMATON_CHARS, held: int = HELD_CHARS) -> DataFrame:
    """(session_id, line_no, line, counts) of lines (session_id, line_no, line): all but blank ones, redacted, with what was replaced in each by type."""
    extra, invalid = redaction.compile_extra(extra_patterns or [])
    if invalid:
        raise ValueError(f"patterns that don't compile: {invalid}")
    # The lines are read once, and later steps must see the same ones.
    lines = lines.select("session_id", F.col("line_no").cast("int").alias("line_no"), "line")
    first = keep(_by_sessions(lines, extra, held), "redacted")
    left = first.where("NOT done").select("session_id", "line_no", "line")
    done = first.where("done").select("session_id", "line_no", "line", "counts")
    return done if left.isEmpty() else done.union(_by_tables(left, extra, portion, at_once))


def _by_sessions(lines: DataFrame, extra: list[redaction.Rule], held: int) -> DataFrame:
    """Lines redacted a session at a time, ``done``; those of sessions of more than ``held`` characters, of none, and of those whose lines share a number come back as they were."""
    most = MOST_LEARNED

    def run(batches):
        # Only the own patterns are sent, so that the rules are those of this process and known by sight.
        rules, out, chars = _with(extra), [], 0
        session, places, texts, size, whole = None, [], [], 0, False

        def finished():
            return [(session, places[n], text, [(k, x) for k, x in counts.items() if x], True) for n, text, counts in in_order(texts, rules, most)]

        for batch in batches:
            for s, place, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != session:
                    out += finished() if whole else []
                    session, places, texts, size, whole = s, [], [], 0, True
                if whole and (size > held or place is None or (places and place <= places[-1])):
                    out += [(session, n, text, None, False) for n, text in zip(places, texts, strict=True)]
                    places, texts, whole = [], [], False
                if whole:
                    places.append(place)
                    texts.append(line)
                    size += len(line or "")
                else:
                    out.append((s, place, line, None, False))
                chars += len(line or "")
                if len(out) >= 10_000 or chars > 4 * HELD_CHARS:
                    yield _done(out)
                    out, chars = [], 0
        yield _done(out + (finished() if whole else []))

    # Lines of no session are dealt out; all others of a session meet.
    one = spread(lines, "session_id", F.when(F.col("session_id").isNull(), F.xxhash64("line_no", "line")))
    return one.sortWithinPartitions("session_id", "line_no").mapInArrow(run, f"{_OUT}, done boolean")


def _by_tables(lines: DataFrame, extra: list[redaction.Rule], portion: int, at_once: int) -> DataFrame:
    """The same of written lines of sessions of any length."""
    told = keep(facts(lines), "facts")
    marked = keep(marks(told), "marks")
    values = keep(learned_values(lines, told, marked), "values")
    roots = keep(told.where("cwd IS NOT NULL").groupBy("session_id").agg(F.min(F.struct("line_no", "cwd")).alias("root")), "roots")
    rows = lines.join(_small(roots, BROADCAST_ROWS), "session_id", "left").join(_small(marked, BROADCAST_ROWS), ["session_id", "line_no"], "left")
    # Before the first line that names a folder there is none.
    rows = rows.select("session_id", "line_no", "line", F.when(F.col("line_no") >= F.col("root.line_no"), F.col("root.cwd")).alias("cwd"), "blocks", "output")
    many = values.groupBy(F.col("session_id").alias("_s")).agg(F.sum(F.length("value")).alias("chars")).where(F.col("chars") > at_once)
    many = keep(many, "many-values")
    chars = many.agg(F.sum("chars")).first()[0]
    if not chars:
        return _in_portions(rows, values, extra, portion)
    of = lambda df, how: df.join(_small(many.select("_s"), BROADCAST_ROWS), F.col("session_id").eqNullSafe(F.col("_s")), how)
    whole = _cut_in_parts(of(rows, "left_semi"), of(values, "left_semi"), extra, -(-chars // at_once))
    return whole.union(_in_portions(of(rows, "left_anti"), of(values, "left_anti"), extra, portion))


def _in_portions(rows: DataFrame, values: DataFrame, extra: list[redaction.Rule], portion: int) -> DataFrame:
    size = values.agg(F.sum(F.octet_length("value") + F.octet_length("session_id") + F.lit(100))).first()[0] or 0
    portions = -(-size // portion)
    if portions <= 1:
        return _redact(rows, values, extra)
    number = F.pmod(F.xxhash64("session_id"), F.lit(portions)).cast("int")
    rows = keep(rows.withColumn("_portion", number), "portions", by="_portion")
    values = values.withColumn("_portion", number)
    out = None
    for k in range(portions):
        one = _redact(rows.where(F.col("_portion") == k).drop("_portion"), values.where(F.col("_portion") == k).drop("_portion"), extra)
        out = one if out is None else out.union(one)
    return out


def summary(lines: DataFrame) -> DataFrame:
    """(type, n) over all sessions."""
    return lines.select(F.explode("counts").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("n"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Redacted lines as text, a folder a session (``session_id=...``). A long session is several files, whose names sort as its lines do."""
    ordered = lines.select("session_id", "line_no", "line").repartitionByRange("session_id", "line_no").sortWithinPartitions("session_id", "line_no")
    ordered.select("session_id", "line").write.partitionBy("session_id").text(path)
