"""Other log formats, line by line, into canonical records.

A format is a generator over the parsed lines of one stream; ``canonical`` runs the right one for
each file as an Arrow group (a file's lines in order). Streams of sub-agents are normalised like
any other and merged afterwards with ``merge_streams``, so no task holds more than one stream. An
unknown shape gives no record rather than a wrong one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shell
from ..functions.patch import literal, parse_patch, snippet_calls

OUT = "path string, seq int, at long, line string, spawned string, spawned_by string"
_SHELLS = ("exec_command", "shell", "shell_command", "local_shell_call")
_HARNESS_TEXT = re.compile(r"\s*(?:<environment_context>|<user_instructions>|<recommended_plugins>|# AGENTS\.md instructions for )")
_CONTROL_ROLES = ("_system_prompt", "_usage", "_checkpoint")


def objects(lines: Iterable[str]) -> Iterator[dict]:
    """JSON objects of the lines; a half-written last line is skipped like any bad one."""
    for line in lines:
        try:
            value = json.loads(line) if line.strip() else None
        except ValueError:
            continue
        if isinstance(value, dict):
            yield value


def said(content) -> str:
    """Text of a string or of an array's strings and text parts."""
    if isinstance(content, str):
        return content
    parts = content if isinstance(content, list) else []
    texts = [p if isinstance(p, str) else p.get("text") for p in parts if isinstance(p, (str, dict))]
    return "\n".join(t for t in texts if isinstance(t, str))


def _obj(value) -> dict:
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return {}
    return value if isinstance(value, dict) else {}


def iso(ms: float | None) -> str | None:
    if ms is None:
        return None
    try:
        return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{int(ms) % 1000:03d}Z"
    except (ValueError, OverflowError, OSError):
        return None


def millis(time, seconds: bool = False) -> float | None:
    """Epoch milliseconds; small numbers are seconds."""
    if not isinstance(time, (int, float)) or isinstance(time, bool):
        return None
    return time * 1000 if seconds or time < 1e11 else time


@dataclass
class Stream:
    """What a stream's records share, and the chain of their parents."""

    prefix: str
    session_id: str | None = None
    cwd: str | None = None
    version: str | None = None
    agent_id: str | None = None
    call: str | None = None
    model: str | None = None
    parent: str | None = None
    emitted: int = 0
    calls: dict = field(default_factory=dict)

    def record(self, kind: str, timestamp: str | None, content, extra: dict | None = None) -> dict:
        message = {"role": kind, "content": content}
        if self.model and kind == "assistant":
            message["model"] = self.model
        uuid = f"{self.prefix}-{self.emitted}"
        out = {
            "type": kind, "timestamp": timestamp, "message": message, **(extra or {}), "uuid": uuid, "parentUuid": self.parent, "sessionId": self.session_id,
            "cwd": self.cwd, "version": self.version, "isSidechain": self.agent_id is not None, "agentId": self.agent_id, "parentToolUseID": self.call,
        }
        self.parent, self.emitted = uuid, self.emitted + 1
        return {k: v for k, v in out.items() if v is not None or k == "parentUuid"}

    def use(self, timestamp: str | None, call_id: str, name: str, given: dict) -> dict:
        self.calls[call_id] = (name, given)
        return self.record("assistant", timestamp, [{"type": "tool_use", "id": call_id, "name": name, "input": given}])

    def result(self, timestamp: str | None, call_id: str, text: str, failed: bool, detail: dict) -> dict:
        block = {"type": "tool_result", "tool_use_id": call_id, "content": text, **({"is_error": True} if failed else {})}
        return self.record("user", timestamp, [block], {"toolUseResult": detail})

    def read_detail(self, call_id: str, output: str, note: str, failed: bool) -> dict:
        """A result's detail: the file, where a read covered all of it, else the output."""
        name, given = self.calls.get(call_id, ("", {}))
        content = whole_file(output, note) if name == "Read" and not failed and isinstance(given.get("file_path"), str) else None
        if content is None:
            return {"stdout": output}
        n = content.count("\n") + 1
        return {"type": "text", "file": {"filePath": given["file_path"], "content": content, "numLines": n, "startLine": 1, "totalLines": n}}


def whole_file(output: str, note: str) -> str | None:
    """A file's content out of a numbered read, only if the read covered all of it unaltered."""
    read = re.match(r"(\d+) lines read from file starting from line 1\. Total lines in file: (\d+)\.", note)
    altered = r"truncated|Max \d+ (?:lines|bytes) reached|Character limit reached|fragment|carriage-return|Lossy|Detected file encoding"
    if not read or read.group(1) != read.group(2) or re.search(altered, note):
        return None
    lines = re.split(r"(?<=\n)", output)
    numbers = [re.match(r" *(\d+)\t", x) for x in lines]
    if len(lines) != int(read.group(1)) or any(m is None or int(m.group(1)) != k + 1 for k, m in enumerate(numbers)):
        return None
    return "".join(x[m.end() :] for x, m in zip(lines, numbers, strict=True))


def canonical_tool(name: str, given: dict) -> tuple[str, dict]:
    """Names and arguments of format C's tools in canonical ones."""
    by_path = isinstance(given.get("path"), str) and "file_path" not in given
    rest = {k: v for k, v in given.items() if k != "path"}
    path = {"file_path": given["path"]} if "path" in given else {}
    step = lambda e: {a: e[b] for a, b in (("old_string", "old"), ("new_string", "new"), ("replace_all", "replace_all")) if b in e}
    if name in ("ReadFile", "ReadMediaFile") or (name == "Read" and by_path):
        renamed = {"line_offset": "offset", "n_lines": "limit"}
        return "Read", {**path, **{renamed.get(k, k): v for k, v in rest.items()}}
    if name == "WriteFile" or (name == "Write" and by_path):
        mode = rest.pop("mode", None)
        if mode == "append":
            return "Edit", {**path, "new_string": rest.pop("content", None), **rest}
        return "Write", {**path, **rest}
    if name == "StrReplaceFile":
        edit = rest.pop("edit", None)
        if isinstance(edit, list):
            return "MultiEdit", {**path, "edits": [step(e) for e in edit if isinstance(e, dict)], **rest}
        return "Edit", {**path, **(step(edit) if isinstance(edit, dict) else {}), **rest}
    if name == "Glob" and "directory" in given:
        return "Glob", {**{k: v for k, v in given.items() if k != "directory"}, "path": given["directory"]}
    plain = {"Shell": "Bash", "SearchWeb": "WebSearch", "FetchURL": "WebFetch", "SetTodoList": "TodoWrite", "TodoList": "TodoWrite", "Task": "Agent"}
    if name in plain:
        return plain[name], given
    if by_path and name in ("Edit", "MultiEdit", "NotebookEdit"):
        return name, {**rest, **path}
    return name, given


def format_b(lines: Iterable[str], session_id: str | None = None) -> Iterator[dict]:
    """Rollouts: session_meta and turn_context are carried forward, response items become records."""
    s = Stream("b", session_id)
    scripts: set[str] = set()
    cells: dict[str, str] = {}  # of running cells and shells: the call that started them
    shells: dict[str, str] = {}
    polls: dict[str, str] = {}
    for line in objects(lines):
        at, p = line.get("timestamp") or None, line.get("payload")
        if not isinstance(p, dict):
            continue
        if line.get("type") == "session_meta":
            s.session_id = s.session_id or p.get("session_id") or p.get("id")
            s.cwd, s.version = s.cwd or p.get("cwd"), s.version or p.get("cli_version")
            continue
        if line.get("type") == "turn_context":
            s.model = p.get("model") or s.model
        if line.get("type") != "response_item":
            continue
        kind, call_id = p.get("type"), p.get("call_id") or p.get("id")
        if kind == "message" and p.get("role") in ("user", "assistant"):
            content = p.get("content")
            if p["role"] == "user":
                parts = content if isinstance(content, list) else [content]
                content = [x for x in parts if not _HARNESS_TEXT.match(said([x]))]
            if text := said(content):
                yield s.record(p["role"], at, [{"type": "text", "text": text}])
        elif kind == "reasoning":
            if text := "\n".join(x for x in (said(p.get("summary")), said(p.get("content"))) if x):
                yield s.record("assistant", at, [{"type": "thinking", "thinking": text}])
        elif kind in ("function_call", "custom_tool_call", "local_shell_call") and call_id:
            name = p.get("name") or ("local_shell_call" if kind == "local_shell_call" else None)
            script = p.get("input") if isinstance(p.get("input"), str) else ""
            started = cells.get(str(_obj(p.get("arguments")).get("cell_id"))) if name == "wait" else shells.get(_polled(script) or "") if name == "exec" else None
            if started:
                polls[call_id] = started
                continue
            if name == "exec":
                scripts.add(call_id)
            if name:
                uses = list(_uses_b(name, p, call_id, script))
                for use_id, tool, given in uses:
                    s.calls[use_id] = (tool, given)
                if uses:
                    yield s.record("assistant", at, [{"type": "tool_use", "id": i, "name": t, "input": g} for i, t, g in uses])
        elif kind in ("function_call_output", "custom_tool_call_output") and p.get("call_id"):
            text = said(p.get("output"))
            if call_id in scripts:
                if cell := re.match(r"Script running with cell ID (\S+)", text):
                    cells[cell.group(1)] = call_id
                for number in re.findall(r'"session_id"\s*:\s*(\d+)', text):
                    shells.setdefault(number, call_id)
            exited = re.search(r"Process exited with code (\d+)", text)
            codes = [exited.group(1)] if exited else re.findall(r'"exit_code"\s*:\s*(-?\d+)', text)
            yield s.result(at, polls.get(call_id, call_id), text, any(c != "0" for c in codes), {"stdout": text})


def _polled(script: str) -> str | None:
    """The shell that a snippet only reads from."""
    if re.findall(r"tools\.([A-Za-z0-9_]+)\s*\(", script) != ["write_stdin"] or not re.search(r'\bchars"?\s*:\s*""', script):
        return None
    found = re.search(r'\bsession_id"?\s*:\s*(\d+)', script)
    return found.group(1) if found else None


def _uses_b(name: str, p: dict, call_id: str, script: str) -> Iterator[tuple[str, str, dict]]:
    given = _obj(p.get("arguments") or p.get("input"))
    if name in _SHELLS:
        command = given.get("cmd") or given.get("command") or (p.get("action") or {}).get("command")
        if isinstance(command, list):
            command = shell.argv_command([x for x in command if isinstance(x, str)])
        if isinstance(command, str) and command:
            yield call_id, "Bash", {"command": command}
            return
    if name == "apply_patch":
        edits = parse_patch(script or str(given.get("input") or ""))
        yield from ((call_id if k == 0 else f"{call_id}#{k}", e["name"], e["input"]) for k, e in enumerate(edits))
        if edits:
            return
    if name == "exec":
        found: list[tuple[str, dict]] = []
        opaque = False
        for call in snippet_calls(script):
            command = call["input"].get("cmd")
            if call["name"] == "exec_command" and command:
                found.append(("Bash", {"command": command}))
            elif call["name"] == "apply_patch" and call["text"]:
                found += [(e["name"], e["input"]) for e in parse_patch(call["text"])]
            elif call["name"] in ("exec_command", "apply_patch"):
                opaque = True
        if opaque or not found:
            found.append(("exec", {"script": script}))
        # The result goes to the first command, if there is one.
        owner = next((k for k, (tool, _) in enumerate(found) if tool == "Bash"), 0)
        yield from ((call_id if k == owner else f"{call_id}#{k}", tool, args) for k, (tool, args) in enumerate(found))
        return
    yield call_id, name, given


def _turn_signature(line: dict) -> str:
    tools = ",".join(f"{n}({json.dumps(g, sort_keys=True)})" for _, n, g in _uses_c(line))
    return f"{line.get('role')}|{re.sub(r'\s+', ' ', said(line.get('content')).strip())}|{tools}"


def _uses_c(line: dict) -> Iterator[tuple[str, str, dict]]:
    content = line.get("content") if isinstance(line.get("content"), list) else []
    raw = line["tool_calls"] if isinstance(line.get("tool_calls"), list) else [x for x in content if isinstance(x, dict) and x.get("type") in ("tool_call", "tool_use")]
    for call in raw:
        f = call.get("function") if isinstance(call, dict) and isinstance(call.get("function"), dict) else call
        call_id = isinstance(call, dict) and (call.get("id") or call.get("tool_call_id"))
        if call_id and isinstance(f.get("name"), str):
            yield call_id, *canonical_tool(f["name"], _obj(f.get("arguments") or f.get("input") or call.get("input")))


def format_c_context(lines: Iterable[str], session_id: str | None = None, events: Iterable[str] = ()) -> Iterator[dict]:
    """Conversation files. Turns that only the event log has were rewound: they hang off the first checkpoint as a branch."""
    s, kept = Stream("c", session_id), list(objects(lines))
    own = {_turn_signature(x) for x in kept if x.get("role") not in _CONTROL_ROLES}
    lost = []
    for e in objects(events):
        found = next((x for x in (e, e.get("message"), e.get("data"), e.get("payload")) if isinstance(x, dict) and isinstance(x.get("role"), str) and x["role"] not in _CONTROL_ROLES), None)
        if found and _turn_signature(found) not in own:
            lost.append(found)
    fork = next((k for k, x in enumerate(kept) if x.get("role") == "_checkpoint" and k < len(kept) - 1), -1)
    for k, line in enumerate(kept):
        if k == fork:
            tail = s.parent
            for x in lost:
                yield from _turn_c(s, x)
            s.parent = tail
        elif line.get("role") not in _CONTROL_ROLES:
            yield from _turn_c(s, line)


def _turn_c(s: Stream, line: dict) -> Iterator[dict]:
    at, role = line.get("timestamp") or line.get("created_at"), line.get("role")
    text = said(line.get("content"))
    if role == "tool" and line.get("tool_call_id"):
        status = re.match(r"<system>([\s\S]*?)</system>", text)
        output = re.sub(r"^\n", "", text[status.end() :]) if status else text
        failed = text.startswith("<system>ERROR:")
        yield s.result(at, line["tool_call_id"], text, failed, s.read_detail(line["tool_call_id"], output, status.group(1) if status else "", failed or not status))
    elif role == "assistant":
        direct = line.get("reasoning_content") or line.get("reasoning")
        parts = line["content"] if isinstance(line.get("content"), list) else []
        thoughts = [direct] if direct else [next((x[k] for k in ("think", "thinking", "text", "reasoning") if isinstance(x.get(k), str)), "") for x in parts if isinstance(x, dict) and x.get("type") in ("think", "thinking", "reasoning")]
        blocks = [{"type": "thinking", "thinking": x} for x in thoughts] + ([{"type": "text", "text": text}] if text else [])
        for call_id, name, given in _uses_c(line):
            s.calls[call_id] = (name, given)
            blocks.append({"type": "tool_use", "id": call_id, "name": name, "input": given})
        if blocks:
            yield s.record("assistant", at, blocks)
    elif role == "user" and text:
        yield s.record("user", at, [{"type": "text", "text": text}])


def is_turn(message: dict) -> bool:
    """Whether a user message is a turn, not something that the client put in."""
    origin = message.get("origin") if isinstance(message.get("origin"), dict) else {}
    kind = origin.get("kind")
    if kind == "system_trigger":
        return origin.get("name") in ("subagent", "goal_continuation")
    if kind in ("skill_activation", "plugin_command"):
        return origin.get("trigger") == "user-slash"
    return kind not in ("injection", "retry", "compaction_summary", "hook_result")


def format_c_events(lines: Iterable[str], session_id: str | None = None, agent_id: str | None = None, copied_until: float | None = None) -> Iterator[dict]:
    """Event logs. A spawned sub-agent is reported as ``_spawned``; its own log is a stream of its own."""
    s, at = Stream(f"c-{agent_id}" if agent_id else "c", session_id, agent_id=agent_id), float("-inf")
    for e in objects(lines):
        at = millis(e.get("time")) or at
        if copied_until is not None and at <= copied_until:
            continue
        stamp, kind, inner, message = iso(millis(e.get("time"))), e.get("type"), e.get("event"), e.get("message")
        if kind == "llm.request":
            s.model = e.get("model") or s.model
        elif kind == "subagent.spawned" and e.get("subagentId"):
            yield {"_spawned": e["subagentId"], "_by": e.get("parentToolCallId"), "timestamp": stamp}
        elif kind == "context.append_message" and isinstance(message, dict) and message.get("role") in ("user", "assistant"):
            content = message.get("content")
            texts = [x.get("text") for x in content if isinstance(x, dict) and x.get("type") == "text"] if isinstance(content, list) else [content]
            blocks = [{"type": "text", "text": x} for x in texts if isinstance(x, str) and x]
            if blocks and (message["role"] == "assistant" or is_turn(message)):
                yield s.record(message["role"], stamp, blocks)
        elif kind == "context.append_loop_event" and isinstance(inner, dict):
            part, call_id = inner.get("part"), inner.get("toolCallId")
            if inner.get("type") == "content.part" and isinstance(part, dict):
                if part.get("type") in ("think", "thinking"):
                    if part.get("hidden") is not True:
                        thought = next((part[k] for k in ("think", "thinking") if isinstance(part.get(k), str)), "")
                        yield s.record("assistant", stamp, [{"type": "thinking", "thinking": thought}])
                elif isinstance(part.get("text"), str) and part["text"]:
                    yield s.record("assistant", stamp, [{"type": "text", "text": part["text"]}])
            elif inner.get("type") == "tool.call" and call_id and inner.get("name"):
                yield s.use(stamp, call_id, *canonical_tool(inner["name"], _obj(inner.get("args"))))
            elif inner.get("type") == "tool.result" and call_id:
                r = _obj(inner.get("result"))
                output, note = said(r.get("output")), r.get("note") if isinstance(r.get("note"), str) else ""
                status = re.fullmatch(r"<system>([\s\S]*?)</system>", note)
                status_text = status.group(1) if status else note
                failed = r.get("isError") is True or r.get("error") is not None
                yield s.result(stamp, call_id, output or status_text, failed, s.read_detail(call_id, output, status_text, failed))


def format_c_old_events(lines: Iterable[str], session_id: str | None = None, agent_id: str | None = None) -> Iterator[dict]:
    """Old event logs, in seconds, with sub-agents' events inside the session's own."""
    main, inner_streams = Stream(f"c-log-{agent_id}" if agent_id else "c", session_id, agent_id=agent_id), {}
    for e in objects(lines):
        message = e.get("message")
        if isinstance(message, dict) and isinstance(message.get("type"), str):
            yield from _old_event(main, inner_streams, message, iso(millis(e.get("timestamp"), True)))


def _old_event(s: Stream, inner: dict[str, Stream], message: dict, stamp: str | None) -> Iterator[dict]:
    kind, p = message.get("type"), message.get("payload") if isinstance(message.get("payload"), dict) else {}
    if kind in ("TurnBegin", "SteerInput"):
        if text := said(p.get("user_input")):
            yield s.record("user", stamp, [{"type": "text", "text": text}])
    elif kind == "ContentPart" and p.get("type") == "think":
        yield s.record("assistant", stamp, [{"type": "thinking", "thinking": p.get("think") if isinstance(p.get("think"), str) else ""}])
    elif kind == "ContentPart" and p.get("type") == "text" and p.get("text"):
        yield s.record("assistant", stamp, [{"type": "text", "text": p["text"]}])
    elif kind == "ToolCall" and p.get("id") and _obj(p.get("function")).get("name"):
        f = _obj(p["function"])
        yield s.use(stamp, p["id"], *canonical_tool(f["name"], _obj(f.get("arguments"))))
    elif kind == "ToolResult" and p.get("tool_call_id"):
        v, call_id = _obj(p.get("return_value")), p["tool_call_id"]
        output, note, failed = said(v.get("output")), v.get("message") if isinstance(v.get("message"), str) else "", v.get("is_error") is True
        yield s.result(stamp, call_id, "\n".join(x for x in (note, output) if x), failed, s.read_detail(call_id, output, note, failed))
        agent = re.search(r"(?m)^agent_id: (\S+)$", output)
        if agent and not failed and s.calls.get(call_id, ("",))[0] == "Agent":
            yield {"_spawned": agent.group(1), "_by": call_id, "timestamp": stamp}
    elif kind == "SubagentEvent" and isinstance(p.get("event"), dict):
        call = p.get("parent_tool_call_id") or p.get("task_tool_call_id")
        key = p.get("agent_id") or call or "subagent"
        own = inner.setdefault(key, Stream(f"c-{key}", s.session_id, agent_id=key))
        own.call = call or own.call
        yield from _old_event(own, inner, p["event"], stamp)


FORMATS = {"b": format_b, "c_context": format_c_context, "c_events": format_c_events, "c_old_events": format_c_old_events}


def canonical(lines: DataFrame) -> DataFrame:
    """(path, seq, at, line, spawned, spawned_by) of lines (path, format, session_id, line_no, line).

    Format a passes through without Python; of others one file is one group.
    """
    is_a = F.coalesce(F.col("format") == "a", F.lit(True))
    ms = F.unix_millis(F.try_to_timestamp(F.get_json_object("line", "$.timestamp")))
    none = F.lit(None).cast("string")
    plain = lines.where(is_a).select("path", F.col("line_no").cast("int").alias("seq"), ms.alias("at"), "line", none.alias("spawned"), none.alias("spawned_by"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("line_no")
        path, kind, session = (table.column(c)[0].as_py() for c in ("path", "format", "session_id"))
        found = list(FORMATS[kind](table.column("line").to_pylist(), session))
        times = [x.get("timestamp") for x in found]
        at = [None if x is None else _epoch(x) for x in times]
        return pa.table({
            "path": pa.array([path] * len(found), pa.string()), "seq": pa.array(range(len(found)), pa.int32()), "at": pa.array(at, pa.int64()),
            "line": pa.array([None if "_spawned" in x else json.dumps(x, ensure_ascii=False) for x in found], pa.string()),
            "spawned": pa.array([x.get("_spawned") for x in found], pa.string()), "spawned_by": pa.array([x.get("_by") for x in found], pa.string()),
        })

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    other = lines.where(~is_a).select("path", "format", "session_id", F.col("line_no").cast("int").alias("line_no"), "line")
    return plain.unionByName(other.groupBy("path").applyInArrow(run, OUT))


def _epoch(text) -> int | None:
    try:
        return int(datetime.fromisoformat(str(text).replace("Z", "+00:00")).timestamp() * 1000)
    except ValueError:
        return None


__all__ = ["canonical", "canonical_tool", "format_b", "format_c_context", "format_c_events", "format_c_old_events", "is_turn", "literal", "whole_file"]
