"""Patch envelopes and snippets that call tools, turned into edits and calls."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

_FILE = re.compile(r"\*\*\* (Add|Update|Delete) File: (.+)")
_MOVE = re.compile(r"\*\*\* Move to: (.+)")


@dataclass
class FilePatch:
    path: str
    kind: str  # Add, Update, Delete
    moved_to: str | None = None
    hunks: list[tuple[list[str], list[str]]] = field(default_factory=list)
    added: list[str] = field(default_factory=list)


def parse_patch(patch: str) -> list[dict]:
    """Tool calls (Edit, MultiEdit or Write) of a patch envelope, one per file, hunks without changes left out."""
    files: list[FilePatch] = []
    open_hunk = False
    for line in patch.replace("\r\n", "\n").split("\n"):
        head, move = _FILE.fullmatch(line.rstrip()), _MOVE.fullmatch(line.rstrip())
        if head:
            files.append(FilePatch(head.group(2).strip(), head.group(1)))
            open_hunk = False
        elif not files or line.startswith("*** "):
            if move and files:
                files[-1].moved_to = move.group(1).strip()
        elif files[-1].kind == "Add":
            if line.startswith("+"):
                files[-1].added.append(line[1:])
        elif line.startswith("@@"):
            open_hunk = False
        elif files[-1].kind == "Update" and line[:1] in ("+", "-", " ", ""):
            if not open_hunk:
                files[-1].hunks.append(([], []))
                open_hunk = True
            old, new = files[-1].hunks[-1]
            if line[:1] != "+":
                old.append(line[1:])
            if line[:1] != "-":
                new.append(line[1:])
    return [call for f in files if (call := _call(f)) is not None]


def _call(f: FilePatch) -> dict | None:
    if f.kind == "Add":
        return {"name": "Write", "input": {"file_path": f.path, "content": "".join(x + "\n" for x in f.added)}}
    edits = [{"old_string": "\n".join(a).rstrip("\n"), "new_string": "\n".join(b).rstrip("\n")} for a, b in f.hunks if a != b]
    path = f.moved_to or f.path
    if f.kind == "Delete" or not edits:
        return {"name": "Edit", "input": {"file_path": path}} if f.kind == "Delete" or f.moved_to else None
    if len(edits) == 1:
        return {"name": "Edit", "input": {"file_path": path, **edits[0]}}
    return {"name": "MultiEdit", "input": {"file_path": path, "edits": edits}}


_LITERAL = re.compile(r"\s*(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\$]|\\.)*`|String\.raw`[^`$]*`)")


def literal(text: str) -> str | None:
    """The value of a plain JavaScript string literal at the start of ``text``; None if it isn't one."""
    found = _LITERAL.match(text)
    if not found:
        return None
    body = found.group(1)
    if body.startswith("String.raw"):
        return body[len("String.raw`") : -1]
    inner = re.sub(r"\\([\s\S])", lambda m: {"n": "\\n", "t": "\\t", "r": "\\r", "\\": "\\\\", "\n": ""}.get(m.group(1), "\\" + m.group(1) if m.group(1) in "u\"/bf" else m.group(1)), body[1:-1])
    inner = re.sub(r'(?<!\\)((?:\\\\)*)"', r'\1\\"', inner).replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    try:
        return json.loads(f'"{inner}"')
    except ValueError:
        return None


def snippet_calls(script: str) -> list[dict]:
    """Calls of ``tools.<name>(...)`` in a snippet, with their string arguments where these are literals or constants bound once; others are opaque."""
    bound: dict[str, str | None] = {}
    for m in re.finditer(r"\bconst\s+([A-Za-z_$][\w$]*)\s*=", script):
        bound[m.group(1)] = None if m.group(1) in bound else literal(script[m.end() :])
    found = []
    for m in re.finditer(r"\btools\.([A-Za-z_]\w*)\s*\(\s*", script):
        rest = script[m.end() :]
        whole = literal(rest)
        name = re.match(r"([A-Za-z_$][\w$]*)\s*[,)]", rest)
        if whole is None and name:
            whole = bound.get(name.group(1))
        given: dict[str, str] = {}
        if rest.startswith("{"):
            for k in re.finditer(r"[{,]\s*[\"']?([A-Za-z_]\w*)[\"']?\s*:", rest.split("})", 1)[0] + "}"):
                value = literal(rest[k.end() :])
                word = re.match(r"\s*([A-Za-z_$][\w$]*)\s*[,}]", rest[k.end() :])
                value = bound.get(word.group(1)) if value is None and word else value
                if value is not None:
                    given[k.group(1)] = value
        found.append({"name": m.group(1), "text": whole, "input": given, "opaque": whole is None and not given})
    return found
