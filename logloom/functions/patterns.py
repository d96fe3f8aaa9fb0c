"""Handlers that only log, and patterns of tokens made from the tables of ``fixed``."""

from __future__ import annotations

import re

from . import fixed


def loggers(owners, calls, more: str = "") -> str:
    return rf"(?:(?:{'|'.join(owners)})\.(?:{'|'.join(calls)}){more})"


def token(begins, alphabet: str, least: int, exactly: bool) -> str:
    """The pattern of a token by its beginnings and what follows them."""
    return rf"\b(?:{'|'.join(map(re.escape, begins))})".replace(r"\-", "-") + rf"[{alphabet}]{{{least}{'}' + chr(92) + 'b' if exactly else ',}'}"


_LOGGED_ARGUMENTS = 400
_CATCH = re.compile(r"\bcatch\b")
_OPENED = re.compile(r"\s*(?:\([^)]{0,200}\)\s*)?\{")
_COMMENT = re.compile(r"\s{0,200}//[^\n]{0,400}\n")
_JS_CALL = re.compile(r"\s*(?:this\.)?" + loggers(fixed.JS_LOGGERS, fixed.JS_LOG_CALLS) + r"\(")
_JS_END = re.compile(r"\)\s*;?\s*(?:return(?:\s+(?:" + "|".join(map(re.escape, fixed.EMPTY_RESULTS)) + r"))?\s*;?\s*)?\}")
_EXCEPT = re.compile(r"except\b[^:]{0,200}:[ \t]*(?:#.*)?")
_PY_CALL = re.compile(r"(?:print|(?:self\.)?" + loggers(fixed.PY_LOGGERS, fixed.PY_LOG_CALLS) + r"|warnings\.warn)\(.{0,400}\)[ \t]*")
_PY_RETURN = re.compile(r"return(?:[ \t]+(?:" + "|".join(map(re.escape, fixed.EMPTY_PY_RESULTS)) + r"))?[ \t]*(?:#.*)?")


def _braced_catches(text: str) -> int:
    """Catch blocks that hold a log call and at most an empty return. A quote before ``catch`` on its line says that it is text."""
    found = 0
    for m in _CATCH.finditer(text):
        line = text[max(text.rfind("\n", 0, m.start()) + 1, m.start() - 200) : m.start()]
        opened = None if any(q in line for q in "\"'`") else _OPENED.match(text, m.end())
        if not opened:
            continue
        at = opened.end()
        for _ in range(20):
            comment = _COMMENT.match(text, at)
            if not comment:
                break
            at = comment.end()
        call = _JS_CALL.match(text, at)
        if not call:
            continue
        # The arguments end on their own line, or on a later one that their bracket begins; no semicolon is inside.
        span = text[call.end() : call.end() + 2 * _LOGGED_ARGUMENTS + 2].split(";", 1)[0]
        one_line = span.split("\n", 1)[0]
        over_lines = not one_line.strip()
        ends = [k for k, c in enumerate(span) if c == ")" and (k < len(one_line) or (over_lines and not span[span.rfind("\n", 0, k) + 1 : k].strip()))]
        found += any(_JS_END.match(text, call.end() + k) for k in ends)
    return found


def _indented_catches(text: str) -> int:
    """``except`` lines that are followed, comments aside, by a log call on one line and a return of nothing."""
    lines, found = text.split("\n"), 0
    for k, line in enumerate(lines):
        if not _EXCEPT.fullmatch(line.strip(" \t")):
            continue
        at = k + 1
        while at < len(lines) and lines[at].strip(" \t").startswith("#"):
            at += 1
        found += at + 1 < len(lines) and bool(_PY_CALL.fullmatch(lines[at].lstrip(" \t"))) and bool(_PY_RETURN.fullmatch(lines[at + 1].strip(" \t")))
    return found


def logged_only(text: str) -> tuple[int, int]:
    """Handlers that only log, with braces and by indentation."""
    return (_braced_catches(text) if "catch" in text else 0, _indented_catches(text) if "except" in text else 0)


#: (type, literals of which a text holds one, pattern) of tokens whose shape is enough, in order.
PRIVATE_KEY = ("private_key", ("PRIVATE KEY",), r"-----BEGIN [A-Z0-9 ]{0,64}PRIVATE KEY(?: BLOCK)?-----(?s:.*?)(?:-----END [A-Z0-9 ]{0,64}PRIVATE KEY(?: BLOCK)?-----|\z)")
JWT = ("jwt", ("eyJ",), r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
_SHORT = tuple((kind, begins, token(begins, alphabet, least, exactly) + (r"\b" if begins[0] == "ghp_" else "")) for kind, begins, alphabet, least, exactly in fixed.TOKENS)
_SERVICE = (
    "service_token",
    (*(x for begins, *_ in fixed.SERVICE_TOKENS for x in begins), *(x for x, _ in fixed.SERVICE_SHAPES)),
    "|".join([*(token(*x) for x in fixed.SERVICE_TOKENS), *(x for _, x in fixed.SERVICE_SHAPES)]),
)
TOKENS = (PRIVATE_KEY, JWT, *_SHORT, _SERVICE)
#: The same with a group that stays in front of what goes.
KEYS_BEHIND_IDS = tuple(("service_token", (x,), pattern) for x, pattern in fixed.KEYS_BEHIND_IDS)
