"""Dotenv files in session records: which calls read or write one, what a command writes into it, and which values it taught.

A command is read once into lines of statements, with the here-document that a line opens; each statement is then asked where it
writes. Everything is plain Python on one text and linear in it; ``operators/redact.py`` runs it over tables.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import takewhile

import ahocorasick

from . import fixed, shell
from .paths import marker
from .redaction import GENERATED, is_secret_name

MARK = marker("dotenv")
_BREAKS = re.compile(r"[\s\"'`(){}=,;|&<>]+")


# --- files -------------------------------------------------------------------------------------
def is_dotenv(path) -> bool:
    """``.env``, ``.env.local``, ``prod.env``, ``*.env``; not the object that code reads its environment from."""
    if not isinstance(path, str):
        return False
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name.startswith(".env"):
        return True
    if not name.endswith(".env") or not set(name) <= _FILE_CHARS:
        return False
    return name[:-4].rsplit(".", 1)[-1] not in fixed.ENVIRONMENT_OWNERS


_FILE_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.*?${}-")


def names_one(text: str) -> bool:
    """Whether a word of a text, behind a revision and its colon, is such a file."""
    return ".env" in text and any(is_dotenv(word.rsplit(":", 1)[-1]) for word in _BREAKS.split(text))


def _unquoted(word: str) -> str:
    """A word as a program gets it: without quotes, an escaped blank as a blank."""
    return re.sub(r"\\ |[\"'`]", lambda m: " " if m.group() == "\\ " else "", word)


# --- reading -----------------------------------------------------------------------------------
def _leads(segment: str, programs: Iterable[str], pairs: dict[str, tuple[str, ...]] | None = None, behind: Iterable[str] = ()) -> bool:
    """Whether a segment's first words, behind words that can stand before a command, are one of some programs (or of their subcommands)."""
    run = [x.lower() for x in segment.split(None, 64)]
    first = 0
    for word in run:
        # Brackets and a negation may be glued to what they stand before.
        if behind and (not word.lstrip("!{(") or word.lstrip("!{(") in behind):
            first += 1
            continue
        break
    run = run[first:]
    if not run:
        return False
    program = run[0].lstrip("!{(") if behind else run[0]
    return program in programs or bool(pairs and program in pairs and run[1:] and run[1] in pairs[program])


def reads(command) -> bool:
    """Whether what a command prints may come from a dotenv file: it names one, and isn't one of the commands that print none of it."""
    if not isinstance(command, str) or ".env" not in command:
        return False
    return _short_reads(command) if len(command) <= _SHORT else _reads(command)


def _reads(command: str) -> bool:
    text = shell.without_heredocs(command)
    # What a substitution or xargs finds goes to whatever takes it.
    if any(names_one(m) for m in re.findall(r"\$\([^()]*\)", text)) or (re.search(r"\|\s*xargs\b", text) and names_one(text)):
        return True
    for segment in shell.segments(text):
        quiet = _leads(segment, fixed.DOTENV_SILENT, {"git": fixed.DOTENV_SILENT_GIT}, fixed.DOTENV_LEADING)
        if (not quiet or "`" in segment or "$(" in segment) and names_one(segment):
            return True
    return False


#: Commands up to this length come up again and again; answers for the latest are kept.
_SHORT = 256
_short_reads = functools.lru_cache(4096)(_reads)


def call_names_one(tool, given: dict) -> bool:
    """Whether a call that is no shell works on a dotenv file, by the arguments that say on what, or by code that it is given."""
    if isinstance(given.get("glob"), str) and ".env" in given["glob"]:
        return True
    if reads(given.get("code")) or reads(given.get("cmd")) or (tool != "Workflow" and reads(given.get("script"))):
        return True
    return any(is_dotenv(x) for k in fixed.FILE_ARGUMENTS if k in given for x in (given[k] if isinstance(given[k], list) else [given[k]]))


def tasks_of(given: dict) -> list[str]:
    """Background tasks that a call asks for, stops, or whose output file it reads."""
    found = [given.get(k) for k in ("task_id", "shell_id", "bash_id")]
    for text in (given.get("file_path"), given.get("command")):
        if isinstance(text, str) and ".output" in text:
            found += re.findall(r"(?<![\w-])([\w-]+)\.output\b", text, re.A)
    return [x for x in found if isinstance(x, str)]


# --- writing -----------------------------------------------------------------------------------
def _word_at(text: str, at: int) -> str:
    """The shell word that begins at a place."""
    end = at
    while end < len(text):
        c = text[end]
        if c in "\"'":
            close = text.find(c, end + 1)
            if close < 0:
                break
            end = close + 1
        elif c == "\\" and end + 1 < len(text) and text[end + 1] != "\n":
            end += 2
        elif c in " \t\r\n\f\v;&|<>\\":
            break
        else:
            end += 1
    return text[at:end]


def _redirected(segment: str, quotes_are_text: bool) -> Iterator[str]:
    """Targets of ``>``. In what is only text to its command, quotes and escapes are passed over; elsewhere a shell may run what they hold."""
    at = 0
    while at < len(segment):
        c = segment[at]
        if quotes_are_text and c == "\\":
            at += 2
            continue
        if quotes_are_text and c in "\"'":
            at += 1
            while at < len(segment) and segment[at] != c:
                at += 2 if c == '"' and segment[at] == "\\" else 1
            at += 1
            continue
        at += 1
        if c == ">":
            while at < len(segment) and segment[at].isspace():
                at += 1
            word = _word_at(segment, at)
            if word:
                yield _unquoted(word)
                at += len(word)


_CALL = re.compile(r"([A-Za-z_][\w.]*)\(\s{0,8}\\?[\"'`]([^\"'`\\\n]{1,256})\\?[\"'`]", re.A)


def _opened(segment: str) -> Iterator[str]:
    """Files that code inside a segment opens or names to write them."""
    for m in _CALL.finditer(segment):
        name, last = m.group(1), m.group(1).rsplit(".", 1)[-1]
        rest = segment[m.end() : m.end() + 64]
        if last in fixed.WRITING_CALLS or name.endswith(("File.write", "IO.write")):
            yield m.group(2)
        elif last in ("open", "fopen"):
            mode = re.match(r"\s{0,8},\s{0,8}(?:mode\s{0,8}=\s{0,8})?\\?[\"']([a-z+]{1,3})", rest)
            if mode and set(mode.group(1)) & set("wax+"):
                yield m.group(2)
        elif last == "Path" and re.match(r"\s{0,8}\)\.write_", rest):
            yield m.group(2)


_TEE = re.compile(r"(?:^|[\s/\"'])(?:tee|tee-object)(?=\s|$)", re.I)


def _given_to_writer(segment: str) -> Iterator[str]:
    """Words given to a program that writes the file it is given."""
    run = re.match(r"\s*(?:sudo\s+)?(\S+)", segment, re.I)
    first = run.group(1).lower() if run else ""
    if first in fixed.FILE_WRITERS or (first in ("cp", "install") and re.search(r"\s.*/dev/stdin", segment[run.end() :])):
        at = run.end()
    else:
        tee = _TEE.search(segment)
        if not tee:
            return
        at = tee.end()
    for word in segment[at:].split():
        yield _unquoted(word).removeprefix("of=")


def _is_text(segment: str) -> bool:
    return _leads(segment, fixed.TEXT_COMMANDS, {"git": fixed.TEXT_GIT})


def written_file(statement: str) -> str | None:
    """The dotenv file that a statement redirects, hands or opens to write."""
    if ".env" not in statement:
        return None
    for segment in shell.segments(statement.replace(">|", ">")):
        text = _is_text(segment)
        targets = [*_redirected(segment, text), *([] if text else (*_opened(segment), *_given_to_writer(segment)))]
        hit = next((x for x in targets if is_dotenv(x)), None)
        if hit is not None:
            return hit
    return None


_EDITOR = re.compile(r"(?<![\w.-])(?:g?sed|g?awk|perl|ruby)(?=\s)")
_FEEDS = re.compile(r"\s-(?:exec|ok)(?:dir)?\s|\bxargs\s")
_FOLDER = re.compile(r"\$\{?\w+\}?(?:/|(?=\.env\b))")


def edited_file(statement: str) -> str | None:
    """The dotenv file that an in-place editor rewrites, wherever in a statement it is called."""

    def given(text: str) -> str | None:
        return next((x for x in shell.edit_words(_FOLDER.sub("", text).replace("\\\n", " ")) if is_dotenv(x)), None)

    for m in _EDITOR.finditer(statement):
        head = statement[m.start() : m.start() + 2000].replace("\\\n", " ")
        flags = takewhile(lambda x: x.startswith("-"), head.split()[1:18])
        if not any(re.match(r"-[a-zA-Z0-9]*[iI]|--in-place|--include", x) for x in flags):
            continue
        # The first one that edits in place decides, so a statement is read on from one place only.
        before = statement[: m.start()]
        if _is_text(before.rpartition("|")[2]):
            break
        return given(statement[m.start() :]) or (next((x for x in _BREAKS.split(before) if is_dotenv(x)), None) if _FEEDS.search(before) else None)
    return given(statement) if any(x in statement for x in ("sed", "awk", "perl", "ruby")) else None


@dataclass
class Line:
    """Statements and the separators between them, and the here-document that the line opens."""

    parts: list[str] = field(default_factory=list)
    body: list[str] | None = None
    end: str | None = None
    runs_on: bool = False


_MARKS = re.compile(r"[\\\"'`;&|\n]")


def lines_of(command: str) -> list[Line]:
    """A command's lines. One goes on over a line's end inside of quotes, behind a backslash and behind a pipe."""
    found, at, n = [], 0, len(command)
    while at <= n:
        line, start, quote, done, stop = Line(), at, "", at, n
        for m in _MARKS.finditer(command, at):
            i, c = m.start(), m.group()
            if i < done:
                continue
            if quote:
                if c == "\\" and quote != "'":
                    done = i + 2
                elif c == quote:
                    quote = ""
                elif c == "\n":
                    line.runs_on = True
            elif c == "\\":
                done = i + 2
            elif c in "\"'`":
                quote = c
            elif c == "\n":
                if command[start:i].rstrip().endswith("|"):
                    line.runs_on = True
                    continue
                stop = i
                break
            elif c == ";" or command[i + 1 : i + 2] == c:
                width = 1 if c == ";" else 2
                line.parts += [command[start:i], command[i : i + width]]
                start = done = i + width
        line.runs_on |= bool(quote)
        line.parts.append(command[start:stop])
        opened = shell.HEREDOC.search(command, at, stop)
        at = stop + 1
        if opened:
            line.body = []
            while at <= n and line.end is None:
                stop = command.find("\n", at)
                text = command[at : stop if stop >= 0 else n]
                at = stop + 1 if stop >= 0 else n + 1
                if text.strip() == opened.group(2):
                    line.end = text
                else:
                    line.body.append(text)
        found.append(line)
    return found


_ASSIGNED = re.compile(r"(?<![\w$])([A-Za-z_]\w*)=(\"[^\"]*\"|'[^']*'|[^\s;&|]*)", re.A)
_LOOPED = re.compile(r"\bfor\s+([A-Za-z_]\w*)\s+in\s([^\n;]{0,2000})", re.A)
_EXPANDED = re.compile(r"\$\{?([A-Za-z_]\w*)\}?", re.A)
_GROUP = re.compile(r"(?:[})]|\b(?:done|fi|esac))\s*(?:\d?>|&>|\|)")
_AROUND = re.compile(r"^\s*exec\b|\benvsubst\b")
_SED_TEXT = re.compile(r"(?<![^'\"\s])(?:\$|\d{1,12}|/[^/\n]{0,256}/)[ \t]{0,8}[aic]\\?[ \t]{0,8}")


class _Variables:
    """What a command's variables hold where that is a dotenv file, and which it sets at all."""

    #: Characters that putting files in for variables may add to one command.
    ROOM = 1 << 16

    def __init__(self, command: str):
        self.room, self.files, self.names = self.ROOM, {}, set()
        plain = command
        for _ in range(2):
            plain = re.sub(r"\$\([^()]*\)/?", "", plain)
        for name, value in [*_ASSIGNED.findall(plain), *_LOOPED.findall(command)]:
            self.names.add(name)
            hit = next((x for x in map(_unquoted, self.put_in(value).split()) if is_dotenv(x)), None)
            if hit:
                self.files[name] = hit.translate({ord("*"): None, ord("?"): None})

    def put_in(self, text: str) -> str:
        if "$" not in text:
            return text

        def one(m: re.Match) -> str:
            file = self.files.get(m.group(1))
            if file is None or len(file) > self.room:
                return m.group()
            self.room -= len(file)
            return file

        return _EXPANDED.sub(one, re.sub(r"\$\{\w+:?[-=]([^{}]*)\}", r"\1", text))

    def expanded_in(self, text: str) -> bool:
        return "$" in text and any(x in self.names for x in _EXPANDED.findall(text))


def _script_values(statement: str) -> list[str]:
    """Values in an editor's script: between its delimiters, between quotes, and behind sed's text commands."""
    script = _SED_TEXT.sub("\n", statement)
    delimiter = re.search(r"(?<![\w-])s([^\w\s\\])", script)
    script = script.replace(delimiter.group(1) if delimiter else "/", "\n")
    return [*learned(script), *learned(re.sub("[\"']", "\n", script))]


def cut_writes(command: str) -> tuple[str, list[str]]:
    """A command without what it writes into dotenv files, and the values that this was.

    A statement that writes becomes ``<marker> > file`` (an edit in place ``sed -i <marker> file``), its here-document goes; the
    here-document of another command goes where it writes or names such a file. Where the values may stand outside of the statement,
    in a group, a quote over several lines or a variable, the whole command becomes the first write.
    """
    if ".env" not in command:
        return command, []
    cut, values = _short_cuts(command) if len(command) <= _SHORT else _cut_writes(command)
    return cut, [*values]


def _cut_writes(command: str) -> tuple[str, list[str]]:
    variables, values, kept = _Variables(command), [], []
    first, spread = None, False

    def edit_of(text: str) -> str | None:
        return edited_file(variables.put_in(text))

    for line in lines_of(command):
        spread |= line.runs_on
        writes, out = False, []
        for k, part in enumerate(line.parts):
            if k % 2 or (".env" not in part and not (variables.files and "$" in part)):
                out.append(part)
                continue
            target = written_file(variables.put_in(part))
            edited = edit_of(part) if target is None else None
            if target is None and edited is None:
                out.append(part)
                continue
            writes = True
            new = f"{MARK} > {target}" if target is not None else f"sed -i {MARK} {edited}"
            values += learned(part) if target is not None else _script_values(part)
            outside = variables.expanded_in(part)
            spread |= outside or (target is not None and bool(_GROUP.search(part) or _AROUND.search(part)))
            first = first or (new if target is not None or outside else None)
            indent, tail = part[: len(part) - len(part.lstrip())], part[len(part.rstrip()) :]
            out.append(indent + new + (tail if edited is not None else ""))
        kept.append("".join(out))
        if line.body is None:
            continue
        body = "\n".join(line.body)
        if writes:
            values += learned(body)
            spread |= variables.expanded_in(body)
            continue
        opening = next(x for x in line.parts if "<<" in x)
        message = all(_leads(x, ("gh",), {"git": fixed.MESSAGE_GIT}) for x in shell.segments(opening))
        hit = None
        for text in () if message else line.body:
            edited = edit_of(text) if ".env" in text or variables.files else None
            values += _script_values(text) if edited else []
            hit = hit or written_file(variables.put_in(text)) or edited
        if hit:
            values += learned(body)
            if variables.expanded_in(body):
                spread, first = True, first or f"{MARK} > {hit}"
        names = hit or (not message and any(w.rsplit("/", 1)[-1].startswith(".env") for x in line.body if ".env" in x for w in _BREAKS.split(x)))
        kept += [MARK] if names else line.body
        kept += [line.end] if line.end is not None else []
    if first is None and spread:
        edited = edited_file(command)
        if edited:
            values += _script_values(command)
            first = f"sed -i {MARK} {edited}"
    if first is not None and spread:
        return first, [*values, *learned(command)]
    return "\n".join(kept), values


_short_cuts = functools.lru_cache(4096)(_cut_writes)


def cut_input(given: dict) -> tuple[dict, list[str], int]:
    """A call's input without the texts of its edits, the values that they held, and how many texts went."""
    out, values, n = dict(given), [], 0
    for k in fixed.EDIT_TEXTS:
        if isinstance(given.get(k), str):
            values += learned(given[k])
            out[k] = MARK
            n += 1
    if isinstance(given.get("edits"), list):
        steps = [cut_input(x) if isinstance(x, dict) else (x, [], 0) for x in given["edits"]]
        out["edits"] = [x for x, _, _ in steps]
        values += [v for _, found, _ in steps for v in found]
        n += sum(m for *_, m in steps)
    return out, values, n


# --- learning ----------------------------------------------------------------------------------
_PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PATH = re.compile(r"[~.]{0,2}/[\w./-]*", re.A)
_PUBLIC = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.:/,=-")
_NAME_BEFORE = re.compile(r"[A-Za-z_]\w*\Z", re.A)
_ESCAPED_QUOTE, _STOP, _SHELL_SIGN = re.compile(r"\\([\"'])"), re.compile(r"[\s\"']"), re.compile(r"[;|&<>)\\]")
_NOT_ALONE, _LETTER, _DIGIT = re.compile(r"[\s\"'{}\[\]<>=]"), re.compile("[A-Za-z]"), re.compile("[0-9]")
LEAST, LEAST_UNNAMED = 8, 12


def worth_learning(name: str | None, value: str) -> bool:
    """Whether a value is worth cutting wherever it comes up: any but a plain word under a secret's name; under others only what looks generated or is plainly not public."""
    if len(value) < LEAST or value.startswith("$") or fixed.PREFIX in value or _PLAIN.fullmatch(value):
        return False
    if name is not None and is_secret_name(name):
        return True
    if len(value) < LEAST_UNNAMED or re.search(r"\s", value) or _PATH.fullmatch(value):
        return False
    return not set(value) <= _PUBLIC or bool(GENERATED.search(value))


def learned(text: str) -> list[str]:
    """Values worth learning of ``NAME=value`` as dotenv files and shells write it, and of lines that are one value, in order."""
    if "\\" in text:
        text = _ESCAPED_QUOTE.sub(r"\1", text.replace("\\n", "\n"))
    found, at = [], text.find("=")
    while at >= 0:
        start, end = at, at + 1
        while start and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] == "_"):
            start -= 1
        name, before = text[start:at], text[start - 1 : start]
        opening = text[end : end + 1]
        if not name or name[0].isdigit() or (before and before in ".$-"):
            at = text.find("=", end)
            continue
        if opening and opening in "\"'":
            close = text.find(opening, end + 1)
            if close < 0 or "\n" in text[end:close]:
                at = text.find("=", end)
                continue
            pieces, end = [text[end + 1 : close]], close + 1
        else:
            stop = _STOP.search(text, end)
            end = stop.start() if stop else len(text)
            whole = text[at + 1 : end].removesuffix(";")
            cut = _SHELL_SIGN.search(whole)
            pieces = [whole, *([whole[: cut.start()]] if cut and cut.start() else [])]
        if name.upper() == name or is_secret_name(name):
            found += [x for x in pieces if worth_learning(name, x)]
        at = text.find("=", max(end, at + 1))
    for line in text.split("\n"):
        bare = line.strip()
        inner = bare.rstrip("=")
        if inner and not _NOT_ALONE.search(inner) and _LETTER.search(inner) and _DIGIT.search(inner) and worth_learning(None, bare):
            found.append(bare)
    return found


class Values:
    """Learned values in one automaton: occurrences from the left, the longest of those that start together, none overlapping."""

    def __init__(self, values: Iterable[str]):
        self.found = ahocorasick.Automaton()
        for v in values:
            self.found.add_word(v, len(v))
        if len(self.found):
            self.found.make_automaton()

    def within(self, text: str) -> bool:
        return bool(len(self.found)) and next(self.found.iter(text), None) is not None

    def hits(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of all occurrences, from the left and the longest first."""
        if not len(self.found) or len(text) < LEAST:
            return []
        return [(a, a - less) for a, less in sorted((end + 1 - n, -n) for end, n in self.found.iter(text))]

    def spans(self, text: str) -> list[tuple[int, int]]:
        return apart(self.hits(text))

    def cut(self, text: str) -> tuple[str, int]:
        return cut_at(text, self.spans(text))


def apart(hits: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of occurrences from the left, the longest first, those that are cut."""
    out, at = [], 0
    for start, end in hits:
        if start >= at:
            out.append((start, end))
            at = end
    return out


def cut_at(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    if not spans:
        return text, 0
    pieces, at = [], 0
    for a, b in spans:
        pieces += [text[at:a], MARK]
        at = b
    return "".join([*pieces, text[at:]]), len(spans)
