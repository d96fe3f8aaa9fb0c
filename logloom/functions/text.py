"""Scalar functions as Catalyst expressions: no UDF, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def java(pattern: str) -> str:
    """A pattern for Java: ``$`` at the very end only, ``[`` escaped inside classes by their authors."""
    return pattern.replace("$)", "\\z)") if pattern.endswith("$)") else (pattern[:-1] + "\\z" if pattern.endswith("$") and not pattern.endswith("\\$") else pattern)


def like(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(java(pattern))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(java(pattern)))


def as_string(text: Column) -> Column:
    """An empty string counts as absent."""
    return F.nullif(text, F.lit(""))


def basename(path: Column) -> Column:
    """The last part of a path, a closing slash aside."""
    return F.element_at(F.split(F.regexp_replace(path, r"(?<=.)/+\z", ""), "/"), -1)


def project_slug(path: Column) -> Column:
    return F.regexp_replace(path, "[^a-zA-Z0-9]", "-")


def is_test_file(path: Column) -> Column:
    """In a folder of tests, or a source file with the word test or spec in its name."""
    name = basename(path)
    dotted = F.split(name, r"\.")
    stem = F.array_join(F.slice(dotted, 1, F.size(dotted) - 1), ".")
    words = F.split(F.lower(F.regexp_replace(stem, r"(?=[A-Z])", " ")), "[^a-z0-9]+")
    named = extension(name).isin(*fixed.TEST_EXTENSIONS) & F.arrays_overlap(words, F.array(F.lit("test"), F.lit("spec")))
    parts = F.split(F.lower(path), "/")
    below = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*(F.lit(x) for x in fixed.TEST_FOLDERS)))
    return F.coalesce(below, F.lit(False)) | F.coalesce(named, F.lit(False))


def extension(path: Column) -> Column:
    """What stands behind the last dot, in lower case; null without a dot."""
    parts = F.split(F.lower(path), r"\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1))


def is_code_file(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*fixed.CODE_EXTENSIONS), F.lit(False))


def is_manifest(path: Column) -> Column:
    return basename(path).isin(*fixed.MANIFESTS)


def says_it_failed(text: Column) -> Column:
    found = F.lit(False)
    for word in fixed.FAILURE_WORDS:
        found = found | F.coalesce(text.contains(word), F.lit(False))
    return found


def failed(is_error: Column, stdout: Column, stderr: Column, text: Column) -> Column:
    return F.coalesce(is_error, F.lit(False)) | says_it_failed(stdout) | says_it_failed(stderr) | says_it_failed(text)


def normalised(content: Column) -> Column:
    """Without carriage returns before line ends, white space at line ends and line ends at the end."""
    lines = F.split(F.regexp_replace(content, "\r\n", "\n"), "\n")
    return F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+\z", "")), "\n"), r"\n+\z", "")


def digest(content: Column) -> Column:
    return F.sha1(normalised(content).cast("binary"))


def sides(old: Column, new: Column) -> Column:
    """An edit's two sides as one key; the length keeps them apart."""
    return F.sha1(F.concat(F.length(old).cast("string"), F.lit(":"), old, new).cast("binary"))


def millis(ts: Column) -> Column:
    """Milliseconds since the epoch, rounded to the nearest, halves away from it."""
    return F.call_function("div", F.round(F.unix_micros(ts), -3), F.lit(1000))


def break_length(ms: Column) -> Column:
    """47m, or 2h05; halves are rounded up."""
    minutes = F.floor(ms / 60000 + 0.5)
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), F.lpad((minutes % 60).cast("string"), 2, "0"))
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(hours)


def listed(names: Column, most: int, of: Column | None = None) -> Column:
    """"a, b and 2 more" of an array of names, or of ``of`` names that it begins."""
    more = (F.size(names) if of is None else of) - most
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def line_words(line: Column) -> Column:
    """A line's letters and digits, by which lines of commits and sessions are compared."""
    return F.regexp_replace(line, r"[^\p{L}\p{N}]+", "")


def package_name(specifier: Column) -> Column:
    name = F.regexp_extract(specifier, r"^(?:@[^/@\s]+/)?[^<>=~!@\[\s]+", 0)
    return F.when(name == "", specifier).otherwise(name)


def remote_name(url: Column) -> Column:
    """owner/name of a repository's address, in either form."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"/+\z", ""), r"\.git\z", "")
    scp = F.regexp_extract(bare, r"^[^/@\s]+@[^:/\s]+:/*([^/\s]+(?:/[^/\s]+)+)\z", 1)
    plain = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/\s]*@)?[^/\s]+/+([^/\s]+(?:/[^/\s]+)+)\z", 1)
    return F.nullif(F.when(scp != "", scp).otherwise(plain), F.lit(""))


def is_newer(latest: Column, current: Column) -> Column:
    """Numeric comparison of dotted versions; missing parts are 0."""
    parts = lambda v: F.transform(F.split(F.regexp_extract(v, r"^v?(\d+(?:\.\d+)*)", 1), r"\."), lambda x: F.coalesce(x.try_cast("long"), F.lit(0)))
    a, b = parts(latest), parts(current)
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), n - F.size(x)))
    return pad(a) > pad(b)


def is_within(top: Column, folder: Column) -> Column:
    """Whether a folder is ``top`` or below it, by whole segments."""
    root = F.regexp_replace(top, r"(?<=.)/+\z", "")
    return (folder == root) | folder.startswith(F.when(root == "/", root).otherwise(F.concat(root, F.lit("/"))))


def exec_failed(text: Column) -> Column:
    """An exit code other than 0 in a tool's output."""
    exited = F.regexp_extract(text, r"Process exited with code (-?\d+)", 1)
    codes = F.regexp_extract_all(text, F.lit(r'"exit_code"\s*:\s*(-?\d+)'), F.lit(1))
    return F.coalesce(((exited != "") & (exited != "0")) | F.exists(codes, lambda x: x != "0"), F.lit(False))


def epoch_ms(seconds_or_ms: Column) -> Column:
    """Numbers below 1e11 are seconds, others milliseconds."""
    return F.when(seconds_or_ms < 1e11, seconds_or_ms * 1000).otherwise(seconds_or_ms).cast("long")


def upload_outcome(status: Column) -> Column:
    """Class of an HTTP status (null: no answer)."""
    return (
        F.when(status.between(200, 299), "ok")
        .when(status.isin(401, 403), "unauthorized")
        .when(status == 413, "permanent")
        .when(status == 429, "throttled")
        .otherwise("retry")
    )


def known_type(kind: Column) -> Column:
    return kind.isin(*fixed.RECORD_TYPES)
