"""Secret scans with a random forest against false positives.

Patterns find candidates: runs of key-like characters, values assigned to a name (of 8 characters or
more, quoted or not, with or without blanks; of 6 or more, and with blanks in quotes, behind a name
that speaks of secrets), private-key blocks. A forest then decides which are secrets from the candidate's length, its character
transitions, the share of it that dictionary words cover, the document's source (path), and the
neighbouring words. The dictionary holds the ``most`` words that are most frequent in the documents
(all are counted). The forest learns from labelled findings: a table (text, start, end, source, label)
given by ``labelled_table``, of which at most ``most`` rows are taken, or those built in, which
``labelled_findings`` makes from templates, with secrets and look-alikes (hashes and ids in listings,
numbers, words, placeholders). Values leave only as a digest.

Cases: null and empty texts have no candidates; repeated rows and doc_ids are scanned each; equal
candidates at several places are several findings; a candidate is scored whole at any length; an
empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

FINDINGS = "doc_id long, start long, end long, kind string, length long, value_sha256 string, score double, is_secret boolean"

#: A run of key-like characters, or a value behind a naming word.
CANDIDATE = re.compile(r"(?P<block>-----BEGIN [A-Z ]*PRIVATE KEY-----)|(?<![A-Za-z0-9+/_=-])(?P<run>[A-Za-z0-9+/_-]{20,}={0,2})(?![A-Za-z0-9+/_-])|(?<=[=:]\s)[\"'](?P<quoted>[^\"'\s]{8,})[\"']|(?<=[=:])[\"']?(?P<plain>[^\s\"'=:,;|]{12,})")
#: A value assigned to a name, whatever its characters.
_ASSIGNED = re.compile(r"[=:]>?[ \t]*(?:\"(?P<double>[^\"\n]{6,})\"|'(?P<single>[^'\n]{6,})'|(?P<plain>[^\s\"'=:,;|][^\s\"',;|]{5,}))")
_QUICK = re.compile(r"[A-Za-z0-9+/_-]{20}|[=:]>?\s*[\"']?[^\s]{6}")
_LOUD = re.compile(r"(?i)token|secret|passw|api|key|auth|bearer|credential|private|access")
_QUIET = re.compile(r"(?i)sha|md5|hash|commit|checksum|digest|uuid|id\b|rev|etag|version|example|sample|test|dummy")
_WORD = re.compile(r"[^\W\d_]{3,}")
#: Words inside a value, also of names such as getUserName.
_PART = re.compile(r"[A-Z]?[^\W\d_A-Z]{2,}|[A-Z]{3,}")
#: Words that look-alikes are made of; the dictionary comes from the documents.
COMMON = frozenset("the and for with from this that have not are was all any can data file path name user test value type list item index page code line text main build local config default example sample public static final class string number".split())


def dictionary(docs: DataFrame, most: int = 50_000) -> frozenset[str]:
    """The ``most`` most frequent words of three letters or more in all texts, in lower case. What is collected has that bound."""
    word = F.explode(F.split(F.lower(shared.text_or_empty()), r"[^\p{L}]+")).alias("word")
    counted = docs.select(word).where(F.length("word").between(3, 30)).groupBy("word").count()
    return frozenset(r.word for r in counted.orderBy(F.desc("count"), "word").limit(most).collect())


def labelled_table(table: DataFrame, most: int = 100_000, around: int = 64) -> list[tuple[str, int, int, str, int]]:
    """Labelled findings of a table (text, start, end, source, label), at most ``most``, those with the least hash; of each text what is around the value."""
    known = table.where("text IS NOT NULL AND start >= 0 AND end > start AND label IS NOT NULL")
    first = F.greatest(F.col("start") - around, F.lit(0))
    cut = F.substring(F.col("text"), (first + 1).cast("int"), (F.col("end") - first + around).cast("int"))
    rows = known.select(cut.alias("text"), (F.col("start") - first).alias("start"), (F.col("end") - first).alias("end"), F.coalesce("source", F.lit("")).alias("source"), F.col("label").cast("int").alias("label"))
    return [tuple(r) for r in rows.orderBy(F.xxhash64("text", "start", "end", "source", "label"), "text", "start").limit(most).collect()]


def features(text: str, start: int, end: int, source: str | None, words: frozenset[str] = COMMON) -> list[float]:
    """The 18 numbers that the forest sees."""
    value, n = text[start:end], end - start
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value]
    moves = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    shares = [kinds.count(k) / n for k in range(4)]
    seen: dict[str, int] = {}
    for c in value:
        seen[c] = seen.get(c, 0) + 1
    counts = np.array(list(seen.values()), float) / n
    entropy = float(-(counts * np.log2(counts)).sum())
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    near_words = {w.lower() for w in _WORD.findall(before + " " + after)}
    low = value.lower()
    covered = sum(len(w) for w in {w.lower() for w in _PART.findall(value)} if w in words or w in near_words)
    vowels = sum(c in "aeiouy" for c in low) / max(1, sum(c.isalpha() for c in low))
    repeats = sum(a == b for a, b in zip(value, value[1:], strict=False)) / max(1, n - 1)
    hexes = sum(c in "0123456789abcdef" for c in low) / n
    path = (source or "").lower()
    near = before[-24:]
    return [
        float(n), moves, *shares, entropy, len(seen) / n, min(1.0, covered / n), vowels, repeats, hexes,
        float(bool(_LOUD.search(near))), float(bool(_QUIET.search(near))), float(before.rstrip().endswith(("=", ":", '"', "'"))),
        float(before[-1:] in "\"'" and after[:1] in "\"'" and bool(before)), float(bool(re.search(r"test|example|lock|fixture", path))), float(value.count("-") == 4),
    ]


def labelled_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, source, label) from templates: the built-in labelled findings."""
    rng = np.random.default_rng(seed)
    hexes, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = sorted(COMMON)

    def run(letters: str, k: int) -> str:
        return "".join(letters[i] for i in rng.integers(0, len(letters), k))

    def prose(k: int) -> str:
        return " ".join("".join("etaoinshrdlu"[j] for j in rng.integers(0, 12, rng.integers(2, 9))) for _ in range(k))

    def pick(*xs):
        return xs[rng.integers(0, len(xs))]

    out = []
    def password() -> str:
        if rng.random() < 0.4:
            return run(base[:62] + "!#$%&*+-.?@^_~", int(rng.integers(7, 20))) + pick("!", "7", "#2", "Q9")
        return pick(str.title, str.lower, str.upper)(pick(*words)) + pick("", "!", "_", "@", "-", ".") + pick(str.title, str.lower)(pick(*words, "")) + pick("", "#", "!", "$") + run("0123456789", int(rng.integers(2, 5))) + pick("", "!", "#", "?")

    def plain_value() -> str:
        return pick(
            lambda: prose(int(1)) + run("etaoinshrdlu", 6), lambda: (run("etaoinshrdlu", 8)).title() + pick("", ".", "!"), lambda: f"20{run('0123456789', 2)}-{run('01', 2)}-{run('012', 2)}",
            lambda: f"{run('0123456789', 1)}.{run('0123456789', 2)}.{run('0123456789', 1)}-beta", lambda: pick(*words) + pick("_", "-", "/") + pick(*words) + pick(".py", ".txt", "", "/"),
            lambda: "//www." + pick(*words) + ".org/" + pick(*words), lambda: run("0123456789", int(rng.integers(6, 14))), lambda: pick(*words) + pick(*words) + pick("(", "()", ""), lambda: pick(*words) + "@" + pick(*words) + ".org",
        )()

    for k in range(n):
        label = k % 2
        short = k % 6 >= 4
        if short and label:
            value = password()
            value += run("0123456789", max(0, 6 - len(value)))
            name = pick("password", "db_password", "secret", "passwd", "DB_PASSWORD", "api_key", "auth_token", "client_secret")
            head, tail = pick((f"{name}: ", ""), (f"{name} = ", ""), (f"{name}=", ""), (f'{name}="', '"'), (f'{name} = "', '"'), (f"{name}: '", "'"), (f'"{name}": "', '"'))
            source = pick("src3", "app.env", "config.yml", "notes.md", "")
        elif short:
            loud = rng.random() < 0.3
            value = pick("changeme", "required", "${DB_PASSWORD}", "<password>", "your_password", "********", "xxxxxxxx", "undefined", "os.environ[0]", "get_password()", "settings.token") if loud else plain_value()
            value += "x" * max(0, 6 - len(value))
            name = pick("password", "secret", "api_key", "token") if loud else pick("name", "note", "title", "date", "version", "path", "url", "https", "see", "color", "phone", "id", "mail")
            head, tail = pick((f"{name}: ", ""), (f"{name} = ", ""), (f"{name}=", ""), (f'{name}="', '"'), (f'{name} = "', '"'), (f"{name}:", ""))
            source = pick("src3", "app.env", "config.yml", "notes.md", "")
        elif label:
            value = pick(lambda: run(hexes, 40), lambda: run(hexes, int(pick(32, 48, 64))), lambda: run(base[:62], int(rng.integers(20, 48))), lambda: run(base, 40), lambda: pick("sk-", "ghp_", "AKIA", "xoxb-") + run(base[:62], int(rng.integers(20, 40))))()
            name = pick("token", "secret", "api_key", "password", "auth_token", "access_key", "client_secret", "private_key", "Authorization")
            head, tail = pick((f'{name} = "', '"'), (f"{name}: ", ""), (f"{name}=", ""), (f"{name}: '", "'"), (f'"{name}": "', '"'))
            source = pick("src3", "app.env", "config.py", "notes.md", "")
        else:
            value = pick(
                lambda: run(hexes, int(pick(32, 40, 64))),
                lambda: f"{run(hexes, 8)}-{run(hexes, 4)}-{run(hexes, 4)}-{run(hexes, 4)}-{run(hexes, 12)}",
                lambda: run("0123456789", int(rng.integers(20, 30))),
                lambda: pick("_", "-", "/", "").join(pick(*words) for _ in range(int(rng.integers(4, 9)))) + "x" * 8,
                lambda: run(pick("ab", "xX", "a", "01"), int(rng.integers(20, 50))),
                lambda: "".join(pick("the", "tion", "ing", "er", "re", "on", "an", "ea", "ble", "schen", "keit") for _ in range(int(rng.integers(8, 14)))),
                lambda: pick("your_token_here_please", "changeme_changeme_changeme", "xxxxxxxxxxxxxxxxxxxxxxxx", "https://www.site.org/a/b"),
            )()
            head, tail = pick(("commit ", ""), ("sha256: ", ""), ("md5 = ", ""), ('uuid = "', '"'), ("checksum: ", ""), ("path: ", ""), ("see ", ""), ('name = "', '"'), ("", ""), ("token = ", "") if value[:4] in ("your", "chan", "xxxx") else ("id ", ""))
            source = pick("src3", "package.lock", "tests/data.txt", "notes.md", "")
        left = prose(int(rng.integers(0, 5))) + " "
        out.append((left + head + value + tail + " " + prose(int(rng.integers(0, 5))), len(left + head), len(left + head + value), source, label))
    return out


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left child (right is the next), share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, child, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]
                at = np.where(inner, child[at] + right, at)
            total += share[at]
        return total / max(1, len(self.trees))


def fit(findings: list[tuple[str, int, int, str, int]], words: frozenset[str] = COMMON, trees: int = 40, depth: int = 9, seed: int = 5) -> Forest:
    """A forest of trees on bootstrap samples, with a random third of the features at each split (Gini). ``words`` is the dictionary."""
    x = np.array([features(t, a, b, s, words) for t, a, b, s, _ in findings], float)
    y = np.array([label for *_, label in findings], float)
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        feature, threshold, child, share = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            k, own, level = todo.pop()
            share[k] = float(y[own].mean())
            if level == depth or len(own) < 8 or share[k] in (0.0, 1.0):
                continue
            best = (np.inf, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
                by = own[np.argsort(x[own, f], kind="stable")]
                v, ones, m = x[by, f], np.cumsum(y[by]), np.arange(1, len(by) + 1)
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                p, q = ones[cut] / m[cut], (ones[-1] - ones[cut]) / (len(by) - m[cut])
                impurity = m[cut] * p * (1 - p) + (len(by) - m[cut]) * q * (1 - q)
                i = int(impurity.argmin())
                if impurity[i] < best[0]:
                    best = (float(impurity[i]), int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2))
            if best[1] < 0:
                continue
            feature[k], threshold[k], child[k] = best[1], best[2], len(feature)
            go = x[own, best[1]] > best[2]
            for part in (own[~go], own[go]):
                feature.append(-1), threshold.append(0.0), child.append(0), share.append(0.0)
                todo.append((len(feature) - 1, part, level + 1))
        out.append((np.array(feature), np.array(threshold), np.array(child), np.array(share)))
    return Forest(out)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, over the whole text."""
    if not _QUICK.search(text) and "PRIVATE KEY" not in text:
        return []
    found = [(*m.span(m.lastgroup), m.lastgroup) for m in CANDIDATE.finditer(text)]
    more, k = [], 0
    for m in _ASSIGNED.finditer(text):
        a, b = m.span(m.lastgroup)
        while k < len(found) and found[k][1] <= a:
            k += 1
        if k < len(found) and found[k][0] < b:
            continue
        loud = _LOUD.search(text, max(0, m.start() - 24), m.start())
        if loud or (b - a >= 8 and not re.search(r"\s", m[m.lastgroup])):
            more.append((a, b, "plain" if m.lastgroup == "plain" else "quoted"))
    return sorted(found + more)


def scan(docs: DataFrame, forest: Forest, words: frozenset[str] = COMMON, threshold: float = 0.5) -> DataFrame:
    """A row per candidate of ``docs`` (doc_id, text, source), with its score. No shuffle; the forest and its dictionary are of bounded size."""
    held = docs.sparkSession.sparkContext.broadcast((forest, words))
    names = [x.split()[0] for x in FINDINGS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]

    def run(batches):
        own, known = held.value
        for batch in batches:
            rows, seen = [], []
            for doc_id, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b, kind in candidates(text):
                    seen.append(features(text, a, b, source, known))
                    rows.append((doc_id, a, b, kind, b - a, hashlib.sha256(text[a:b].encode()).hexdigest()))
            if rows:
                scores = own.score(np.array(seen))
                scores = np.where([r[3] == "block" for r in rows], 1.0, scores)
                yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(zip(*rows), types, strict=False)), pa.array(scores), pa.array(scores >= threshold)], names=names)

    return docs.select("doc_id", F.col("source").cast("string").alias("source"), shared.text_or_empty().alias("text")).mapInArrow(run, FINDINGS)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents with their scores; the dictionary is learned from the documents, the forest from the built-in findings."""
    docs = shared.documents(spark, sf_dir)
    words = dictionary(docs) | COMMON
    return scan(docs, fit(labelled_findings(), words), words)
