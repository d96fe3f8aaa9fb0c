"""Stretches of a text that repeat with a period, found by Lyndon roots without a suffix array.

Words are numbered by first use. A run that counts (``least`` words and ``exponent`` periods or more)
repeats 2/3 of itself, so each of its words lies in a window of words that occurs again in the text;
other stretches are left out after one sort of window hashes, and no run crosses their ends. Each
stretch is scanned from right to left, once under the order of the word numbers and once under its
reverse, with a stack of the suffixes that no later one undercuts: the top is where the longest Lyndon word
that starts here ends. Every run has such a word as its root under one of the orders (the runs theorem), and
extending a root to both sides by common extensions gives the run. Common extensions are found by
binary search over rolling hashes modulo 2^61 - 1; each run found is then verified word by word: that it
has its period and that neither neighbour keeps it.

All work on a text is n log n in its words. A task holds one text at a time: its words as 32-bit numbers,
read in slices of a megabyte, and about 60 bytes a word while windows are sorted; a text of 100 MB needs
about 1 GB.

Cases: a null text has no words, the empty digest and no runs; words are bytes other than space and
0x09-0x0D, case counts; a null doc_id is like any other value; rows that repeat are each answered;
an empty table gives an empty table; other columns are carried only if named, whatever their names.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import shared

LEAST, EXPONENT = 24, 3
AT_ONCE = 1 << 20
_P, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
_SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")


def slices(octets: bytes, at_once: int = AT_ONCE):
    """Consecutive slices of about ``at_once`` bytes that cut no word."""
    at = 0
    while len(octets) - at > at_once:
        cut = max(octets.rfind(x, at, at + at_once) for x in _SPACES)
        if cut <= at:  # a word longer than a slice stays whole
            cut = min((k for k in (octets.find(x, at + at_once) for x in _SPACES) if k >= 0), default=len(octets))
        yield octets[at:cut]
        at = cut
    yield octets[at:]


def numbered(octets: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Words of a text as numbers by first use, and how each number is spelt."""
    seen: dict[bytes, int] = {}
    parts = []
    for piece in slices(octets):
        words = piece.split()  # bytes.split takes exactly the six separators
        parts.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)))
    return (np.concatenate(parts) if len(parts) > 1 else parts[0]), list(seen)


def stretches(ids: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal stretches of words that lie in windows occurring twice or more; hash clashes only add to them."""
    n = len(ids) - window + 1
    if n < 2:
        return []
    h, size = ids.astype(np.uint64) + np.uint64(1), 1
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    while size < window:
        step = min(size, window - size)
        factor = np.uint64(pow(0xD6E8FEB86659FD93, step, 1 << 64))
        h = h[: len(h) - step] * factor + h[step:]
        h ^= h >> np.uint64(31)  # equal windows stay equal
        size += step
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    starts = np.flatnonzero(again)
    breaks = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.concatenate([[0], breaks + 1])].tolist(), (starts[np.concatenate([breaks, [len(starts) - 1]])] + window).tolist(), strict=True))


class Extensions:
    """Longest common extensions of positions of one sequence, by binary search over its prefix hashes."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.hashes, self.powers = [0], [1]
        h, p = 0, 1
        for x in ids:
            h, p = (h * _BASE + x + 1) % _P, p * _BASE % _P
            self.hashes.append(h)
            self.powers.append(p)

    def _equal(self, i: int, j: int, m: int) -> bool:
        h, p = self.hashes, self.powers[m]
        return (h[i + m] - h[i] * p - h[j + m] + h[j] * p) % _P == 0

    def right(self, i: int, j: int) -> int:
        """How far the words from i on equal those from j on, i < j."""
        ids, most, m = self.ids, self.n - j, 0
        while m < most and m < 4:
            if ids[i + m] != ids[j + m]:
                return m
            m += 1
        step = 4
        while m + step <= most and self._equal(i + m, j + m, step):
            m += step
            step *= 2
        while step:
            if m + step <= most and self._equal(i + m, j + m, step):
                m += step
            step //= 2
        return m

    def left(self, i: int, j: int) -> int:
        """How far the words before i equal those before j, i < j."""
        ids, m = self.ids, 0
        while m < i and m < 4:
            if ids[i - 1 - m] != ids[j - 1 - m]:
                return m
            m += 1
        step = 4
        while m + step <= i and self._equal(i - m - step, j - m - step, step):
            m += step
            step *= 2
        while step:
            if m + step <= i and self._equal(i - m - step, j - m - step, step):
                m += step
            step //= 2
        return m


def runs(ids: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all maximal runs with at least ``least`` words and ``exponent`` (2 or more) periods."""
    n, reach = len(ids), Extensions(ids)
    right, left = reach.right, reach.left
    found, last = set(), {}
    for sign in (1, -1):
        stack = [n]
        last.clear()
        for i in range(n - 1, -1, -1):
            x = ids[i]
            while (j := stack[-1]) < n:
                y = ids[j]
                if x == y:
                    m = right(i, j)
                    if j + m == n:  # the later suffix is a prefix of this one, and so smaller
                        break
                    if (ids[i + m] < ids[j + m]) != (sign > 0):
                        break
                elif (x < y) != (sign > 0):
                    break
                stack.pop()
            stack.append(i)
            period = j - i
            # Without an equal neighbour the root stands alone; a root inside a run known for its period adds nothing.
            if not (j < n and ids[j] == x) and not (i and ids[i - 1] == ids[j - 1]):
                continue
            known = last.get(period)
            if known and known[0] <= i and j <= known[1]:
                continue
            before, after = left(i, j), right(i, j) if j < n else 0
            length = before + period + after
            if length >= 2 * period:
                last[period] = (i - before, j + after)
                if length >= least and length >= exponent * period:
                    found.add((i - before, length, period))
    return sorted(((s, m, q) for s, m, q in found if _holds(ids, s, m, q)), key=lambda r: (r[0], r[2]))


def _holds(ids: list[int], start: int, length: int, period: int) -> bool:
    """The run word by word: it has its period, and no neighbour keeps it."""
    end = start + length
    if ids[start : end - period] != ids[start + period : end]:
        return False
    return (start == 0 or ids[start - 1] != ids[start - 1 + period]) and (end == len(ids) or ids[end] != ids[end - period])


def _text_runs(ids: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    # A run's last period is its first one again: length - period words repeat at a distance.
    window = max(1, min(least - least // exponent, 64))
    found = []
    for a, b in stretches(ids, window):
        if b - a >= least:
            found += [(a + s, m, q) for s, m, q in runs(ids[a:b].tolist(), least, exponent)]
    return found


def _steeper(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """Order of runs by falling exact length/period, then start, then period."""
    return b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2]


def find(docs: DataFrame, text: Column | None = None, carry: list[str] | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``carry`` columns of each row, ``runs`` by start and period, the ``steepest`` run and the ``collapsed`` text.

    A run is a maximal stretch of at least ``least`` words and ``exponent`` periods, 3 or more. ``collapsed`` has the words that
    no run holds after its first period, with single spaces between them.
    """
    if exponent < 3 or least < 1:
        raise ValueError("runs of fewer than three periods may leave no repeated window")
    carry = carry or []
    names = [f"_{i}" for i in range(len(carry))]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def answers(batches):
        shared.own_worker("periodic")
        for batch in batches:
            at, texts = 0, batch.column(0).cast(pa.large_binary())
            held: list[tuple] = []
            size = 0
            for k in range(batch.num_rows):
                ids, spelt = numbered(texts[k].as_py() or b"")
                found = _text_runs(ids, least, exponent) if len(ids) >= least else []
                if found:
                    kept = np.ones(len(ids), bool)
                    for s, m, q in found:
                        kept[s + q : s + m] = False
                    ids = ids[kept]
                collapsed = b" ".join(b" ".join([spelt[x] for x in ids[c : c + AT_ONCE].tolist()]) for c in range(0, len(ids), AT_ONCE))
                dicts = [{"start": s, "length": m, "period": q} for s, m, q in found]
                steepest = min(found, key=cmp_to_key(_steeper), default=None)
                held.append((dicts, dict(zip(("start", "length", "period"), steepest, strict=True)) if steepest else None, collapsed))
                size += len(collapsed) + 100
                if size > 8 << 20 or k == batch.num_rows - 1:
                    part = batch.slice(at, k + 1 - at)
                    columns = [pa.array(v, t) for v, t in zip(zip(*held, strict=True), (pa.list_(run), run, pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns[:2], columns[2].cast(pa.string())], names=[*names, "runs", "steepest", "collapsed"])
                    at, held, size = k + 1, [], 0

    text = F.col("text") if text is None else text
    rows = docs.select(text.alias("_text"), *(shared.column(c).alias(n) for c, n in zip(carry, names, strict=True)))
    of_run = StructType([StructField(k, LongType()) for k in ("start", "length", "period")])
    schema = StructType([*rows.schema.fields[1:], StructField("runs", ArrayType(of_run)), StructField("steepest", of_run), StructField("collapsed", StringType())])
    out = rows.mapInArrow(answers, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)), "runs", "steepest", "collapsed")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or where crc32 of the id is divisible by ten its words with a periodic tail, with single spaces between them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    first = g % n
    period = F.floor((n - first) / (3 + g % 8)) + 1
    cycle = F.slice(words, (first + 1).cast("int"), period.cast("int"))
    times = F.ceil((n - first) / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(cycle, times)), 1, (n - first).cast("int"))
    periodic = F.array_join(F.concat(F.slice(words, 1, first.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), periodic).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, some of them with a planted tail, as digests of what ``find`` gives."""
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    found = find(docs, planted(F.col("doc_id"), F.col("text")), ["doc_id"])
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = F.col("steepest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("1000 * steepest.length div steepest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
