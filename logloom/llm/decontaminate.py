"""Benchmark passages in training documents, found with a generalised suffix automaton.

The words of all test items, as numbers, go into one automaton that accepts every stretch of words of
every item. A document's words stream through it: after each word it knows the longest stretch ending
there that some item holds. Where that is ``window`` words or more, those words are hit, and the state of
the last ``window`` words names the items; an item of fewer words is hit where its last state is reached
with all of its words. Only where two neighbouring words are neighbours in an item can a match go on, so a
document's stretches without such pairs never enter the automaton.

An automaton holds at most ``BLOCK_WORDS`` words of items and is all that is ever broadcast: about 30 MB
as sent and 120 MB in a worker. It is built in a task. Items beyond a block fill further blocks (an item longer than an eighth of
one is cut into parts that overlap by all but one word of a window), each block is a pass over the documents that
returns only rows with hits, and the rows' hits are joined by number. One block, the usual case, needs no shuffle.

Cases: words are runs of 0-9, a-z (A-Z in lower case) and bytes from 0x80 on; a null or empty text has
none, and an item without words is in no document; items are told apart by item_id, so rows that
repeat it are one item with several texts, and rows without an item_id are together one item that counts but has no
name in lists; null doc_ids and repeated rows are each answered; an empty benchmark hits nothing; an
empty table gives an empty table; other columns are carried only if named, whatever their names.
A task holds the numbers of one text's words at a time (about 30 bytes a word), which it reads in slices of a megabyte.
"""

from __future__ import annotations

import pickle
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import shared
from .periodic import slices

WINDOW = 10
BLOCK_WORDS = 200_000
#: A-Z in lower case, every byte that no word holds as a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several sequences of words, each inserted from the root."""

    def __init__(self, window: int):
        self.window, self.numbers = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.pairs: set[tuple[int, int]] = set()
        self.ends: list[tuple[list[int], str | None]] = []

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of q's stretches up to one word longer than p's, made by a copy of q where it isn't q itself."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes], item: str | None) -> None:
        ids = [self.numbers.setdefault(w, len(self.numbers)) for w in words]
        last = 0
        for c in ids:
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, self.next[p][c])
            last = new
        self.pairs.update(zip(ids, ids[1:]))  # noqa: B905
        self.ends.append((ids, item))

    def packed(self) -> bytes:
        """What a scan needs: words, pairs, transitions, links, and the items of windows and of short items by state."""
        n, w = len(self.next), self.window
        # The state of a match's last ``window`` words is the one of the suffix chain whose lengths span the window.
        at_window = [-1] * n
        for v in sorted(range(n), key=self.length.__getitem__):
            if self.length[v] >= w:
                at_window[v] = v if self.length[self.link[v]] < w else at_window[self.link[v]]
        items: dict[int, set] = {}
        short: dict[int, dict[int, set]] = {}
        for ids, item in self.ends:
            v = 0
            for k, c in enumerate(ids):
                v = self.next[v][c]
                if k + 1 >= w:
                    items.setdefault(at_window[v], set()).add(item)
            if 0 < len(ids) < w:
                short.setdefault(v, {}).setdefault(len(ids), set()).add(item)
        # The nearest state of the suffix chain, itself included, where a short item ends.
        to_short = [-1] * n
        if short:
            for v in sorted(range(n), key=self.length.__getitem__):
                to_short[v] = v if v in short else to_short[self.link[v]] if v else -1
        words, m = list(self.numbers), len(self.numbers)
        pairs = np.sort(np.array([a * m + b for a, b in self.pairs], np.int64))
        keys = np.array([v * m + c for v, follow in enumerate(self.next) for c in follow], np.int64)
        to = np.array([q for follow in self.next for q in follow.values()], np.int32)
        arrays = [np.array(x, np.int32) for x in (self.link, self.length, at_window, to_short)]
        ones = np.array(sorted({c for ids, _ in self.ends if min(len(ids), w) == 1 for c in ids}), np.int64)
        return pickle.dumps((w, words, pairs, ones, keys, to, arrays, items, short), protocol=5)


class Scanner:
    """Matches documents against a packed automaton."""

    def __init__(self, packed: bytes):
        self.window, words, self.pairs, self.ones, keys, to, arrays, self.items, self.short = pickle.loads(packed)
        self.numbers = {w: k for k, w in enumerate(words)}
        self.step = dict(zip(keys.tolist(), to.tolist(), strict=True))
        self.link, self.length, self.at_window, self.to_short = (a.tolist() for a in arrays)

    def numbered(self, octets: bytes) -> np.ndarray:
        """A text's words as numbers, -1 for those of no item."""
        get, parts = self.numbers.get, []
        for piece in slices(octets.translate(_FOLD)):
            words = piece.split()
            parts.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
        return np.concatenate(parts)

    def _stretches(self, ids: np.ndarray):
        """(first, one past the last) word of stretches whose neighbours are all neighbours in items, or that are a window of one word."""
        if not len(self.numbers) or not len(ids):
            return []
        known = ids >= 0
        good = np.zeros(max(len(ids) - 1, 0), bool)
        both = np.flatnonzero(known[1:] & known[:-1])
        if len(both) and len(self.pairs):
            pairs = ids[both] * len(self.numbers) + ids[both + 1]
            at = np.searchsorted(self.pairs, pairs)
            good[both] = self.pairs[np.minimum(at, len(self.pairs) - 1)] == pairs
        edge = np.diff(np.concatenate([[0], good, [0]]).astype(np.int8))
        found = list(zip(np.flatnonzero(edge > 0).tolist(), (np.flatnonzero(edge < 0) + 1).tolist(), strict=True))
        least = 2 if self.short else self.window
        found = [(a, b) for a, b in found if b - a >= least]
        if len(self.ones):
            inside = np.zeros(len(ids) + 1, np.int64)
            for a, b in found:
                inside[a] += 1
                inside[b] -= 1
            alone = np.isin(ids, self.ones) & (np.cumsum(inside)[:-1] == 0)
            found += [(k, k + 1) for k in np.flatnonzero(alone).tolist()]
        return found

    def match(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words, apart and in order, and the items that they come from."""
        spans, items = [], set()
        m, step, link, length, w = len(self.numbers), self.step, self.link, self.length, self.window
        for a, b in self._stretches(ids):
            v = run = 0
            for k, c in enumerate(ids[a:b].tolist(), a):
                q = step.get(v * m + c)
                while q is None and v:
                    v = link[v]
                    run = length[v]
                    q = step.get(v * m + c)
                v, run = (q, run + 1) if q is not None else (0, 0)
                if run >= w:
                    spans.append((k + 1 - run, k + 1))
                    items |= self.items[self.at_window[v]]
                u = self.to_short[v] if self.short else -1
                while u >= 0:
                    for n, ended in self.short[u].items():
                        if n <= run:
                            spans.append((k + 1 - n, k + 1))
                            items |= ended
                    u = self.to_short[link[u]] if u else -1
        return joined(spans), items


def joined(spans) -> list[tuple[int, int]]:
    """Spans of words that overlap or touch, as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row (block, automaton) for each block of at most about ``block_words`` words of ``items`` (item_id, text)."""
    most = max(window, block_words // 8)

    def parts(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = item_words(text)
                out += [(item, b" ".join(words[k : k + most]), len(words[k : k + most])) for k in range(0, max(len(words) - window + 1, 1), most - window + 1) if words]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[], [], []], (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["item", "words", "n"])

    def build(keys, table):
        made = Automaton(window)
        for item, words in sorted(zip(table["item"].to_pylist(), table["words"].to_pylist(), strict=True), key=lambda r: (r[1], r[0] or "")):
            made.add(words.split(), item)
        return pa.table({"block": pa.array([keys[0].as_py()], pa.int64()), "automaton": pa.array([made.packed()], pa.binary())})

    cut = items.select(F.col("item_id").cast("string"), "text").mapInArrow(parts, "item string, words binary, n long").distinct()
    cut = shared.materialize(cut, "item-parts")
    total = cut.agg(F.sum("n")).first()[0] or 0
    # Half full on average, so that hashing overfills none; a part has an eighth of a block at most.
    blocks = 1 if total <= block_words else -(-total * 2 // block_words)
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    return shared.materialize(dealt.groupBy("block").applyInArrow(build, "block long, automaton binary"), "automata")


_kept: dict = {}


def _scanner(held, name: str) -> Scanner:
    """This worker's scanner of the automaton called ``name``; a worker keeps one."""
    shared.own_worker("decontaminate", _kept.clear)
    if name not in _kept:
        _kept.clear()
        _kept[name] = Scanner(held.value)
    return _kept[name]


def _without(octets: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from each span's first word to its last."""
    words = enumerate(_WORD.finditer(octets.translate(_FOLD)))
    out, at = [], 0
    for start, stop in spans:
        first = next(m for k, m in words if k == start)
        last = first if stop == start + 1 else next(m for k, m in words if k == stop - 1)
        out.append(octets[at : first.start()])
        at = last.end()
    return b"".join([*out, octets[at:]])


_FOUND = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))),
        StructField("items", ArrayType(StringType())),
        StructField("cleaned", StringType()),
    ]
)


def _answer(octets: bytes, n: int, spans: list[tuple[int, int]], items, longest: int | None) -> tuple:
    cleaned = None
    if longest is not None:
        gone = [(a, b) for a, b in spans if b - a > longest]
        cleaned = _without(octets, gone) if gone else octets
    return n, sum(b - a for a, b in spans), [{"start": a, "stop": b} for a, b in spans], list(items), cleaned


def _emit(batches, answer, names, size=8 << 20):
    """Batches of the columns after the first with what ``answer`` (bytes of the text, row of the batch) tells of each row; None leaves a row out."""
    for batch in batches:
        texts, held, at, total = batch.column(0).cast(pa.large_binary()), [], [], 0
        for k in range(batch.num_rows):
            octets = texts[k].as_py() or b""
            row = answer(octets, batch, k)
            if row is not None:
                held.append(row)
                at.append(k)
                total += len(row[4] or b"") + 100
            if at and (total > size or k == batch.num_rows - 1):
                columns = [pa.array(v, t) for v, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.list_(_SPAN), pa.list_(pa.string()), pa.binary()), strict=True)]
                columns[4] = columns[4].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[1 : len(names) + 1]), *columns], names=[*names, "n_words", "n_hit", "spans", "items", "cleaned"])
                held, at, total = [], [], 0


def scan(docs: DataFrame, items: DataFrame, carry: list[str], window: int = WINDOW, longest: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``carry`` columns of every row, its n_words and n_hit, the spans of hit words (start, stop), the items found.

    With ``longest``, ``cleaned`` is the text without the spans of more words than that; without it, null.
    """
    spark = docs.sparkSession
    blocks = automata(items, window, block_words)
    numbers = [r.block for r in blocks.select("block").orderBy("block").collect()]
    names = [f"_{i}" for i in range(len(carry))]
    rows = docs.select("text", *(shared.column(c).alias(n) for c, n in zip(carry, names, strict=True)))
    fields = rows.drop("text").schema.fields

    def over(rows: DataFrame, block: int, only_hit: bool, fields: list[StructField], names: list[str]) -> DataFrame:
        held, name = spark.sparkContext.broadcast(bytes(blocks.where(F.col("block") == block).first().automaton)), uuid.uuid4().hex

        def found(batches):
            scanner = _scanner(held, name)

            def answer(octets, batch, k):
                ids = scanner.numbered(octets)
                spans, from_items = scanner.match(ids)
                return None if only_hit and not spans else _answer(octets, len(ids), spans, from_items, longest)

            return _emit(batches, answer, names)

        return rows.mapInArrow(found, StructType([*fields, *_FOUND.fields]))

    if len(numbers) == 1:
        out = over(rows, numbers[0], False, fields, names)
    else:

        def merge(batches):
            def answer(octets, batch, k):
                n = sum(len(piece.split()) for piece in slices(octets.translate(_FOLD)))
                spans = joined((x["start"], x["stop"]) for x in batch.column(len(names) + 1)[k].as_py() or [])
                return _answer(octets, n, spans, batch.column(len(names) + 2)[k].as_py() or [], longest)

            return _emit(batches, answer, names)

        # Rows get numbers once, in a table: later passes must see the same ones.
        rows = shared.materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        hits = None
        for block in numbers:
            one = over(rows.select("text", "_row"), block, True, [StructField("_row", LongType())], ["_row"]).select("_row", "spans", "items")
            one = shared.materialize(one, f"hits-{block}")
            hits = one if hits is None else hits.union(one)
        if hits is None:
            hits = spark.createDataFrame([], "_row long, spans array<struct<start: long, stop: long>>, items array<string>")
        # Items are told apart across blocks, and a null one, which counts once, among them.
        hits = hits.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        all_rows = rows.join(hits, "_row", "left").select("text", *names, "spans", "items")
        out = all_rows.mapInArrow(merge, StructType([*fields, *_FOUND.fields]))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)), "n_words", "n_hit", "spans", "items", "cleaned")


def decontaminate(docs: DataFrame, items: DataFrame, longest: int = WINDOW - 1, most_coverage: float = 0.5, window: int = WINDOW) -> DataFrame:
    """``docs`` with spans of more than ``longest`` hit words cut out of their texts; rows with a share of hit words above ``most_coverage`` go."""
    found = scan(docs.select(F.struct("*").alias("_row"), "text"), items, ["_row"], window, longest)
    kept = found.where(F.col("n_hit") <= most_coverage * F.col("n_words"))
    text = F.when(F.col("n_hit") > 0, F.col("cleaned")).otherwise(F.col("_row.text"))
    return kept.select(*(text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the whole benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = scan(shared.documents(spark, sf_dir), items, ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Words of both sides, their windows of 10 (or a short item's number) joined by equality, hit words counted once.
OP11_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM asked WHERE len(w) > 0) t),
doc_windows AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered JOIN (SELECT DISTINCT n FROM item_windows) k ON len(w) >= n) t),
met AS (SELECT r, i, n, item_id FROM doc_windows JOIN item_windows USING (n, words)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM met) d) t GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM met) t GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""
