"""Exact duplicates by Patricia-trie owners.

Tries hold whole byte strings, with chains of single children compressed into one edge; the node
where a string ends stores its owner and its counts. Tasks first put the rows that they read into a
trie of their own, so a text with any number of copies leaves a task once. The survivors are
exchanged by length and content hash, equal texts meet in one trie, and its terminal nodes name the
owner. A trie that outgrows ``budget`` spills its largest subtrees: their terminals are emitted as
partial owners, and a last sum over (length, digest) joins partial owners of a text. Only those pieces
of one text that were spilled at different times are joined by length and SHA-256 instead of by bytes.

Cases: null text equals empty text; null doc_ids rank below all others; of equal texts exactly one
row stays even if a doc_id repeats; an empty table gives an empty table; further columns are
carried or ignored but never compared.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Bytes of strings that a task's trie holds before it spills.
BUDGET = 64 << 20


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halves, so that comparing is left to memcmp."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi, step = 0, n, 8
    while lo + step < hi and a[lo : lo + step] == b[lo : lo + step]:
        lo, step = lo + step, step * 2
    hi = min(hi, lo + step)
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Node:
    __slots__ = ("edge", "children", "owner")

    def __init__(self, edge: bytes, owner=None):
        self.edge, self.children, self.owner = edge, None, owner


class Patricia:
    """Radix trie from byte strings to (owner, number of rows); ``better`` picks one of two owners."""

    def __init__(self, better):
        self.root, self.better, self.bytes = Node(b""), better, 0

    def add(self, key: bytes, owner, count: int) -> None:
        node, at, n = self.root, 0, len(key)
        while at < n:
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                node.children = node.children or {}
                node.children[key[at]] = Node(key[at:], [owner, count])
                self.bytes += n - at + 300
                return
            edge = child.edge
            if len(edge) <= n - at and key[at : at + len(edge)] == edge:
                node, at = child, at + len(edge)
                continue
            k = _common(edge, key[at:])
            fork = Node(edge[:k])
            child.edge = edge[k:]
            fork.children = {child.edge[0]: child}
            node.children[edge[0]] = fork
            self.bytes += 300
            node, at = fork, at + k
        if node.owner is None:
            node.owner = [owner, count]
        else:
            node.owner[0] = self.better(node.owner[0], owner)
            node.owner[1] += count

    def terminals(self, node: Node | None = None, prefix: bytes = b""):
        stack = [(node or self.root, prefix)]
        while stack:
            x, before = stack.pop()
            key = before + x.edge
            if x.owner is not None:
                yield key, x.owner[0], x.owner[1]
            if x.children:
                stack += [(c, key) for c in x.children.values()]

    def spill(self, keep: int):
        """Terminals of the largest subtrees below the root, which leave the trie, until at most ``keep`` bytes stay."""
        sizes = {}
        for first, top in (self.root.children or {}).items():
            total, stack = 0, [top]
            while stack:
                x = stack.pop()
                total += len(x.edge) + 300
                stack += x.children.values() if x.children else ()
            sizes[first] = total
        for first in sorted(sizes, key=sizes.get, reverse=True):
            if self.bytes <= keep:
                return
            yield from self.terminals(self.root.children.pop(first))
            self.bytes -= sizes[first]


def _owners(batches, smallest: bool, budget: int, with_text: bool):
    """Rows (text, owner, n_rows) into tries; out go (text or none, length, digest, owner, n_rows)."""

    def better(a, b):
        return b if a is None else a if b is None else min(a, b) if smallest else max(a, b)

    names = [*(["text"] if with_text else []), "length", "digest", "owner", "n_rows"]
    types = [*([pa.binary()] if with_text else []), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def packed(found):
        held, size = [], 0
        for key, owner, n in found:
            held.append((*([key] if with_text else []), len(key), hashlib.sha256(key).digest(), owner, n))
            size += len(key) * with_text + 60
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), types, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), types, strict=True)], names=names)

    shared.own_worker("dedup")
    trie = Patricia(better)
    for batch in batches:
        for text, owner, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            trie.add(text, owner, n)
            if trie.bytes > budget:
                yield from packed(trie.spill(budget // 2))
    yield from packed(trie.terminals())


def owners(docs: DataFrame, smallest: bool = True, normalise: Column | None = None, budget: int = BUDGET) -> DataFrame:
    """One row per distinct text: length (bytes), digest (sha256), owner (the doc_id that stays), n_rows."""
    text = F.coalesce(F.col("text") if normalise is None else normalise, F.lit("")).cast("binary")
    rows = docs.select(text.alias("text"), F.col("doc_id").alias("owner"), F.lit(1).cast("long").alias("n_rows"))
    mine = rows.mapInArrow(lambda b: _owners(b, smallest, budget, True), "text binary, length long, digest binary, owner long, n_rows long")
    met = mine.withColumn("content", F.xxhash64("text")).repartition("length", "content").select("text", "owner", "n_rows")
    own = met.mapInArrow(lambda b: _owners(b, smallest, budget, False), "length long, digest binary, owner long, n_rows long")
    best = F.min("owner") if smallest else F.max("owner")
    return own.groupBy("length", "digest").agg(best.alias("owner"), F.sum("n_rows").alias("n_rows"))


def members(docs: DataFrame, smallest: bool = True, normalise: Column | None = None, carry: list[str] | None = None, budget: int = BUDGET) -> DataFrame:
    """Each row of ``docs`` with keep_id, group_size, kept and text_sha256; ``carry`` names the columns kept beside doc_id.

    The join on the digest is left to skew handling: a group's owner is one row, its copies are split.
    Rows that repeat in doc_id and text are numbered in one task; a table whose doc_ids are distinct has none.
    """
    text = F.coalesce(F.col("text") if normalise is None else normalise, F.lit("")).cast("binary")
    inside = [shared.column(c).alias(f"_carry_{i}") for i, c in enumerate(carry or [])]
    rows = docs.select("doc_id", *inside, F.unhex(F.sha2(text, 256)).alias("_digest"))
    again = F.row_number().over(Window.partitionBy("_digest", "doc_id").orderBy(*(f"_carry_{i}" for i in range(len(inside))), F.lit(0)))
    own = owners(docs, smallest, normalise, budget).select(F.col("digest").alias("_digest"), F.col("owner").alias("keep_id"), F.col("n_rows").alias("group_size"))
    joined = rows.withColumn("_again", again).join(own, "_digest")
    return joined.select(
        "doc_id",
        *(F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry or [])),
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_again") == 1)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, smallest: bool = True, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are named.

    The texts of the rows are not shuffled again: what goes is a narrow list, sent to all tasks if
    it has at most ``broadcast_rows`` rows and joined otherwise. Of rows that repeat in doc_id and
    text one stays, any one of them.
    """
    found = shared.materialize(members(docs, smallest).select("doc_id", "keep_id", "text_sha256"), "members")
    # Structs hold the row and its key, so no column name can clash.
    rows = docs.select(F.struct("*").alias("_row"), F.struct("doc_id", F.sha2(shared.text_or_empty().cast("binary"), 256).alias("sha")).alias("_at"))

    def without(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        listed = F.broadcast(listed) if listed.count() <= broadcast_rows else listed
        return rows.join(listed, rows._at.doc_id.eqNullSafe(listed._gone.doc_id) & (rows._at.sha == listed._gone.sha), how)

    pair = F.struct("doc_id", F.col("text_sha256").alias("sha")).alias("_gone")
    gone = shared.materialize(found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(pair).distinct(), "gone")
    out = without(rows, gone, "left_anti")
    again = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "text_sha256").count().where("count > 1").select(pair)
    again = shared.materialize(again, "repeated")
    if not again.isEmpty():
        once = without(out, again, "left_semi").dropDuplicates(["_at"])
        out = without(out, again, "left_anti").union(once)
    return out.select("_row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(shared.documents(spark, sf_dir), smallest=False)


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
