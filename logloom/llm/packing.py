"""Packing by first-fit decreasing, with a tournament tree of bin capacities.

A document's ids (with the end id) are cut into pieces of ``seq_len`` and a rest. Documents are
dealt into randomised groups of about ``group_pieces`` pieces; inside a group pieces go, longest
first, to the first sequence with room, found in a tournament tree whose nodes hold the largest
room below them. A piece of ``seq_len`` fills a sequence by itself.

A document's group is a hash of its doc_id and ids, so a second run or another layout of the files
gives the same sequences.

Cases: null text is empty text (one piece of one id); null and repeated doc_ids are dealt like any
others, and of rows that repeat in doc_id and text each task numbers its own, so that they spread over
groups; ties of length go by doc_id, start and crc32; an empty table gives an empty table; further
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .tokenizing import encoded

PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class FirstFit:
    """Bins of one capacity; ``place`` puts a length into the first bin with room, in log2(bins) steps."""

    def __init__(self, capacity: int, bins: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.capacity, self.room = capacity, [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it. There must be a bin for each call."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < length:
                k += 1
        at = self.capacity - room[k]
        room[k] -= length
        found = k - self.leaves
        while k > 1:
            k //= 2
            best = max(room[2 * k], room[2 * k + 1])
            if room[k] == best:
                break
            room[k] = best
        return found, at


def pieces(docs: DataFrame, tokenizer: str, seq_len: int = 1024, end_id: int = 0, seed: int = 1, with_ids: bool = False, window: Column | None = None) -> DataFrame:
    """Pieces of the encoded ``docs``: doc_id, start, length, ids_crc32, doc_tokens, deal (the random number of the group), window and, if asked for, ids (binary).

    ``window`` is an integer: documents of different windows never meet in a sequence, and sequence_ids
    go up with it, so an order of the documents (a mix of sources) survives packing at that grain.
    """
    import xxhash

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("deal", pa.int64()), ("window", pa.int32())]
    fields += [("ids", pa.binary())] if with_ids else []

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*rows), fields, strict=True)], names=[k for k, _ in fields])

    def cut(batches):
        out: list[tuple] = []
        met: dict[int, int] = {}
        for (doc_id, own), ids in encoded(batches, tokenizer, end_id):
            deal = xxhash.xxh64_intdigest(struct.pack("<?qQ", doc_id is None, doc_id or 0, xxhash.xxh64_intdigest(ids)), seed)
            again = met[deal] = met.get(deal, -1) + 1
            deal = xxhash.xxh64_intdigest(struct.pack("<Qq", deal, again), seed) >> 1
            n, view = len(ids) // 4, memoryview(ids)
            for start in range(0, n, seq_len):
                part = view[4 * start : 4 * (start + seq_len)]
                out.append((doc_id, start, len(part) // 4, zlib.crc32(part), n, deal, own, *([bytes(part)] if with_ids else [])))
            if len(out) >= 4096:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    window = F.lit(0) if window is None else F.coalesce(window, F.lit(0))
    rows = docs.select("doc_id", window.cast("int").alias("window"), shared.text_or_empty().alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long, window int" + ", ids binary" * with_ids)


def pack(cut: DataFrame, seq_len: int = 1024, group_pieces: int = 16384) -> DataFrame:
    """Give each of the ``pieces`` its sequence_id and offset; further columns (ids) stay with their piece.

    Without ids only about 60 bytes a piece are shuffled. A group is one task's rows and of bounded size.
    """
    cut = shared.materialize(cut, "pieces")
    size = cut.agg(F.count("*").alias("n"), F.coalesce(F.countDistinct("window"), F.lit(0)).alias("windows")).first()
    groups = max(1, -(-size.n // (group_pieces * max(1, size.windows))))
    names = [c for c in cut.columns if c not in ("deal", "window")]

    def fill(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_pylist()
        bins, base = FirstFit(seq_len, len(lengths)), (key[0].as_py() * groups + key[1].as_py()) << 32
        # Pieces of seq_len come first, each into the next bin, as first fit would.
        placed = [bins.place(n) for n in lengths]
        table = table.select(names)
        table = table.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64()))
        return table.append_column("offset", pa.array([at for _, at in placed], pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    grouped = cut.withColumn("group", F.pmod("deal", F.lit(groups)).cast("int")).groupBy("window", "group")
    return grouped.applyInArrow(fill, schema + ", sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(pieces(shared.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
