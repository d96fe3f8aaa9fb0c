"""Token-ID output by bit-plane shuffling.

File format: a Parquet table with a row per chunk. The ids of all documents, in ascending doc_id
order, form one stream; each range partition (a shard) cuts its part of the stream into blocks of
``block_ids`` ids (a shard's last block may be shorter), transposes a block into byte or bit planes
and compresses each plane with zstandard. The columns beside ``planes`` are the chunk index: the
place in the stream, the crc32 of the block, and the documents that start in the block. A reader
of the index alone never touches a plane.

Cases: null text is empty text (its one id is the end id); null doc_ids come first; rows that share
a doc_id are ordered by the xxhash64 of their text, then by text, and repeated rows are all kept; an
empty table gives an empty table; further columns of the input are ignored; a document may span any
number of blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .tokenizing import encoded

CHUNK_SCHEMA = (
    "shard int, chunk int, first_id long, n_ids int, mode string, planes array<binary>, ids_crc32 long, "
    "doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>"
)
_ARROW = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()), ("mode", pa.string()),
     ("planes", pa.list_(pa.binary())), ("ids_crc32", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
     ("doc_starts", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))]
)


def to_planes(ids: np.ndarray, mode: str, level: int = 3) -> list[bytes]:
    """zstandard frames of the planes of little-endian 32-bit ids: 4 of bytes or 32 of bits, lowest first."""
    import zstandard

    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        planes = np.ascontiguousarray(octets.T)
    elif mode == "bit":
        bits = np.unpackbits(octets, axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    else:
        raise ValueError(f"mode is byte or bit, not {mode}")
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int, mode: str) -> np.ndarray:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    width = n_ids if mode == "byte" else (n_ids + 7) // 8
    grid = np.frombuffer(b"".join(unpack(p, max_output_size=width) for p in planes), np.uint8).reshape(len(planes), width)
    if mode == "bit":
        grid = np.packbits(np.unpackbits(grid, axis=1, count=n_ids, bitorder="little").T, axis=1, bitorder="little")
        return np.ascontiguousarray(grid).view("<u4").ravel()
    return np.ascontiguousarray(grid.T).view("<u4").ravel()


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, block_ids: int = 65536, mode: str = "byte", level: int = 3) -> None:
    """Encode ``docs`` (doc_id, text) and write the format above to ``path``.

    One range shuffle of the texts by doc_id; a task holds one block and one document at a time.
    """
    from pyspark import TaskContext

    def write(batches):
        shard = TaskContext.get().partitionId()
        held, size, first, chunk, at = [], 0, 0, 0, 0
        names: list = []

        def block(ids: bytes):
            nonlocal first, chunk, names
            array = np.frombuffer(ids, "<u4")
            row = [[shard], [chunk], [first], [len(array)], [mode], [to_planes(array, mode, level)], [zlib.crc32(ids)], *([list(x)] for x in (zip(*names) if names else ([], [], [])))]
            first, chunk, names = first + len(array), chunk + 1, []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _ARROW.types, strict=True)], schema=_ARROW)

        for (doc_id,), ids in encoded(batches, tokenizer, end_id):
            names.append((doc_id, at, len(ids) // 4))
            at += len(ids) // 4
            held.append(ids)
            size += len(ids)
            if size >= 4 * block_ids:
                whole = b"".join(held)
                cut = size - size % (4 * block_ids)
                for i in range(0, cut, 4 * block_ids):
                    yield block(whole[i : i + 4 * block_ids])
                held, size = [whole[cut:]], size - cut
        if size:
            yield block(b"".join(held))

    rows = docs.select("doc_id", shared.text_or_empty().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(write, CHUNK_SCHEMA).write.mode("overwrite").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a written path: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array<long>).

    Only the compressed chunks are shuffled, by shard; without ids a document is never held whole.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    # One row a shard, of which there are as many as write tasks: small enough for a single window.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunks.groupBy("shard").agg(F.sum("n_ids").cast("long").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] if with_ids else []

    def read(batches):
        shard, queue, done, crc, parts = None, [], 0, 0, []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if queue:
                        raise ValueError(f"shard {shard} ends within a document")
                    shard, done, crc, parts = row["shard"], 0, 0, []
                ids = from_planes(row["planes"], row["n_ids"], row["mode"]).tobytes()
                if zlib.crc32(ids) != row["ids_crc32"]:
                    raise ValueError(f"shard {shard}, chunk {row['chunk']}: the block doesn't match its crc32")
                queue += list(zip(row["doc_ids"], row["doc_starts"], row["doc_tokens"], strict=True))
                lo, hi, k = row["first_id"], row["first_id"] + row["n_ids"], 0
                for doc_id, start, n in queue:
                    i, j = max(start + done, lo), min(start + n, hi)
                    piece = memoryview(ids)[4 * (i - lo) : 4 * (j - lo)]
                    crc, done = zlib.crc32(piece, crc), done + j - i
                    if with_ids:
                        parts.append(np.frombuffer(piece, "<u4"))
                    if done < n:
                        break
                    out.append((doc_id, row["base"] + start, n, crc, *([np.concatenate(parts).tolist()] if with_ids else [])))
                    done, crc, parts, k = 0, 0, [], k + 1
                del queue[:k]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*out) if out else [[]] * len(fields), fields, strict=True)], names=[k for k, _ in fields])

    rows = chunks.join(bases, "shard").repartition("shard").sortWithinPartitions("shard", "chunk")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and crc32, read back from the written blocks."""
    import public_tokenizers

    path = shared.new_path(spark, "ids")
    write_ids(shared.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_ids(spark, path)
