"""Compression of vectors to codes of a product quantiser, in integers throughout.

A vector's components become integers and are cut into equal consecutive parts. Each part position has
a codebook of at most ``entries`` rows, which starts from the vectors with the smallest ids. A round
assigns every part to its nearest entry and moves each entry to the floor of its parts' mean. Tasks hold
the codebooks as a broadcast (entries x dimension integers, whatever the table's size) and take Arrow
batches: |x - c|^2 = |x|^2 - 2 x.c + |c|^2, the products as int64 matrix products, the first smallest
wins. A task adds up what it reads, so a round's shuffle has a row per task, part, entry and position,
and one group for each of these; the sums come to the driver as the next codebooks.

Cases: a vector that is null or holds a null, a NaN or an infinity is left out; repeated ids are kept
and ordered among themselves by their components, null ids come last; with fewer vectors than
``entries`` there are as many entries as vectors; an empty table gives an empty table; null labels are
one label; further columns are ignored. An empty vector has the code of entry 0 throughout and error 0.
Vectors of different lengths, a length that ``parts`` doesn't divide, and components so large that a
squared distance may leave 64 bits are errors that say so; no result is ever rounded or wrapped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import shared

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Labels up to which the sums of labels are sent to all tasks instead of joined.
MOST_LABELS = 200_000


def _integers(vectors: pa.Array, scale: int, parts: int, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that are kept, and their components as a matrix of int64."""
    valid = np.asarray(vectors.is_valid())
    lengths = np.where(valid, np.asarray(vectors.value_lengths().fill_null(0)), 0).astype(np.int64)
    flat = vectors.flatten()  # without what null rows may span
    holes = np.asarray(flat.is_null())
    values = np.asarray(flat.cast(pa.float64()).fill_null(0.0))
    bad = np.concatenate([[0], np.cumsum(holes | ~np.isfinite(values))])
    ends = np.cumsum(lengths)
    rows = np.flatnonzero(valid & (bad[ends] == bad[ends - lengths]))
    if not len(rows):
        return rows, np.zeros((0, width or 0), np.int64)
    width = int(lengths[rows[0]]) if width is None else width
    if width % parts or (lengths[rows] != width).any():
        raise ValueError(f"vectors need one length that {parts} divides; found {sorted(set(lengths[rows].tolist()) | {width})[:5]}")
    x = values.reshape(len(rows), width) if len(rows) == len(lengths) else values[(ends - lengths)[rows][:, None] + np.arange(width)]
    x = np.floor(x * scale)
    # With |x|, |c| <= m, an error of the whole vector is at most width * (2m)^2.
    if x.size and np.abs(x).max() > (2.0**62 / width) ** 0.5 / 2:
        raise OverflowError(f"a component is too large for exact distances in 64 bits over {width} positions")
    return rows, x.astype(np.int64)


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of each row of ``x`` and its squared distance."""
    dots = x @ book.T
    from_entry = (book * book).sum(1) - 2 * dots
    code = from_entry.argmin(1)
    return code, from_entry[np.arange(len(x)), code] + (x * x).sum(1)


def _batches(batches, scale, parts, width):
    for batch in batches:
        # A batch has a row number limit of its own; pieces bound the matrices of wide vectors.
        for at in range(0, batch.num_rows, 4096):
            piece = batch.slice(at, 4096)
            rows, x = _integers(piece.column(0), scale, parts, width)
            if len(rows):
                yield piece, rows, x


def first_books(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """Codebooks (part, entry, position) from the vectors with the smallest ids: at most ``entries`` rows come to the driver."""

    def kept(batches):
        shared.own_worker("vector-codes")
        for piece, rows, x in _batches(batches, scale, parts, None):
            width = x.shape[1]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column(1).take(pa.array(rows)), values], names=["vec_id", "x"])

    schema = StructType([rows.select("vec_id").schema.fields[0], StructField("x", ArrayType(LongType()))])
    found = rows.select("embedding", "vec_id").mapInArrow(kept, schema)
    first = [r.x for r in found.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    if len({len(x) for x in first}) > 1:
        raise ValueError(f"vectors need one length that {parts} divides")
    width = len(first[0]) if first else 0
    return np.array(first, np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)


def _round(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one assignment of every part."""
    parts, entries, wide = books.shape
    held = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches):
        shared.own_worker("vector-codes")
        books = held.value
        total, n = np.zeros((parts, entries, wide), object), np.zeros((parts, entries), np.int64)
        for _, rows, x in _batches(batches, scale, parts, parts * wide):
            x = x.reshape(len(rows), parts, wide)
            for p in range(parts):
                code, _ = _nearest(x[:, p], books[p])
                n[p] += np.bincount(code, minlength=entries)
                order = np.argsort(code, kind="stable")
                used, starts = np.unique(code[order], return_index=True)
                # A piece's sums fit 64 bits, a task's may not: these are Python integers.
                total[p, used] += np.add.reduceat(x[order, p], starts, axis=0).astype(object)
        p, e = np.nonzero(n)
        if len(p):
            at = np.repeat(np.arange(len(p)), wide)
            columns = [np.repeat(p, wide), np.repeat(e, wide), np.tile(np.arange(wide), len(p))]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int32()) for c in columns), pa.array(total[p, e].ravel().tolist(), pa.decimal128(38, 0)), pa.array(n[p, e][at], pa.int64())],
                names=["part", "entry", "position", "total", "n"],
            )

    mine = rows.select("embedding").mapInArrow(sums, "part int, entry int, position int, total decimal(38,0), n long")
    merged = mine.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    moved = books.copy()
    for r in merged.collect():  # a row per component of the codebooks
        moved[r.part, r.entry, r.position] = int(r.total) // r.n
    held.unpersist()
    return moved


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (part, entry, position) over all rows (vec_id, embedding); no vectors give no entries."""
    books = first_books(rows, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        books = _round(rows, books, scale)
    return books


def encode(rows: DataFrame, books: np.ndarray, carry: list[str], scale: int = SCALE) -> DataFrame:
    """``carry`` columns of each kept row, its code (two hex digits a part) and error."""
    parts, entries, wide = books.shape
    held = rows.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{k:02x}" for k in range(256)], "S2")

    def coded(batches):
        shared.own_worker("vector-codes")
        books = held.value
        for piece, rows, x in _batches(batches, scale, parts, parts * wide):
            x = x.reshape(len(rows), parts, wide)
            codes, error = np.zeros((len(rows), parts), np.int64), np.zeros(len(rows), np.int64)
            for p in range(parts):
                codes[:, p], away = _nearest(x[:, p], books[p])
                error += away
            text = np.ascontiguousarray(digits[codes]).view(f"S{2 * parts}").ravel().astype(f"U{2 * parts}")
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(piece.column(1 + i).take(at) for i in range(len(carry))), pa.array(text), pa.array(error)], names=[*names, "code", "error"])

    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")
    names = [f"_{i}" for i in range(len(carry))]
    if not entries:
        rows = rows.limit(0)
    rows = rows.select("embedding", *(shared.column(c).alias(n) for c, n in zip(carry, names, strict=True)))
    out = rows.mapInArrow(coded, StructType([*rows.schema.fields[1:], StructField("code", StringType()), StructField("error", LongType())]))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)), "code", "error")


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``approx``: the integer vector that each row's code stands for."""
    parts, _, wide = books.shape
    held = coded.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<long>")
    def approx(code: pd.Series) -> pd.Series:
        at = np.array([list(bytes.fromhex(c)) for c in code], np.int64).reshape(len(code), parts)
        return pd.Series(list(held.value[np.arange(parts), at].reshape(len(code), parts * wide)), dtype=object)

    return coded.withColumn("approx", approx("code"))


def books_digest(books: np.ndarray) -> str:
    """sha256 of all integers by part, entry and position, with commas between them."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows of a row's label. A hot label is summed in each task first and its rows are never gathered."""
    per = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    per = shared.materialize(per, "label-errors")
    per = F.broadcast(per) if per.count() <= MOST_LABELS else per
    return coded.join(per, coded["label"].eqNullSafe(per["_label"])).drop("_label")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept embedding's code under 16 codebooks of 64 entries after two rounds."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    books = train(rows)
    coded = shared.materialize(encode(rows, books, ["vec_id", "label"]), "codes")
    out = with_label_error(coded).withColumn("codebooks_sha256", F.lit(books_digest(books)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """The rounds are written out; each assigns by the least (distance, entry) over all entries of a part."""
    steps = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
x AS (
  SELECT r, (pos - 1) // (w // 16) AS part, (pos - 1) % (w // 16) AS k, v FROM (
    SELECT r, len(embedding) AS w, unnest(range(1, len(embedding) + 1)) AS pos, CAST(unnest([floor(256 * CAST(e AS DOUBLE)) for e in embedding]) AS BIGINT) AS v FROM kept)),
b0 AS (SELECT part, r AS entry, k, v FROM x WHERE r < 64)"""
    for n in range(3):
        steps += f""",
d{n} AS (SELECT r, part, entry, sum((x.v - b.v) * (x.v - b.v)) AS away FROM x JOIN b{n} b USING (part, k) GROUP BY r, part, entry),
a{n} AS (SELECT r, part, entry, away FROM (SELECT *, row_number() OVER (PARTITION BY r, part ORDER BY away, entry) AS best FROM d{n}) t WHERE best = 1)"""
        if n < 2:
            steps += f""",
m{n} AS (SELECT part, entry, k, sum(v) AS total, count(*) AS n FROM x JOIN a{n} USING (r, part) GROUP BY part, entry, k),
b{n + 1} AS (
  SELECT part, entry, k, CAST(CASE WHEN m.n IS NULL THEN b.v ELSE (m.total - ((m.total % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS v
  FROM b{n} b LEFT JOIN m{n} m USING (part, entry, k))"""
    return steps + """,
books AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, k)) AS codebooks_sha256 FROM b2),
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(away) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r) CROSS JOIN books"""


OP13_SQL = _oracle()
