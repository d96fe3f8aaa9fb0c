"""Ordered and set operators: first-wins arg-max, forward fill, merges, differences."""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A place behind all records.
_FAR = 1 << 62


def keep_best(df: DataFrame, keys: list[str], weight: str = "weight", seq: str = "seq") -> DataFrame:
    """Of rows with equal keys the heaviest, of those the first, in the place (``seq``) of the first row with the key."""
    same = Window.partitionBy(*(F.coalesce(k, F.lit("")) if dict(df.dtypes)[k] == "string" else F.col(k) for k in keys))
    ranked = df.withColumn("_place", F.row_number().over(same.orderBy(F.desc(weight), seq))).withColumn("_first", F.min(seq).over(same))
    return ranked.where("_place = 1").withColumn(seq, F.col("_first")).drop("_place", "_first")


def dedupe(signals: DataFrame) -> DataFrame:
    """One signal per event, then one per file and detail. ``seq`` is the order in which they were made.

    A heavier signal takes the place of the first with its key, so of equal ones in the second pass that with the earliest key stays.
    """
    event = keep_best(signals, ["session_id", "category", "file_path", "record_index"])
    return keep_best(event, ["session_id", "category", "file_path", "detail"])


def forward_fill(df: DataFrame, column: str, by: list[str], order: list[str], out: str | None = None) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out or column, F.last(column, ignorenulls=True).over(w))


def _with_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``place`` of rows (session_id, at_seq, parent, m, place) that come a session at a time, by falling ``at_seq``, children before the parent there: a parent's own
    position, or the first parent behind a child's start whose bound is ``m`` or more.

    Of the parents behind, those whose bound no nearer one reaches form a stack; a child is a binary search in it. 16 bytes for each of them are held of one session.
    """
    last, behind, bounds = None, array("q"), array("q")  # the top is the nearest; bounds as their negatives, so that they rise and can be searched
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column("session_id")
        other = [ids[0].as_py() != last, *pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), True).to_numpy(zero_copy_only=False).tolist()]
        last, place = ids[-1].as_py(), []
        for new, at, parent, m in zip(other, *(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("at_seq", "parent", "m"))):
            if new:
                del behind[:], bounds[:]
            if parent:
                while bounds and bounds[-1] >= -m:
                    bounds.pop()
                    behind.pop()
                bounds.append(-m)
                behind.append(at)
                place.append(at)
            else:
                hit = bisect_right(bounds, -m)
                place.append(behind[hit - 1] if hit else _FAR)
        yield batch.set_column(batch.schema.get_field_index("place"), "place", pa.array(place, pa.int64()))


def merge_streams(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Records of a session and of its sub-agents in one order.

    ``parent`` has (session_id, seq, at), ``child`` also (stream, start_seq, start_at). Missing times
    are filled forward; a child goes before the first parent record after its call whose time is not
    before the child's running maximum, else to the end. One sort on (place, child first, that
    maximum, start, seq) is the merge.

    No parent is paired with a stream and no side is made twice: both are sorted together by session and falling position, and one pass over
    each task's sorted rows gives every child its place.
    """
    far = F.lit(_FAR).cast("long")
    by_seq = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A parent without a time so far bounds nothing: +infinity.
    p = parent.withColumn("m", F.coalesce(F.last("at", ignorenulls=True).over(by_seq), far))
    stream = Window.partitionBy("session_id", "stream").orderBy("seq")
    own = stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = child.withColumn("stream", F.col("stream").cast("string")).withColumn("filled", F.coalesce(F.last("at", ignorenulls=True).over(own), "start_at", F.lit(0)))
    c = c.withColumn("m", F.max("filled").over(own)).withColumn("at_seq", F.min("start_seq").over(stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # Without a start, or of no session, a child has no parent behind it.
    at_seq = F.when(F.col("session_id").isNotNull() & F.col("stream").isNotNull(), F.col("at_seq").cast("long"))
    one = p.select("session_id", F.lit(None).cast("string").alias("stream"), "seq", "at", F.col("seq").cast("long").alias("at_seq"), F.lit(True).alias("parent"), "m", F.lit(0).cast("long").alias("start_seq"))
    two = c.select("session_id", "stream", "seq", "at", F.coalesce(at_seq, far).alias("at_seq"), F.lit(False).alias("parent"), F.col("m").cast("long").alias("m"), F.col("start_seq").cast("long").alias("start_seq"))
    # The window, not a repartition, brings a session's rows together: over two sides that are dealt alike Spark leaves a repartition out, but may then join
    # each side's small partitions by itself, and a function over Arrow batches asks for nothing that would tell. The sort is the window's own.
    back = F.desc("at_seq")
    rows = one.union(two).withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(back, "parent")).cast("long")).sortWithinPartitions("session_id", back, "parent")
    placed = rows.mapInArrow(_with_place, T.StructType([T.StructField(c.name, c.dataType) for c in rows.schema]))
    order = Window.partitionBy("session_id").orderBy("place", "parent", "m", "start_seq", "stream", "seq")
    return placed.withColumn("record_index", F.row_number().over(order) - 1).select("session_id", "record_index", "stream", "seq", "at")


def lines_in_common(a: DataFrame, b: DataFrame, column: str = "line") -> DataFrame:
    return a.select(column).intersect(b.select(column))


def first_spelling(df: DataFrame, resolved: str, spelling: str, order: str) -> DataFrame:
    """Of several spellings of one path the first."""
    return df.groupBy(resolved).agg(F.min_by(spelling, order).alias(spelling))
