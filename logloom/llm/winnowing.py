"""Document fingerprints by winnowing.

Every ``k``-gram of code points has a rolling hash; each window of ``window`` hashes selects its
least, the rightmost one on ties, and a selected (hash, position) is recorded once. Any passage of
``k + window - 1`` code points that two texts share leaves a common fingerprint in both, and the
positions, which the result holds beside the hashes, say where. A text with fewer k-grams than a window is one window; one shorter than ``k``
is hashed whole.

Cases: null text is empty, with an empty fingerprint; likeness of two empty ones is 1; rows are in
ascending doc_id order, nulls first, then by text, so repeated rows follow each other; the next
document of the last is the first, of a single row itself; an empty table gives an empty table;
further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .words import mix, powers

K, WINDOW = 20, 40


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all k-grams of code points, from a cumulative polynomial."""
    n = len(points) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    up, down = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * up[: len(points)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n]) >> np.uint64(32)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions (code points) of the recorded fingerprints, by position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    hashes = gram_hashes(points, min(k, len(points))) if len(points) else points
    n = len(hashes)
    if not n:
        return hashes, np.zeros(0, np.int64)
    # The position counts down in the low bits, so that the least value is the rightmost of equal hashes.
    value = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    if n <= window:
        least = value.min(keepdims=True)
    else:
        # Sliding minimum from the running minima of blocks, forwards and backwards.
        padded = np.full(-(-n // window) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:n] = value
        grid = padded.reshape(-1, window)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        mins = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
        least = mins[np.concatenate([[True], mins[1:] != mins[:-1]])]
    return least >> np.uint64(32), (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)


def digest(hashes: np.ndarray) -> str:
    """A fingerprint as text: its distinct hashes in order, as base64 of 32-bit numbers."""
    return base64.b64encode(np.unique(hashes).astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the common part over the sum of the sizes, for distinct sorted hashes."""
    if not len(a) and not len(b):
        return 1.0
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id and the recorded (hash, position) pairs of each text, without a shuffle."""

    def emit(batches):
        for batch in batches:
            found = [winnow(t, k, window) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))],
                names=["doc_id", "hashes", "positions"],
            )

    return docs.select("doc_id", shared.text_or_empty().alias("text")).mapInArrow(emit, "doc_id long, hashes array<long>, positions array<long>")


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, hashes array<long>, positions array<long>"
_NAMES = [x.split()[0] for x in ROW.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def compare(row: tuple, following: tuple) -> tuple:
    """A row of the result from (doc_id, text, distinct hashes, recorded hashes, their positions) and the next such document."""
    doc_id, text, own, hashes, positions = row
    _, other, others, *_ = following
    n = len(text) // 4
    edited = text[: len(text) - n] + other[:n] if n else text
    new = np.unique(winnow(edited)[0]) if edited != text else own
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(own), digest(new), likeness(own, new), likeness(own, others), hashes.astype(np.int64), positions


def _bucket(bounds: list[int]) -> Column:
    """Number of ``bounds`` below doc_id, by halving; null ids are in bucket 0."""
    steps = max(1, len(bounds).bit_length())
    padded = F.array(*(F.lit(int(b)).cast("long") for b in bounds), *([F.lit((1 << 63) - 1).cast("long")] * ((1 << steps) - len(bounds))))
    halves = F.array(*(F.lit(1 << (steps - 1 - s)) for s in range(steps)))
    least = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    return F.aggregate(halves, F.lit(0), lambda lo, half: F.when(F.element_at(padded, (lo + half).cast("int")) < least, lo + half).otherwise(lo))


def compare_edited(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each text's fingerprint against that of its edited text and of the next document.

    Ranges of doc_id (buckets) are cut at approximate quantiles. Texts are shuffled once, by bucket;
    a task pairs the rows of a bucket as they pass in order, and for the bucket's last row a copy of
    the next bucket's first row is added to the bucket. Those copies are as many as the buckets.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", shared.text_or_empty().alias("text"))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # An error of a hundredth of a bucket; the bounds are as many numbers as there are buckets.
    cuts = docs.select(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)] or [0.5], 100 * buckets)).first()[0] or []
    bucket = _bucket(sorted(set(cuts)))
    firsts = docs.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).orderBy("bucket").collect()
    # The first row of each bucket, where nulls and then texts are in order.
    heads = [(None if r.nulls else r.least) for r in firsts]
    known = [h for h in heads if h is not None]
    head = F.col("doc_id").isin(known) if known else F.lit(False)
    head = (head | F.col("doc_id").isNull()) if None in heads else head
    order = {r.bucket: firsts[k - 1].bucket for k, r in enumerate(firsts)}  # the bucket before
    before = F.create_map(*(F.lit(x) for pair in order.items() for x in pair)) if order else F.lit(None).cast("map<int,int>")
    copies = rows.where(head).withColumn("bucket", bucket).groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    copies = copies.select("doc_id", "text", F.element_at(before, F.col("bucket")).alias("bucket"), F.lit(1).alias("copy"))
    dealt = rows.select("doc_id", "text", bucket.alias("bucket"), F.lit(0).alias("copy")).union(copies)
    # The single sort key for the place of rows: a copy comes after all rows of its bucket.
    ordered = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "copy", "doc_id", "text").select("bucket", "copy", "doc_id", "text")

    def pair(batches):
        held = None
        for batch in batches:
            out = []
            for _, copy, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                recorded = winnow(text)
                row = (doc_id, text, np.unique(recorded[0]), *recorded)
                if held is not None:
                    out.append(compare(held, row))
                held = None if copy else row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), _TYPES, strict=True)], names=_NAMES)
        if held is not None:
            raise ValueError("a bucket ends without the next bucket's first row")

    return ordered.mapInArrow(pair, ROW)


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(shared.documents(spark, sf_dir))
