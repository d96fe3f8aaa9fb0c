"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of ``block_rows``. Block i of a source with weight w is
released at slot floor(i/w) and due by slot ceil((i+1)/w); of the released blocks the one with the
earliest deadline gets the next slot. With weights that sum to 1 no deadline is missed, so after any
number of slots each source is within one block of its share. When a source has no blocks left, a
new phase starts with the weights of the others, in proportion; nothing is dropped or repeated.

With integer weights that sum to W the schedule of a phase repeats after W slots. So one task makes
a single period of each phase (W rows, however large the sources are) and a document's slot follows
from its block's number by arithmetic. The size of a block is a parameter and never grows.

Cases: a null source is a source of its own (its name sorts first); weights must be positive
integers; a source that has none gets ``default_weight``, and without that it is an error, so that no
rows vanish; null and repeated doc_ids and repeated rows take places like any others; documents of a
source are ordered by a hash of doc_id and text; an empty table gives an empty table; all columns of
the input are kept, and those that are named like a place give way to it.
"""

from __future__ import annotations

import heapq
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

PLACES = ("source_block", "slot", "release", "deadline", "phase", "source_rank")
#: Target weights of the registered query and the pipeline: the three general sources four and two times the share of any other.
TARGETS, OTHERS = {"src0": 4, "src1": 2, "src2": 2}, 1
#: Rows of a small table that is sent to all tasks; a larger one is joined.
BROADCAST_ROWS = 500_000


def period(weights: dict) -> list[tuple]:
    """(source, its block in the period) of the sum(weights) slots of one period, earliest deadline first.

    A heap of waiting blocks and one of released ones give each slot in log2(sources) steps.
    """
    whole, out = sum(weights.values()), []
    names = list(weights)
    waiting = [(0, k, 0) for k in range(len(names))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in range(whole):
        while waiting and waiting[0][0] <= slot:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * whole // weights[names[k]]), k, i))
        _, k, i = heapq.heappop(ready)
        out.append((names[k], i))
        heapq.heappush(waiting, ((i + 1) * whole // weights[names[k]], k, i + 1))
    return out


def phases(blocks: dict, weights: dict):
    """(phase, first slot, weights, {source: blocks done before}, {source: blocks done in it}, period) of each phase."""
    left, done = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0)
    began = number = 0
    while left:
        shrink = gcd(*(weights[s] for s in left))
        own = {s: weights[s] // shrink for s in left}
        whole, order = sum(own.values()), period(own)
        places: dict = {s: [] for s in left}
        for at, (s, _) in enumerate(order):
            places[s].append(at)
        # The phase ends with the slot of the first source's last block.
        ends = min((left[s] - 1) // own[s] * whole + places[s][(left[s] - 1) % own[s]] for s in left) + 1
        turns, rest = divmod(ends, whole)
        made = {s: turns * own[s] + sum(at < rest for at in places[s]) for s in left}
        yield number, began, own, {s: done[s] for s in left}, made, order
        for s, n in made.items():
            done[s] += n
            left[s] -= n
        left, began, number = {s: n for s, n in left.items() if n}, began + ends, number + 1


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (_source, _key, _tie, _row) as (_source, _row, _rank), a row's place inside its source, and each source's rows (source, n). No source is put into one task.

    Rows are sorted over ranges of (source, hash), so a large source spans many tasks; a place is
    the row's place in its task less what comes before its source there, plus the source's rows in
    earlier tasks. That table has a row per task and source that meet, about as many as tasks.
    """
    rows = rows.repartitionByRange("_source", "_key").sortWithinPartitions("_source", "_key", "_tie").drop("_key", "_tie")
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.spark_partition_id())
    rows = shared.materialize(rows, "by-source")
    met = rows.groupBy("_task", "_source").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    met = met.select(F.col("_task").alias("_t"), F.col("_source").alias("_s"), "_first", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    met = shared.materialize(met, "met")
    joined = rows.join(_small(met.drop("_n")), (F.col("_task") == F.col("_t")) & F.col("_source").eqNullSafe(F.col("_s")))
    per_source = met.groupBy(F.col("_s").alias("source")).agg(F.sum("_n").alias("n"))
    return joined.select("_source", "_row", (F.col("_at") - F.col("_first") + F.col("_before")).alias("_rank")), per_source


def mix(docs: DataFrame, weights: dict | None = None, default_weight: int | None = OTHERS, block_rows: int = 8, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all by default) of ``docs`` (doc_id, text, source, ...) with source_block, slot, release, deadline, phase and source_rank.

    ``weights`` maps sources to positive integers (``TARGETS`` by default); a source that isn't in it gets ``default_weight``.
    Carried columns are shuffled once, by source; ranks and slots reach them through small tables.
    """
    weights = TARGETS if weights is None else weights
    carry = [c for c in carry or docs.columns if c not in PLACES]
    if bad := [s for s, w in [*weights.items(), ("others", default_weight or 1)] if w != int(w) or w < 1]:
        raise ValueError(f"weights are positive integers, unlike those of {bad[:5]}")
    keys = [F.col("source").alias("_source"), F.xxhash64("doc_id", "text").alias("_key"), F.xxhash64("text", F.lit(1)).alias("_tie")]
    ranked, per_source = _ranked(docs.select(F.struct(*(shared.column(c) for c in carry)).alias("_row"), *keys))

    def schedule(batches):
        found = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        found.sort(key=lambda r: (r[0] is not None, r[0] or ""))
        if missing := [s for s, _ in found if s not in weights and default_weight is None]:
            raise ValueError(f"sources without a weight: {missing[:5]}")
        own = {s: weights.get(s, default_weight) for s, _ in found}
        for phase, began, share, before, made, order in phases({s: -(-n // block_rows) for s, n in found}, own):
            whole, rows = len(order), []
            for at, (s, i) in enumerate(order):
                rows.append((s, i, at, phase, began, share[s], whole, before[s], before[s] + made[s]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    schema = "_s string, _in_period long, _place long, phase long, _began long, _weight long, _whole long, _from long, _to long"
    names, types = [x.split()[0] for x in schema.split(", ")], [pa.string(), *[pa.int64()] * 8]
    # One row a source: the only table that meets in one task.
    slots = _small(shared.materialize(per_source.coalesce(1).mapInArrow(schedule, schema), "periods"))
    spans = _small(shared.materialize(slots.select("_s", "phase", "_began", "_weight", "_whole", "_from", "_to").distinct(), "spans"))
    blocked = ranked.withColumn("source_block", F.floor(F.col("_rank") / F.lit(block_rows)))
    blocked = blocked.join(spans, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("source_block") >= F.col("_from")) & (F.col("source_block") < F.col("_to"))).drop("_s")
    blocked = blocked.withColumn("_i", F.col("source_block") - F.col("_from")).withColumn("_j", F.col("_i") % F.col("_weight"))
    place = slots.select("_s", F.col("phase").alias("_p"), "_in_period", "_place")
    joined = blocked.join(place, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("phase") == F.col("_p")) & (F.col("_j") == F.col("_in_period")))
    return joined.select(
        "_row.*",
        "source_block",
        (F.col("_began") + F.expr("_i div _weight") * F.col("_whole") + F.col("_place")).alias("slot"),
        F.expr("(_i * _whole) div _weight").alias("release"),
        F.expr("((_i + 1) * _whole + _weight - 1) div _weight").alias("deadline"),
        "phase",
        F.col("_rank").alias("source_rank"),
    )


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in the mix to ``TARGETS``. Texts decide the order inside a source but aren't carried; the pipeline's stage mixes whole rows."""
    return mix(shared.documents(spark, sf_dir), carry=["doc_id", "source"]).select("doc_id", "source", "source_rank", *PLACES[:-1])
