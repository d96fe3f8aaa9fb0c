"""Incremental parse: of a log that grows, only what was added is read, parsed and numbered.

A record's index, a call's number and the call that a result belongs to depend on all lines before. That much is kept as state by session:
how many lines, records and calls there were, the last time, and the latest call of each call id (a map in the state store, on disk, whose
entries hold about ``BUCKET`` ids each, as every entry that is read or written costs a message). The
state operator is given a line's narrow facts, which Catalyst has parsed; it numbers them and passes the line on. What it appends never
changes later, so the tables below are those of ``operators.parse`` over the whole log, however it was cut into micro-batches.

Cases: lines of a session that share an offset are numbered in the order of their text; a null session is one session; blank and broken
lines are passed on with their status and no index; a result that comes before its call, or names an id that no call had, belongs to none.
A session's growth in one micro-batch is held by one task; sessions are spread over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..operators import parse

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TOTALS = StructType([StructField(k, LongType()) for k in ("lines", "records", "calls")] + [StructField("last_time", StringType())])
#: Calls of a session that the first entry of its map holds. The next twice as many calls are dealt over two entries by their id, then four times as many over four.
BUCKET = 64
_PLACE = StructType([StructField("age", IntegerType()), StructField("part", IntegerType())])
_SEQS = StructType([StructField("seqs", StringType())])  # an object of ids and numbers in JSON
NUMBERED = StructType(
    [StructField("session_id", StringType()), StructField("offset", LongType()), StructField("line", StringType()), StructField("status", StringType())]
    + [StructField(k, IntegerType()) for k in ("line_no", "record_index")]
    + [StructField("call_of", ArrayType(IntegerType())), StructField("filled_time", StringType())]
)


def age_of(seq: int) -> int:
    """The age of a call's number: ``BUCKET`` times 2^age calls are of one age."""
    return (seq // BUCKET + 1).bit_length() - 1


def place_of(name: str, age: int) -> tuple[int, int]:
    return age, crc32(name.encode()) % (1 << age)


class Numbering(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _TOTALS)
        self.calls = handle.getMapState("calls", _PLACE, _SEQS)

    def _held(self, place: tuple[int, int], cache: dict[tuple[int, int], dict[str, int]]) -> dict[str, int]:
        if place not in cache:
            cache[place] = json.loads(self.calls.getValue(place)[0]) if self.calls.containsKey(place) else {}
        return cache[place]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lines, records, calls, last = self.totals.get() or (0, 0, 0, None)
        found = sorted((r for frame in rows for r in frame[["offset", "line", "status", "time", "events"]].itertuples(index=False)), key=lambda r: (r.offset, r.line or ""))
        seen: dict[str, int] = {}
        before, cache = calls, {}
        out, size = [], 0
        for r in found:
            record = r.status == "record"
            last = r.time if isinstance(r.time, str) else last
            call_of: list[int | None] = []
            for e in r.events if record and r.events is not None else ():
                target = seen.get(e["id"])
                if e["uses"]:
                    target = seen[e["id"]] = calls
                    calls += 1
                elif target is None and before:
                    # The latest call of an id is the one of the latest age.
                    held = (self._held(place_of(e["id"], age), cache).get(e["id"]) for age in range(age_of(before - 1), -1, -1))
                    target = next((n for n in held if n is not None), None)
                call_of += [None] * (e["block"] - len(call_of)) + [target]
            out.append((key[0], r.offset, r.line, r.status, lines, records if record else None, call_of, last))
            lines, records, size = lines + 1, records + record, size + len(r.line or "")
            if size > 4 << 20:
                yield self._made(out)
                out, size = [], 0
        changed = set()
        for name, seq in seen.items():
            place = place_of(name, age_of(seq))
            self._held(place, cache)[name] = seq
            changed.add(place)
        for place in changed:
            self.calls.updateValue(place, (json.dumps(cache[place]),))
        self.totals.update((lines, records, calls, last))
        if out:
            yield self._made(out)

    def _made(self, rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=NUMBERED.names)
        for k in ("line_no", "record_index"):
            made[k] = made[k].astype("Int32")
        return made

    def close(self) -> None:
        pass


def numbered(stream: DataFrame) -> DataFrame:
    """Lines (session_id, offset, line) of a stream with their status, numbers, the calls that their results answer, and the last time up to them."""
    read = parse.read(stream)
    facts = read.select(F.col("session_id").cast("string"), "offset", "line", "status", parse.time_of().alias("time"), parse.call_events().alias("events"))
    return facts.groupBy("session_id").transformWithStateInPandas(Numbering(), NUMBERED, "Append", "None")


def follow(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the numbered lines of ``stream`` to the Parquet table at ``table``; ends when all that is there was read."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # several states in one operator need it; a query keeps what it starts with
    try:
        return numbered(stream).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def lines(spark: SparkSession, table: str) -> DataFrame:
    """What was appended so far, as ``parse.lines`` gives it: records come with their VARIANT and index."""
    return parse.read(spark.read.schema(NUMBERED).parquet(table).drop("status"))


def calls(appended: DataFrame) -> DataFrame:
    """The calls of appended lines with their last results, as ``parse.calls`` gives them; no session is gathered, a call's results meet by its number.

    Lines are read in one pass: the call that each block makes or answers is in their row.
    """
    of = F.get("call_of", F.col("block_index"))
    e = parse.call_rows(parse.blocks(parse.records(appended, "call_of")), of.alias("call_seq")).where("call_seq IS NOT NULL")
    own = Window.partitionBy("session_id", "call_seq").orderBy("record_index", "block_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return parse.with_arguments(parse.with_results(e, own))
