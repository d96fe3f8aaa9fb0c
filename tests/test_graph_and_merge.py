"""Walks by doubling against walks in order, and merges against a scan of all parents."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from logloom.operators import graph, order
from logloom.plans import queries

RECORDS = "session_id string, record_index int, uuid string, parent string, is_sidechain boolean"


def random_records(rng, session, n):
    """Chains, branches, repeated and missing uuids, unknown parents and cycles."""
    rows = []
    for k in range(n):
        own = rng.choice([f"u{k}", f"u{k}", f"u{k}", f"u{rng.randrange(n)}", None])
        up = rng.choice([f"u{k - 1}", f"u{k - 1}", f"u{rng.randrange(max(k, 1))}", f"u{rng.randrange(n)}", None, "gone"] if rng.random() < 0.5 else [f"u{k - 1}"])
        rows.append((session, k, own, up, rng.random() < 0.2))
    return rows


def test_doubling_walks_as_a_group_does(spark):
    rng, rows = random.Random(7), []
    for s in range(60):
        rows += random_records(rng, f"s{s}" if s else None, rng.randrange(1, 60))
    rows += [("long", k, f"u{k}", f"u{k - 1}" if k % 400 else f"u{k - 800}", False) for k in range(1500)]
    rows += [("ring", k, f"u{k}", f"u{(k + 1) % 300}", False) for k in range(300)] + [("side", 0, "a", None, True), ("bare", 0, None, None, False)]
    table = spark.createDataFrame(rows, RECORDS).repartition(4)
    plain = {(r.session_id, r.record_index): (r.uuid, r.on_main, r.abandoned) for r in graph.graph(table).collect()}
    split = {(r.session_id, r.record_index): (r.uuid, r.on_main, r.abandoned) for r in graph.graph(table, most=20).collect()}
    every = {(r.session_id, r.record_index): (r.uuid, r.on_main, r.abandoned) for r in graph.graph(table, most=0).collect()}
    assert len(plain) == len(rows) and plain == split == every
    assert sum(m for _, m, _ in plain.values()) > 500 and sum(a for *_, a in plain.values()) > 100
    assert graph.by_doubling(table.limit(0)).collect() == []


def plain_merge(parents, children):
    """Each child before the first parent behind its start that is late enough."""
    far, rows, filled = 1 << 62, [], None
    bounds = []
    for seq, at in parents:
        filled = at if at is not None else filled
        bounds.append((seq, far if filled is None else filled))
        rows.append(((seq, 1, 0, 0, "", seq), (None, seq)))
    for stream, (start, start_at, times) in children.items():
        filled, most = None, None
        for seq, at in enumerate(times):
            filled = at if at is not None else filled
            now = filled if filled is not None else start_at if start_at is not None else 0
            most = now if most is None else max(most, now)
            place = next((s for s, b in bounds if s > start and b >= most), far)
            rows.append(((place, 0, most, start, stream, seq), (stream, seq)))
    return [r for _, r in sorted(rows)]


def test_merge_equals_a_scan_of_all_parents(spark):
    rng, parents, children, want = random.Random(3), [], [], {}
    for s in range(40):
        clock, own = 0, []
        for seq in range(rng.randrange(1, 40)):
            clock = max(0, clock + rng.choice([1, 2, 5, 5, -20 if s % 2 else 3]))  # half of the clocks go back now and then
            own.append((seq, rng.choice([clock, clock, None])))
        streams = {}
        for name in "abc"[: rng.randrange(4)]:
            start, t, times = rng.randrange(-1, len(own) + 1), rng.randrange(60), []
            for _ in range(rng.randrange(1, 12)):
                t = max(0, t + rng.choice([0, 1, 4, -3]))
                times.append(rng.choice([t, t, None]))
            streams[name] = (start, rng.choice([None, t]), times)
        want[s] = plain_merge(own, streams)
        parents += [(s, seq, at) for seq, at in own]
        children += [(s, name, seq, at, start, start_at) for name, (start, start_at, times) in streams.items() for seq, at in enumerate(times)]
    p, c = spark.createDataFrame(parents, "session_id long, seq int, at long"), spark.createDataFrame(children, "session_id long, stream string, seq int, at long, start_seq int, start_at long")
    merged = order.merge_streams(p, c)
    got = {}
    for r in merged.orderBy("session_id", "record_index").collect():
        got.setdefault(r.session_id, []).append((r.stream, r.seq))
    assert got == want and dict(merged.dtypes)["session_id"] == "bigint"
    assert order.merge_streams(p, c.limit(0)).count() == len(parents)


PARENT, CHILD = "session_id long, seq int, at long", "session_id long, stream string, seq int, at long, start_seq int, start_at long"


def test_merge_makes_each_side_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    p = spark.createDataFrame([(s, k, 10 - k if s % 2 else k) for s in range(6) for k in range(9)], PARENT).mapInArrow(counted, PARENT)
    c = spark.createDataFrame([(s, "a", k, 3 + k, 4, 3) for s in range(6) for k in range(5)], CHILD).mapInArrow(counted, CHILD)
    assert len(order.merge_streams(p, c).collect()) == made.value == 6 * 14


def test_timeline_exchanges_each_side_once(spark, capsys):
    """By session each side and the merged rows; so few orders are broadcast."""
    queries.queries()["merge_timeline"](spark, "/root/testdata/sf0.001").explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 3


def test_merge_of_sides_dealt_alike_over_small_batches_and_partitions(spark):
    """Both sides come clustered by session and are of unlike size, so that Spark could join the small partitions of each by itself."""
    rng, parents, children, want = random.Random(5), [], [], {}
    for s in range(300):
        own = [(seq, rng.choice([rng.randrange(50), None])) for seq in range(rng.randrange(1, 4))]
        times = [rng.choice([rng.randrange(50), None]) for _ in range(rng.randrange(20, 40))]
        want[s] = plain_merge(own, {"a": (0, None, times)})
        parents += [(s, seq, at) for seq, at in own]
        children += [(s, "a", seq, at, 0, None) for seq, at in enumerate(times)]
    # Rows without a session are merged with nothing.
    parents, children = [*parents, (None, 0, 1), (None, 1, 90)], [*children, (None, "a", 0, 5, 0, None)]
    want[None] = [(None, 0), (None, 1), ("a", 0)]
    numbered = lambda rows, kinds: spark.createDataFrame(rows, kinds).withColumn("seq", (F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1).cast("int"))
    given = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        rows = order.merge_streams(numbered(parents, PARENT), numbered(children, CHILD)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {}
    for r in sorted(rows, key=lambda r: r.record_index):
        got.setdefault(r.session_id, []).append((r.stream, r.seq))
    assert got == want
