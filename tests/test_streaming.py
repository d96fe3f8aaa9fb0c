from pyspark.sql import functions as F

from logloom.streaming import sweep
from logloom.versions import Lock

from .build import Builder


def test_sweep_sees_only_what_changed(spark, tmp_path):
    logs, check = tmp_path / "logs", str(tmp_path / "check")
    logs.mkdir()
    got = []

    def emit(gated, signals, number):
        got.append((sorted(r.session_id for r in gated.collect()), {(r.session_id, r.category) for r in signals.collect()}))

    for name in ("one", "two"):
        s = Builder(name).padded(6)
        s.edit("src/b.py", "x", "y")
        (logs / f"{name}.jsonl").write_text("\n".join(s.lines()) + "\n")
        sweep.sweep(spark, str(logs), check, emit).awaitTermination()
    assert [x for x, _ in got] == [["one"], ["two"]]
    assert ("two", "unverified_fix") in got[1][1]


def test_one_sweep_at_a_time(spark, tmp_path):
    logs, check, got = tmp_path / "logs", f"file://{tmp_path}/check", []
    logs.mkdir()
    (logs / "one.jsonl").write_text("\n".join(Builder("one").padded(6).lines()) + "\n")
    other = Lock(spark, f"{check}-lock")
    assert other.take() and not sweep.sweep_alone(spark, str(logs), check, lambda *x: got.append(x)) and got == []
    other.release()
    assert sweep.sweep_alone(spark, str(logs), check, lambda *x: got.append(x)) and len(got) == 1 and other.take()


def test_activity_windows(spark):
    events = spark.createDataFrame([("s", 0), ("s", 10), ("s", 50), ("t", 0)], "session_id string, m int").select("session_id", (F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_interval(mins="m")).alias("ts"))
    got = sweep.activity_windows(events).orderBy("session_id", "since").collect()
    assert [(r.session_id, r.calls) for r in got] == [("s", 2), ("s", 1), ("t", 1)]


def test_new_signals(spark):
    signals = spark.createDataFrame([("s", "c", "f", 1, "u", "t"), ("s", "c", "g", 2, None, None)], "session_id string, category string, file_path string, record_index int, uuid string, tool_use_id string")
    none = spark.createDataFrame([], "session_id string, key string")
    fresh, shown = sweep.new_signals(signals, none)
    assert fresh.count() == 2
    again, _ = sweep.new_signals(signals, shown)
    assert again.count() == 0
