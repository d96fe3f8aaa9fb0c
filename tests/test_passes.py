import pytest

from logloom.operators import parse
from logloom.plans import log_queries


@pytest.mark.parametrize("name,passes", [("log_blocks", 1), ("log_calls", 1), ("log_edits", 1), ("log_reads", 1), ("log_unknown_types", 1), ("log_meta", 2)])
def test_lines_are_parsed_once(spark, name, passes):
    """Each derived table reads the lines in one pass, and no filter parses a line again; metadata takes one for lines and one for calls."""
    plan = getattr(log_queries, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") - plan.count("parseJson(invoke(StructsToJson") == passes


def test_results_go_to_the_latest_call_before_them(spark):
    use = lambda i: '{"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "%s", "name": "Task", "input": {}}]}}' % i
    said = lambda i, x: '{"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "%s", "content": "%s"}]}}' % (i, x)
    log = [said("a", "early"), use("a"), said("a", "one"), said("a", "two"), " ﻿" + use("a") + "\xa0", use("b"), said("b", "three"), "[1]", "no", " ", said("c", "none")]
    lines = parse.lines(spark.createDataFrame([("s", n, x) for n, x in enumerate(log)], "session_id string, line_no int, line string"))
    assert [r.status for r in lines.orderBy("line_no").collect()[-4:]] == ["not_an_object", "malformed", "blank", "record"]
    calls = parse.calls(parse.blocks(parse.records(lines)))
    assert [(r.call_seq, r.tool_use_id, r.result and r.result.text) for r in calls.orderBy("call_seq").collect()] == [(0, "a", "two"), (1, "a", None), (2, "b", "three")]
    meta = parse.session_meta(lines, calls).first()
    assert (meta.records, meta.lines, meta.blank, meta.malformed, meta.not_an_object, meta.calls, meta.last_stop, meta.has_file_edits) == (8, 11, 1, 1, 1, 3, -1, True)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_log_are_made_once(spark):
    assert "Filter (size(" not in _plan(log_queries.lines(spark, "/root/testdata/sf0.001"))


def test_returned_states_read_their_log_once(spark):
    """The calls are written once, and files share batches, also where a file goes on in the next batch."""
    import random

    from logloom.operators import contents

    found = log_queries.log_returned_states(spark, "/root/testdata/sf0.001")
    assert "StructsToJson" not in _plan(found) and "FlatMapGroupsInArrow" not in _plan(found)
    rng, steps = random.Random(5), []
    for k in range(300):
        name = rng.choice(["Read", "Write", "Edit", "Edit"])
        text = rng.choice(["a", "b", "ab ", "c"])
        steps.append((rng.choice(["s", "t", None]), rng.choice(["f", "g", "h"]), k // 2, k, name, text if name == "Read" else None, text if name == "Write" else None, [rng.choice("abc")] if name == "Edit" else None, [rng.choice("abc")] if name == "Edit" else None, k % 2 == 0))
    table = spark.createDataFrame(steps, contents.STEPS)
    names = [f.name for f in table.schema]
    want = set()
    for key in {x[:2] for x in steps}:
        want |= {(*key, c["record_index"], c["call_seq"]) for c in contents.returns([dict(zip(names, x, strict=True)) for x in steps if x[:2] == key])}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [tuple(r) for r in contents.returned(table).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(want) > 10 and set(got) == want


def test_a_graph_reads_its_records_once(spark):
    from pyspark.sql import functions as F

    from logloom.operators import graph

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    recs = spark.range(50).select(counted.asNondeterministic()(F.lit("s")).alias("session_id"), F.col("id").cast("int").alias("record_index"), F.concat(F.lit("u"), "id").alias("uuid"), F.concat(F.lit("u"), F.col("id") - 1).alias("parent"), F.lit(False).alias("is_sidechain"))
    assert graph.graph(recs).where("on_main").count() == 50 and seen.value == 50


def test_equal_blobs_are_not_paired(spark):
    import time

    from pyspark.sql import functions as F

    from logloom.operators import commits

    rows = lambda who, n: spark.range(400_000).select(F.concat(F.lit("x"), F.col("id") % n).alias(who), F.lit("f").alias("file"), F.when(F.col("id") % 2 == 0, "000").otherwise("b").alias("blob"))
    began = time.perf_counter()
    assert commits.moved_blobs(rows("sha", 3), rows("session_id", 50_000)).count() == 150_000
    assert time.perf_counter() - began < 30


def test_pairs_are_counted_in_one_pass_over_the_log(spark, monkeypatch):
    kept = []
    keep = log_queries.keep
    monkeypatch.setattr("logloom.plans.analyze.keep", lambda df, name, **k: kept.append(name) or keep(df, name, **k))
    monkeypatch.setattr(log_queries, "keep", lambda df, name, **k: kept.append(name) or keep(df, name, **k))
    found = log_queries.log_too_many_pairs(spark, "/root/testdata/sf0.001")
    assert kept == ["calls"] and "StructsToJson" not in _plan(found)


def test_written_lines_are_as_many_files_as_tasks(spark, monkeypatch):
    from logloom.plans import table_queries
    from logloom.sources import logs

    files = []
    read = logs.read_lines

    def seen(spark, place, glob):
        files.append(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(place).inputFiles())
        return read(spark, place, glob)

    monkeypatch.setattr(table_queries.logs, "read_lines", seen)
    lines = table_queries.written_lines(spark, "/root/testdata/sf0.001")
    users = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct().count()
    assert len(files[0]) <= max(4, spark.sparkContext.defaultParallelism) < users == lines.where("line_no = 0").count()


def test_parsed_lines_are_kept_without_their_text(spark):
    from logloom.plans import analyze

    s = analyze.parsed(spark.createDataFrame([("s", 0, '{"type": "user"}'), ("s", 1, "no")], "session_id string, line_no int, line string"))
    assert "line" not in s.numbered.columns and {r.status for r in s.numbered.collect()} == {"record", "malformed"}
