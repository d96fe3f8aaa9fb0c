"""Budgets of sessions, spent in order."""

import json
import random

from pyspark.sql import functions as F

from logloom.operators import budget, parse


def plain(costs, most):
    left, out = most, []
    for place, cost in costs:
        if cost > left:
            out.append(place)
        else:
            left -= cost
    return out


def test_refused_rows_are_those_of_a_walk_in_order(spark):
    rng, rows = random.Random(5), []
    for s in range(30):
        rows += [(f"s{s}" if s else None, k, rng.choice([0, 1, 5, 30, None])) for k in range(rng.randrange(1, 60))]
    table = spark.createDataFrame(rows, "session_id string, line_no int, cost int").repartition(5)
    got = sorted((str(r.session_id), r.line_no) for r in budget.refused(table, "session_id", "line_no", "cost", 100).collect())
    by = {}
    for s, k, c in rows:
        by.setdefault(s, []).append((k, c or 0))
    assert got == sorted((str(s), k) for s, costs in by.items() for k in plain(costs, 100)) and got


def structures(line):
    keys = sum(line[:k].rstrip(" \t\r").endswith('"') for k, c in enumerate(line) if c == ":")
    return 3 * (line.count("{") + line.count("[")) + keys + line.count(",") // 3


def test_what_a_line_costs(spark):
    lines = ["", "x", '{"a": [1,2,3,4], "b" : {"c":":"}}', "::", '"a"\t:1,,,', json.dumps({"a": [{}] * 5})]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", budget.structures(F.col("line")).alias("n")).collect()
    assert {r.line: r.n for r in got} == {x: structures(x) for x in lines}


def test_a_session_past_its_budget_keeps_what_is_paid_for(spark):
    line = json.dumps({"type": "user", "uuid": "u", "message": {"content": "x"}})
    rows = [("s", k, line if k != 2 else json.dumps({"type": "user", "x": [{}] * 50})) for k in range(8)] + [("t", 0, line), ("t", 1, " ")]
    table = spark.createDataFrame(rows, "session_id string, line_no int, line string")
    most = 5 * structures(line)
    marked = budget.parseable(table, most)
    got = {(r.session_id, r.line_no): (r.status, r.oversize, r.record_index) for r in parse.lines(marked).collect()}
    want = {("s", k): ("record", False, k if k < 2 else k - 1) for k in (0, 1, 3, 4, 5)} | {("s", k): ("malformed", True, None) for k in (2, 6, 7)} | {("t", 0): ("record", False, 0), ("t", 1): ("blank", False, None)}
    assert got == want
    assert [r.refused for r in budget.parseable(table).collect()] == [False] * 10
