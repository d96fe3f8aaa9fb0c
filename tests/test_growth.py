"""Logs that grow: the data source, and the incremental parse against the batch parse of the whole log."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.operators import parse
from logloom.sources import tail
from logloom.streaming import growth


@given(st.lists(st.sampled_from([b"a", b"b", b"\n", b"\r\n"]), max_size=60).map(b"".join), st.integers(1, 20), st.sampled_from([1, 2, 3, 7, 64]), st.booleans())
@settings(max_examples=400, deadline=None)
def test_every_line_begins_in_one_range(data, step, block, whole):
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".jsonl") as f, pytest.MonkeyPatch.context() as m:
        m.setattr(tail, "BLOCK", block)
        f.write(data)
        f.flush()
        found = [x for r in tail.ranges(f.name, 0, len(data), step, whole) for x in tail.lines_in(r)]
        at, want, parts = 0, [], data.split(b"\n")
        for k, x in enumerate(parts):
            want += [(at, x)] if k < len(parts) - 1 or (whole and x) else []
            at += len(x) + 1
        assert found == want and tail.last_end(f.name, 0, len(data)) == data.rfind(b"\n") + 1


def test_batch_reader(spark, tmp_path):
    (tmp_path / "x").mkdir()
    lines = [f"line {k} é " for k in range(3000)]
    (tmp_path / "x" / "a.jsonl").write_text("\r\n".join(lines) + "\r\nlast", encoding="utf-8", newline="")
    (tmp_path / "b.jsonl").write_bytes(b"\xff\n\n")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "e.jsonl").write_text("")
    got = tail.read(spark, str(tmp_path), range_bytes="1000")
    rows = got.orderBy("path", "offset").collect()
    assert [r.line for r in rows if r.path.endswith("a.jsonl")] == [*lines, "last"] and [r.line for r in rows if r.path.endswith("b.jsonl")] == ["�", ""]
    assert got.rdd.getNumPartitions() > 40 and "Exchange" not in got._jdf.queryExecution().toString()
    assert tail.read(spark, str(tmp_path / "none")).count() == 0


def record(rng, k):
    call = lambda: rng.choice(["", f"c{rng.randrange(6)}", f"c{rng.randrange(60)}"])
    blocks = [
        rng.choice([
            {"type": "tool_use", "id": call(), "name": rng.choice(["Bash", "Edit", ""]), "input": {"command": f"ls {k}", "file_path": f"f{k}"}}, {"type": "tool_result", "tool_use_id": call(), "content": f"said {k}", "is_error": rng.random() < 0.5},
            {"type": "text", "text": "hm"}, "loose", 7,
        ])
        for _ in range(rng.randrange(4))
    ]
    kind = rng.choice(["assistant", "user", "api-request", "martian"])
    return rng.choice([json.dumps({"type": kind, "uuid": f"u{k}", "timestamp": rng.choice([None, f"2026-01-01T00:00:{k % 60:02d}Z"]), "message": {"content": rng.choice([blocks, blocks, "said"])}}), json.dumps({"type": kind, "message": {"content": blocks}}), rng.choice(["", "  ", "{half", "[1]"])])


def test_appended_tables_equal_the_batch_parse_after_every_cut(spark, tmp_path):
    logs, rng = tmp_path / "logs", random.Random(11)
    logs.mkdir()
    table, check = f"file://{tmp_path}/table", f"file://{tmp_path}/check"
    whole = {f"s{n}": "".join(record(rng, k) + "\n" for k in range(rng.randrange(20, 60))).encode() for n in range(4)}
    written = dict.fromkeys(whole, 0)

    def own(df):
        return df.select(F.regexp_extract("path", r"([^/]+)\.jsonl\z", 1).alias("session_id"), "offset", "line")

    for step in range(4):
        for name, data in whole.items():
            to = len(data) if step == 3 else min(len(data), written[name] + rng.randrange(0, len(data) // 2))  # also inside of lines and records
            with (logs / f"{name}.jsonl").open("ab") as f:
                f.write(data[written[name] : to])
            written[name] = to
        growth.follow(own(tail.read_stream(spark, str(logs))), table, check).awaitTermination()
    grown = growth.lines(spark, table)
    assert len(spark.read.parquet(table).inputFiles()) > 4
    batch = parse.lines(own(tail.read(spark, str(logs))).withColumnRenamed("offset", "line_no"))
    pick = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    fields = ["session_id", "line", "status", "record_index"]
    assert pick(grown, *fields) == pick(batch, *fields)
    fields = ["session_id", "record_index", "type", "uuid", "parent", "ts_raw", "is_sidechain"]
    assert pick(parse.records(grown), *fields) == pick(parse.records(batch), *fields)
    fields = ["session_id", "record_index", "block_index", "call_seq", "tool_use_id", "name", "command", "file_path", "result", "counted"]
    want = pick(parse.calls(parse.blocks(parse.records(batch))), *fields)
    assert pick(growth.calls(grown), *fields) == want and any("said" in x for x in want)
    lines = sorted(grown.collect(), key=lambda r: (r.session_id, r.offset))
    filled, session = None, None
    for r in lines:
        filled = filled if r.session_id == session else None
        session = r.session_id
        said = json.loads(r.line).get("timestamp") if r.status == "record" else None
        filled = said or filled
        assert r.filled_time == filled


def test_small_files_share_a_task(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"s{k}.jsonl").write_text(f"first {k}\nlast {k}\n")
    got = tail.read(spark, str(tmp_path))
    assert got.count() == 600 and got.rdd.getNumPartitions() <= 60
    parts = tail.ranges("a", 0, 1000, 10, True) + [tail.Range("b", 0, 5, True)]
    assert [r for p in tail.packed(parts, 10) for r in p.parts] == parts and len(tail.packed(parts, 10)) == len(parts) and tail.packed([], 10) == []


class Held:
    """A state's value or map as the processor sees it, with the messages that it costs."""

    def __init__(self):
        self.rows, self.messages = {}, 0

    def get(self):
        return self.rows.get(None)

    def update(self, value):
        self.rows[None] = value

    def containsKey(self, key):
        self.messages += 1
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.messages += 1
        self.rows[key] = value


def test_call_ids_of_a_session_are_held_together():
    import pandas as pd

    processor, rng = growth.Numbering(), random.Random(5)
    processor.totals, processor.calls = Held(), Held()
    latest, calls, at = {}, 0, 0
    for _ in range(40):
        rows, want = [], []
        for _ in range(100):
            name, uses = f"c{rng.randrange(900)}é", rng.random() < 0.6
            if uses:
                latest[name], calls = calls, calls + 1
            rows.append((at, "{}", "record", None, [{"block": 1, "uses": uses, "id": name}]))
            want.append([None, latest.get(name)])
            at += 1
        out = pd.concat(processor.handleInputRows(("s",), iter([pd.DataFrame(rows, columns=["offset", "line", "status", "time", "events"])]), None))
        assert out["call_of"].tolist() == want
    assert calls > 2000 and max(len(json.loads(v[0])) for v in processor.calls.rows.values()) < 4 * growth.BUCKET
    few = growth.Numbering()
    few.totals, few.calls = Held(), Held()
    list(few.handleInputRows(("s",), iter([pd.DataFrame([(k, "{}", "record", None, [{"block": 0, "uses": True, "id": f"c{k}"}]) for k in range(60)], columns=["offset", "line", "status", "time", "events"])]), None))
    assert few.calls.messages == 2
