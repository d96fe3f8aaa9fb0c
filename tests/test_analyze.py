import json

import pytest

from logloom.operators import budget, detectors, parse, redact
from logloom.plans import analyze

from .build import Builder, table


def signals_of(spark, *sessions):
    gated, signals = analyze.detect(analyze.parsed(table(spark, *sessions)))
    found = {}
    for r in signals.collect():
        found.setdefault(r.session_id, []).append((r.category, r.file_path, r.record_index, r.weight, r.detail))
    return {r.session_id: r for r in gated.collect()}, found


@pytest.fixture(scope="module")
def found(spark):
    b = {}

    def new(name):
        b[name] = Builder(name).padded()
        return b[name]

    s = new("weakened")
    s.run("npm test", "1 failed", True)
    s.edit("src/a.test.ts", "expect(a).toBe(1)\nexpect(b).toBe(2)", "expect(a).toBe(1)")
    s = new("weakened_calm")
    s.edit("src/a.test.ts", "expect(a).toBe(1)\nexpect(b).toBe(2)", "expect(a).toBe(1)")
    s = new("strengthened")
    s.edit("src/a.test.ts", "expect(a).toBe(1)", "expect(a).toBe(1)\nexpect(b).toBe(2)")
    s = new("returned")
    s.result(s.use("Write", file_path="src/a.py", content="one\n"))
    s.result(s.use("Write", file_path="src/a.py", content="two\n"))
    s.result(s.use("Write", file_path="src/a.py", content="one  \n\n"))
    s = new("reverted")
    s.edit("src/b.py", "x = 1", "x = 2")
    s.edit("src/b.py", "x = 2", "x = 1")
    s = new("discarded")
    s.edit("src/b.py", "x = 1", "x = 2")
    s.edit("src/c.py", "x = 1", "x = 2")
    s.run("git reset --hard")
    s = new("one_discarded")
    s.edit("src/b.py", "x = 1", "x = 2")
    s.run("git checkout -- src/b.py")
    s = new("stash_pop")
    s.edit("src/b.py", "x = 1", "x = 2")
    s.run("git stash pop")
    s = new("verified")
    s.edit("src/b.py", "x = 1", "x = 2")
    s.run("pytest -q")
    s = new("stale_check")
    s.run("pytest -q")
    s.edit("src/b.py", "x = 1", "x = 2")
    s = new("suppressed")
    s.run("mypy src", "error", True)
    s.edit("src/b.py", "x = f()", "x = f()  # type: ignore")
    s.run("npm test || true")
    s.run("git commit --no-verify -m x")
    s = new("dependency")
    s.edit("package.json", '{"dependencies": {}}', '{"dependencies": {"left-pad": "^1.0.0"}}')
    s.run("npm install left-pad")
    s.run("npm install right-pad")
    s = new("read_first")
    s.result(s.use("Read", file_path="src/b.py"))
    s.edit("src/b.py", "x = 1", "x = 2")
    s = new("read_by_glob")
    s.run("cat src/*.py")
    s.edit("src/b.py", "x = 1", "x = 2")
    s = new("stale")
    s.result(s.use("Read", file_path="src/b.py"))
    s.result(s.use("Edit", minute=150, file_path="src/b.py", old_string="x", new_string="y"))
    s = new("destroyed")
    s.edit("src/b.py", "x = 1", "x = 2")
    s.run("rm -rf src")
    s.run("rm -rf dist node_modules")
    s.run('grep -E "DROP TABLE|DELETE FROM" schema.sql')
    s.run("psql -c 'DROP TABLE users'")
    s = new("outside")
    s.edit("/etc/hosts", "a", "b")
    s.edit("/home/ann/proj/src/in.py", "a", "b")
    s = new("branch")
    s.edit("src/b.py", "x = 1", "x = 2")
    at = len(s.records) - 2
    s.run("pytest")
    s.records[-2]["parentUuid"] = f"u{at - 1}"
    b["short"] = Builder("short")
    b["short"].edit("a.py", "a", "b")
    b["looking"] = Builder("looking").padded()
    b["looking"].run("git status")
    return signals_of(spark, *((k, v.lines()) for k, v in b.items()))


def category(found, session, name):
    return [x for x in found[1].get(session, []) if x[0] == name]


def test_gate(found):
    assert found[0]["short"].reason == "too-short"
    assert found[0]["looking"].reason == "no-file-edits"
    assert found[0]["weakened"].reason is None
    assert not found[1].get("short") and not found[1].get("looking")


def test_modified_tests(found):
    (one,) = category(found, "weakened", "test_modified_to_pass")
    assert one[3] == 0.9 and one[4] == "assertions removed from the test, shortly after a failing command"
    assert category(found, "weakened_calm", "test_modified_to_pass")[0][3] == 0.6
    assert not category(found, "strengthened", "test_modified_to_pass")


def test_abandoned(found):
    assert [x[3] for x in category(found, "returned", "abandoned_approach")] == [0.8]
    assert [x[3] for x in category(found, "reverted", "abandoned_approach")] == [0.7]
    (one,) = category(found, "discarded", "abandoned_approach")
    assert one[1] is None and one[3] == 0.75 and one[4].endswith("b.py, c.py")
    (one,) = category(found, "one_discarded", "abandoned_approach")
    assert one[1] == "src/b.py"
    assert not category(found, "stash_pop", "abandoned_approach")
    assert [x[3] for x in category(found, "branch", "abandoned_approach")] == [0.4]
    # The reset is reported once, as an abandoned approach.
    assert not category(found, "discarded", "destructive_command")


def test_unverified(found):
    assert not category(found, "verified", "unverified_fix")
    (one,) = category(found, "stale_check", "unverified_fix")
    assert one[1] == "src/b.py" and one[3] == 0.6
    assert category(found, "reverted", "unverified_fix")[0][3] == 0.5


def test_suppressed(found):
    got = category(found, "suppressed", "error_suppressed")
    assert sorted(x[3] for x in got) == [0.5, 0.5, 0.7]


def test_dependencies(found):
    got = category(found, "dependency", "external_dependency")
    assert [x[4] for x in got] == ["added to package.json: left-pad", "installed with npm: right-pad"]


def test_assumptions(found):
    assert category(found, "reverted", "unverified_assumption")[0][3] == 0.35
    assert not category(found, "read_first", "unverified_assumption")
    assert not category(found, "read_by_glob", "unverified_assumption")


def test_stale(found):
    (one,) = category(found, "stale", "stale_context")
    assert one[1] == "src/b.py" and one[4].startswith("work resumed after a 2h")
    assert not category(found, "read_first", "stale_context")


def test_destructive(found):
    got = category(found, "destroyed", "destructive_command")
    assert [x[4] for x in got] == ["deleted recursively: src", "a database object was dropped"]


def test_outside_files_are_dropped(found):
    paths = {x[1] for x in found[1]["outside"]}
    assert "/etc/hosts" not in paths and "/home/ann/proj/src/in.py" in paths


def test_parse_counts_and_results(spark):
    b = Builder("p")
    call = b.use("Read", file_path="a.py")
    b.result(call, "first")
    b.result(call, "second", file={"startLine": 1, "numLines": 2, "totalLines": 2, "content": "a\nb"})
    b._add("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "thinking", "thinking": " "}, {"type": "redacted_thinking"}])
    b._add("user", "plain text")
    b.records[-1]["isSidechain"] = "true"
    lines = [*b.lines(), "", "not json", "[1]", json.dumps({"type": "martian"})]
    s = analyze.parsed(table(spark, ("p", lines)))
    meta = s.meta.first()
    assert (meta.lines, meta.blank, meta.malformed, meta.not_an_object, meta.records) == (9, 1, 1, 1, 6)
    assert (meta.thinking_blocks, meta.hidden_thinking_blocks, meta.sidechain_records) == (1, 2, 0)
    assert meta.cwd == "/home/ann/proj" and meta.started_at < meta.ended_at
    call = s.calls.first()
    assert call.result.text == "second" and call.result.file_content == "a\nb"
    assert s.blocks.where("block_type = 'text'").first().text == "plain text"
    assert parse.unknown_types(s.records).first().unknown_types == {"martian": 1}
    assert parse.has_skips(s.meta, parse.unknown_types(s.records)).first().has_skips


def test_empty_table(spark):
    empty = spark.createDataFrame([], "session_id string, line_no int, line string")
    gated, signals = analyze.detect(analyze.parsed(empty))
    assert gated.count() == 0 and signals.count() == 0


def test_no_session_is_too_large_for_signals(spark, monkeypatch):
    """Neither the limit of pairs nor the budget of structures, here so small that any session passes them, leaves anything out."""
    monkeypatch.setattr(detectors.too_many_pairs, "__defaults__", (1,))
    monkeypatch.setattr(budget.parseable, "__defaults__", (1,))
    s = Builder("large").padded()
    s.edit("src/b.py", "x = 1", "x = 2")
    gated, found = signals_of(spark, ("large", s.lines()))
    assert gated["large"].reason is None and [x[0] for x in found["large"]] == ["unverified_assumption", "unverified_fix"]


def test_files_end_to_end(spark, tmp_path):
    """Files in two formats, a sub-agent, redaction and detection."""
    own = Builder("one").padded()
    call = own.use("Agent", prompt="go")
    own.result(call, "done", agentId="a1", toolStats={"editFileCount": 1})
    own.edit("/home/ann/proj/src/b.py", "x", "y = 'a.b@c.org'")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.jsonl").write_text("\r\n".join(own.lines()) + "\n")
    sub = Builder("one")
    sub._add("assistant", [{"type": "tool_use", "id": "z1", "name": "Edit", "input": {"file_path": "src/z.py", "old_string": "1", "new_string": "2"}}], 18)
    sub.records[0] |= {"isSidechain": True, "parentToolUseID": call, "uuid": "sub"}
    (tmp_path / "p" / "one").mkdir()
    (tmp_path / "p" / "one" / "agent-a1.jsonl").write_text("\n".join(sub.lines()) + "\n")
    patch = "*** Begin Patch\n*** Update File: src/q.py\n@@\n-a\n+b\n*** End Patch"
    b = [{"type": "session_meta", "payload": {"id": "r", "cwd": "/home/ann/proj"}}]
    b += [{"timestamp": f"2026-08-16T09:0{k}:00Z", "type": "response_item", "payload": p} for k, p in enumerate([
        {"type": "function_call", "name": "shell", "call_id": "1", "arguments": json.dumps({"command": ["bash", "-lc", "pytest"]})},
        {"type": "function_call_output", "call_id": "1", "output": "Process exited with code 1"},
        {"type": "custom_tool_call", "name": "apply_patch", "call_id": "2", "input": patch},
        {"type": "function_call", "name": "shell", "call_id": "3", "arguments": json.dumps({"command": "ls"})},
    ])]
    (tmp_path / "p" / "rollout-two.jsonl").write_text("\n".join(map(json.dumps, b)) + "\n")
    made = analyze.streams(spark, str(tmp_path))
    lines = redact.redacted(analyze.merged(made)).cache()
    text = "\n".join(r.line for r in lines.collect())
    assert "a.b@c.org" not in text and "/home/ann" not in text
    order = [json.loads(r.line)["uuid"] for r in lines.where("session_id = 'one'").orderBy("line_no").collect()]
    assert order.index("u17") < order.index("sub")
    gated, signals = analyze.detect(analyze.parsed(lines.select("session_id", "line_no", "line")))
    got = {(r.session_id, r.category, r.file_path) for r in signals.collect()}
    assert ("one", "unverified_fix", None) in got and ("rollout-two", "unverified_fix", "src/q.py") in got
    assert ("one", "unverified_assumption", "src/z.py") in got
