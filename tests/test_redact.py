"""Dotenv files in commands and calls, learned values, and redaction of sessions that lie in many tasks."""

import json
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import dotenv, redaction
from logloom.operators import redact
from logloom.plans import redact_queries

M = dotenv.MARK
V = "Hq7wT3nB5zRk"

WRITES = [
    ("cat > .env << 'END'\nMAIL_PASS={v}\nOTHER=base64:{v}Wq7=\nEND", "{m} > .env"), ("python3 - <<'PY'\nopen('.env', 'w').write('A={v}')\nPY", "python3 - <<'PY'\n{m}\nPY"),
    ("cd web && sed -i 's/a/b/' src/a.ts && echo 'A={v}' >> conf/.env.local", "cd web && sed -i 's/a/b/' src/a.ts && {m} > conf/.env.local"), ("echo A={v} | sudo tee -a .env", "{m} > .env"), ("Set-Content -Path .env -Value 'A={v}'", "{m} > .env"),
    ("{{ echo A={v}; echo B={v}; }} > .env", "{m} > .env"), ("(echo A={v}; echo B={v}) | tee .env", "{m} > .env"), ("{{\n  echo A={v}\n}} > .env", "{m} > .env"), ('echo "A={v}\nB={v}" > .env', "{m} > .env"),
    ("echo A={v} | ssh host /usr/bin/tee web/.env", "{m} > web/.env"), ('echo "A={v}" > "My Apps/web/.env"', "{m} > My Apps/web/.env"), ("echo A={v} > my\\ web/.env", "{m} > my web/.env"), ("if true; then echo A={v}; fi > .env", "{m} > .env"),
    ('echo "A={v}" \\\n  >> .env', "{m} > .env"), ('X={v}\necho "K=$X" > .env', "{m} > .env"), ("export X={v}\ncat > .env <<END\nK=$X\nEND", "{m} > .env"), ("echo A={v} >| .env", "{m} > .env"), ("G=.env; echo K={v} > $G", "{m} > .env"),
    ('G=".env.local"; echo K={v} > ${{G}}', "{m} > .env.local"), ("for g in .env .env.local; do echo K={v} >> $g; done", "{m} > .env"), ("exec 4>.env; echo K={v} >&4", "{m} > .env"), ("export X={v}; envsubst < t > .env", "{m} > .env"),
    ('X={v}; ssh host <<END\necho "K=$X" >> /web/.env\nEND', "{m} > /web/.env"), ("ssh host 'tee /web/.env' <<END\nK={v}\nEND", "{m} > /web/.env"), ("python3 -c \"open('.env','w').write('K={v}')\"", "{m} > .env"),
    ('python3 -c "open(\\".env\\", \\"w\\").write(\\"K={v}\\")"', "{m} > .env"), ("node -e \"fs.appendFileSync('.env','K={v}')\"", "{m} > .env"), ("dd of=.env <<< K={v}", "{m} > .env"), ("cp /dev/stdin .env <<< K={v}", "{m} > .env"),
    ("sed -i 's/^K=.*/K={v}/' .env", "sed -i {m} .env"), ("cd web && sed -i 's|^K=.*|K={v}|' .env && npm test", "cd web && sed -i {m} .env && npm test"), ('X={v}\nsed -i "s/^K=.*/K=$X/" .env', "sed -i {m} .env"), ("sed -i '$aK={v}' .env", "sed -i {m} .env"),
    ("sed -i '/^K=/cK={v}' .env", "sed -i {m} .env"), ("sed -i 's/^K=.*/K={v}/' \"$HOME/.env\"", "sed -i {m} .env"), ("for f in a b; do sed -i 's/^K=.*/K={v}/' .env; done", "for f in a b; sed -i {m} .env; done"), ("sed -i -f - .env <<END\ns/^K=.*/K={v}/\nEND", "sed -i {m} .env"),
    ("ruby -pi -e 'sub(\"a\",\"{v}\")' .env", "sed -i {m} .env"), ("docker exec web sed -i 's/a/{v}/' /web/.env", "sed -i {m} /web/.env"), ("ssh host \"cd /srv && sed -i 's/a/{v}/' .env && restart\"", "sed -i {m} .env"),
    ("find . -name '.env*' -exec sed -i 's/a/{v}/' {{}} \\;", "sed -i {m} .env*"), ("grep -rl x --include='*.env' . | xargs sed -i 's/x/{v}/'", "sed -i {m} *.env"), ("sed -i \\\n  -e 's/a/{v}/' \\\n  .env", "sed -i {m} .env"), ("echo K={v} > prod.env", "{m} > prod.env"),
    ("bash <<'SH'\nG=.env; echo K={v} > $G\nSH", "{m} > .env"), ("git log | sh <<'END'\ncat .env\nEND", "git log | sh <<'END'\n{m}\nEND"),
]
KEPT = [
    "python3 -c \"print(open('.env').read())\"", "python3 -c \"open('a.txt','w').write('.env')\"", "dd if=.env of=copy.txt", "G=a.txt; echo K=v > $G; cat .env", 'echo "add this > .env"', "printf 'a > .env\\n'", 'git commit -m "stop writing > .env"', 'grep -n "> .env" run.sh',
    "git commit -m \"$(cat <<'END'\nStop tracking .env\nEND\n)\"", "git commit -F - <<END\nStop tracking .env\nEND", "python3 - <<'PY'\nprint(cfg.env)\nPY", "awk -i lib.awk '{print}' .env", "ruby -ne 'puts $_' .env", "sed -i 's/a/b/' src/env.ts", "echo .env >> .gitignore",
]
READS = [
    "node -e \"fs.readFileSync('.env','utf8')\"", "cut -d= -f2 .env.local", "tr -d x < .env", "if [ -f .env ]; then cat .env; fi", "(cat .env)", "git show origin/main:.env", "for f in .env*; do cut -d= -f2 \"$f\"; done", "docker compose --env-file .env config", "echo `cat .env`",
    'echo "$(tail -1 .env)"', "cat $(ls .env*)", "ls .env* | xargs cat", 'echo "$(<.env)"', "cat conf/*.env", "git show HEAD:.x.env",
]
SILENT = [
    "ls -la .env* && git status", "[ -f .env ] && echo yes", "if ! test -f .env; then echo no; fi", "git rm --cached .env", "git add .env.example && git commit -m \"$(date)\"", "mv .env .env.bak; npm test", "node -p process.env", "grep -rn 'import.meta.env.VITE' src", "rg '\\.env' src", "cat src/a.env.ts",
]


@pytest.mark.parametrize("command,expected", WRITES)
def test_what_a_command_writes_into_a_dotenv_file_goes(command, expected):
    cut, values = dotenv.cut_writes(command.format(v=V))
    assert cut == expected.format(m=M)
    assert V not in command.format(v=V) or any(V in x for x in values)


@pytest.mark.parametrize("command", KEPT)
def test_other_commands_stay(command):
    assert dotenv.cut_writes(command)[0] == command


def test_reads():
    assert [c for c in READS if not dotenv.reads(c)] == [] and [c for c in SILENT if dotenv.reads(c)] == []


def test_long_commands_take_time_in_proportion():
    for unit in (";", "&&", "|", "cat <<A\nA\n", "'"):
        dotenv.cut_writes(unit * (300_000 // len(unit)) + " .env")


def test_calls_that_name_a_dotenv_file():
    assert dotenv.call_names_one("Read", {"file_path": "a/.env"}) and dotenv.call_names_one("Grep", {"glob": "{.env,.env.local}"}) and dotenv.call_names_one("x", {"paths": ["a", "prod.env"]}) and dotenv.call_names_one("REPL", {"code": "read('.env')"})
    assert not dotenv.call_names_one("Workflow", {"script": "agent('cat .env')"}) and not dotenv.call_names_one("Read", {"file_path": "a.py"})
    assert dotenv.cut_input({"file_path": ".env", "edits": [{"old_string": "a", "new_string": f"K={V}"}]}) == ({"file_path": ".env", "edits": [{"old_string": M, "new_string": M}]}, [V], 2)


def test_what_is_worth_learning():
    kept = ["NODE_ENV=production", "BASE_URL=http://localhost:3000", "APP_DIR=/srv/app/current/release", "DB_PASSWORD=password", "SHORT=Zq8vR2m", 'START="npm run build"', "PIN_CODE=1234567890123", "REGION=northamerica-northeast1", "CIPHER=TLS_AES_256_GCM_SHA384", "OPTS=--max-old-space-size=4096"]
    assert [x for x in kept if dotenv.learned(x)] == []
    gone = {"PHRASE=" + V: [V], "X=p@ss-w0rd!x#9zz": ["p@ss-w0rd!x#9zz"], f'export A="{V}"': [V], V: [V], f"     1→A={V}": [V], f"echo K={V}>.env": [f"{V}>.env", V], f"a=1;K={V};": [], "DB_PASSWORD=abcd123x": ["abcd123x"], f"K={V}\\nB=\\\"{V}9\\\"": [V, V + "9"]}
    assert {x: dotenv.learned(x) for x in gone} == gone


@given(st.lists(st.text("ab", min_size=8, max_size=12), min_size=1, max_size=6), st.text("ab", max_size=60))
@settings(max_examples=300, deadline=None)
def test_values_are_cut_leftmost_and_longest(values, text):
    out, at = [], 0
    while at < len(text):
        hit = max((v for v in values if text.startswith(v, at)), key=len, default=None)
        out += [(at, at + len(hit))] if hit else []
        at += len(hit) if hit else 1
    assert dotenv.Values(values).spans(text) == out


def use(call, tool, given, **more):
    return json.dumps({"type": "assistant", "message": {"content": [{"type": "tool_use", "id": call, "name": tool, "input": given}]}} | more)


def result(call, text, **detail):
    return json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": call, "content": text}]}} | ({"toolUseResult": detail} if detail else {}))


def test_a_background_task_goes_the_way_of_its_command():
    lines = [use("1", "Bash", {"command": "tail -f .env"}), result("1", "on", backgroundTaskId="b1")]
    for k in range(2, 6):  # each asks for the task of the one before and starts the next
        lines += [use(str(k), "TaskOutput", {"task_id": f"b{k - 1}"}), result(str(k), f"A_PASSWORD={V}{k}", backgroundTaskId=f"b{k}")]
    lines += [use("7", "Bash", {"command": "tail /tmp/tasks/b5.output"}), result("7", "x"), use("8", "TaskOutput", {"task_id": "b9"}), result("8", "free"), use("9", "Bash", {"command": "sleep 1"}), result("9", "on", backgroundTaskId="b1"), json.dumps({"said": f"{V}3 and {V}"})]
    out, _ = redact.redact_session(lines)
    contents = [json.loads(x)["message"]["content"][0].get("content") for x in out[1:-1:2]]
    assert contents == [M] * 6 + ["free", "on"] and out[-1] == f'{{"said":"{M} and {V}"}}'


def test_a_line_that_nothing_touches_is_not_walked(monkeypatch):
    walked = []
    own = redaction.redact_value
    monkeypatch.setattr(redaction, "redact_value", lambda value, *rest: walked.append(value) or own(value, *rest))
    plain = json.dumps({"type": "user", "message": {"content": "done"}}, separators=(",", ":"))
    assert redact.redact_session([plain] * 3) == ([plain] * 3, Counter()) and not walked
    touched = ['{"a":"/x"}', '{"a":"\\u0040"}', '{"passwd":"abcdefgh12"}', '{"MY_KEY":"abcd1234efgh"}', '{"a":"a@b.org"}', '{"a":' + "[" * 200 + "]" * 200 + "}"]
    redact.redact_session(touched)
    assert len(walked) == len(touched) and not any(redaction.untouched(x) for x in touched)


def sessions(seed):
    """Sessions of random calls, tasks that follow each other, typed commands, broken lines and payloads."""
    rng, found = random.Random(seed), {}
    value = lambda: f"Hq7w{rng.randrange(12)}T3nB5zRk"
    for s in range(14):
        out = []
        for i in range(rng.randrange(50)):
            call = f"c{rng.randrange(30)}" if rng.random() < 0.2 else f"c{s}-{i}"
            task, detail = f"bg{rng.randrange(6)}", rng.choice([{}, {"backgroundTaskId": f"bg{rng.randrange(6)}"}, {"out": f"A={value()}"}])
            asked = rng.choice([
                ("Bash", {"command": "cat .env"}), ("Bash", {"command": f"echo K={value()} > .env; ls"}), ("TaskOutput", {"task_id": task}), ("TaskStop", {"shell_id": task}), ("Bash", {"command": f"tail {task}.output"}), ("Bash", {"command": "npm run dev"}),
                ("Write", {"file_path": "/home/ann/p/.env", "content": f"X={value()}"}), ("Read", {"file_path": "/home/ann/p/a.py"}),
            ])
            said = rng.choice(["<bash-input>cat .env</bash-input>", "<bash-input>ls</bash-input>", f"<bash-stdout>A={value()}</bash-stdout>", f"use {value()} a.b@c.org é", "/home/bob/q/x"])
            odd = rng.choice(["", "  ", "{bad A=" + value(), f'["{value()} /home/ann/p/z"]', "12", '{"a":"\\ud800 x"}', None, json.dumps({"type": "attachment", "attachment": {"type": "q", "x": value()}, "uuid": value()}), json.dumps({"type": "api-request", "body": "s"}), json.dumps({"type": "user", "isMeta": True, "message": {"content": "m"}, "ownerAccountUuid": "1", "mcpMeta": 1})])
            out += rng.choice([[use(call, *asked, cwd=rng.choice([None, "/home/ann/p", "rel"])), result(call, f"A={value()}\n/home/ann/p/x", **detail)], [json.dumps({"type": "user", "message": {"content": said}, "cwd": "/home/ann/p"})], [odd]])
        found[f"s{s}"] = out
    return found


@pytest.mark.parametrize("portion", [64 << 20, 700])
def test_tables_give_the_lines_of_a_session_read_in_order(spark, portion):
    given_ = sessions(3)
    rows = [(s, n, line, "x", 1) for s, lines in given_.items() for n, line in enumerate(lines)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "session_id string, line_no int, line string, cwd string, blocks int").repartition(5)
    got, counts = defaultdict(list), defaultdict(Counter)
    for r in redact.redacted(table, portion=portion).orderBy("session_id", "line_no").collect():
        got[r.session_id].append(r.line)
        counts[r.session_id].update(r.counts)
    for s, lines in given_.items():
        want, n = redact.redact_session(lines)
        assert got[s] == want and +counts[s] == +n
    assert sum(n["dotenv"] for n in counts.values()) > 100


def test_a_session_with_more_values_keeps_the_first(spark, monkeypatch):
    monkeypatch.setattr(redact, "MOST_LEARNED", 3)
    lines = [use("1", "Bash", {"command": "cat .env"}), result("1", "\n".join(f"A{k}={V}{k}" for k in range(6))), json.dumps({"said": " ".join(f"{V}{k}" for k in range(6))})]
    want, _ = redact.redact_session(lines)
    table = spark.createDataFrame([("s", n, x) for n, x in enumerate(lines)], "session_id string, line_no int, line string")
    assert [r.line for r in redact.redacted(table).orderBy("line_no").collect()] == want and want[-1] == json.dumps({"said": f"{M} {M} {M} {V}3 {V}4 {V}5"}, separators=(",", ":"))


def test_a_session_with_more_values_than_are_held_is_cut_in_parts(spark, many_values):
    """Values that overlap lie in different parts; the counts are those of all values together."""
    got, given_ = defaultdict(list), {s: x for s, x in sessions(4).items() if s in ("s1", "s2", "s5")}
    given_["t"] = [use("1", "Bash", {"command": "cat .env"}), result("1", f"A={V}\nB={V}99\nC=99{V}\nD=x9#{V}"), f"{V}99{V}x9#{V}\\ {{", json.dumps({"a": [f"{V}9", f"x99{V}9"], "type": V})]
    rows = [(s, n, line) for s, lines in given_.items() for n, line in enumerate(lines)]
    table = spark.createDataFrame(rows, "session_id string, line_no int, line string").repartition(3)
    counts = defaultdict(Counter)
    for r in redact.redacted(table, at_once=60, held=-1).orderBy("session_id", "line_no").collect():
        got[r.session_id].append(r.line)
        counts[r.session_id].update(r.counts)
    for s, lines in given_.items():
        want, n = redact.redact_session(lines)
        assert got[s] == want and +counts[s] == +n
    assert [tuple(r) for r in redact_queries.log_redactions(spark, many_values).collect()] == [("dotenv", 524 + 524 + 1)]


@pytest.mark.parametrize("held", [-1, 2000])
def test_long_sessions_are_redacted_by_tables_as_others_in_order(spark, held):
    """Also a session whose folder is the root, and one whose lines share a number, which is always redacted by tables."""
    given_ = sessions(6) | {"root": [use("1", "Bash", {"command": "ls"}, cwd=x) for x in ("/", "/home/ann/p")] + [json.dumps({"said": "/home/ann/p/x /srv/y"})]}
    rows = [(s, n, line) for s, lines in given_.items() for n, line in enumerate(lines)] + [("twice", 0, f"\"{V}\""), ("twice", 0, '"/home/ann/x"'), ("twice", 1, None), (None, 3, "x"), (None, None, "a@b.org")]
    table = spark.createDataFrame(rows, "session_id string, line_no int, line string").repartition(5)
    got, counts = defaultdict(list), defaultdict(Counter)
    for r in redact.redacted(table, held=held, portion=2000).orderBy("session_id", "line_no", "line").collect():
        got[r.session_id].append(r.line)
        counts[r.session_id].update(r.counts)
    assert got["twice"] == [f'"{V}"', '"~/x"'] and got[None] == ["[REDACTED:email]", "x"] and counts[None] == {"unparsed_lines": 2, "email": 1}
    for s, lines in given_.items():
        want, n = redact.redact_session(lines)
        assert got[s] == want and +counts[s] == +n


@pytest.fixture(scope="module")
def many_values(spark, tmp_path_factory):
    """Events of a session whose log shows 524 values; a line says the last of them before it is written."""
    place = f"file://{tmp_path_factory.mktemp('values')}"
    rows = [(k, f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", 7, "view" if k == 522 else "click") for k in range(525)]
    table = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
    table.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{place}/events.parquet")
    return place


def test_all_values_of_a_session_are_cut(spark, many_values):
    said = {r.line_no: r.said for r in redact_queries.log_dotenv_cuts(spark, many_values).collect()}
    assert len(said) == 1050 and said[1044] == f"use {M} for it" and not any("Zq8v" in x for x in said.values())


def test_empty_tables_and_own_patterns(spark):
    empty = spark.createDataFrame([], "session_id string, line_no int, line string")
    assert redact.redacted(empty).collect() == []
    with pytest.raises(ValueError, match="compile"):
        redact.redacted(empty, ["("])
    table = spark.createDataFrame([(None, 0, '{"a":"CUST-77"}'), (None, 1, None)], "session_id string, line_no int, line string")
    assert [(r.session_id, r.line, r.counts) for r in redact.redacted(table, [r"CUST-\d+"]).collect()] == [(None, '{"a":"[REDACTED:custom]"}', {"custom": 1})]


def test_written_lines_read_back_in_order(spark, tmp_path):
    rows = [(s, n, f"{s}{n}") for s in ("a", "b") for n in range(200)]
    table = spark.createDataFrame(rows, "session_id string, line_no int, line string").repartition(6)
    redact.write_lines(table, f"file://{tmp_path}/out")
    for s in ("a", "b"):
        files = sorted((tmp_path / "out" / f"session_id={s}").glob("part-*"))
        assert [x for f in files for x in f.read_text().splitlines()] == [f"{s}{n}" for n in range(200)]
