"""Scalar functions over commands, paths and texts that are built from ``events``, and their answers built in SQL from the same columns.

A form is a text with ``{r}`` (event_id modulo 9), ``{k}`` (event_id) and ``{t}`` (the event's type) in it, and so are its answers; SQL puts the
columns into the answers and never sees a command. Forms take turns by event_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dependencies, dotenv, marks, patch, paths, redaction, shell
from ..functions import text as t
from ..tables import spread
from .case_queries import _udf

_QUESTIONS = ("segments", "writes", "git", "looks", "reads", "edits", "installed", "destroyed", "reverted", "checks")
#: A command, and its answers in the order of the questions; segments are joined by a broken bar. It runs in /w/p{r}.
COMMANDS = (
    ("cat src/f{r}.py lib/{t}{k}.rs | head -n {r}", "cat src/f{r}.py lib/{t}{k}.rs ¦ head -n {r}", "false", "", "true", "src/f{r}.py,lib/{t}{k}.rs", "", "", "", "", "false"),
    ("sed -i 's/a/b/' lib/f{r}.py ../{t}{k}.c && npm run test", "sed -i 's/a/b/' lib/f{r}.py ../{t}{k}.c ¦ npm run test", "true", "", "false", "", "/w/p{r}/lib/f{r}.py,/w/{t}{k}.c", "", "", "", "true"),
    ("git restore src/{t}{k}.py; git status", "git restore src/{t}{k}.py¦ git status", "true", "restore,status", "false", "", "", "", "", "false|{t}{k}.py", "false"),
    ("npm install left{k}@1.{r} @x/{t}{r}; ls", "npm install left{k}@1.{r} @x/{t}{r}¦ ls", "false", "", "false", "", "", "npm: left{k}@1.{r},@x/{t}{r}", "", "", "false"),
    ("pip install 'q{k}>=2' && python3 -m pytest t{r}.py", "pip install 'q{k}>=2' ¦ python3 -m pytest t{r}.py", "false", "", "false", "", "", "pip: q{k}>=2", "", "", "true"),
    ("rm -rf src/{t}{k} build{r} dist", "rm -rf src/{t}{k} build{r} dist", "false", "", "false", "", "", "", "0.6|deleted recursively: src/{t}{k}, build{r}", "", "false"),
    ("git commit -m 'x{k}; git push' && git push --force origin b{r}", "git commit -m 'x{k}; git push' ¦ git push --force origin b{r}", "false", "commit,push", "true", "", "", "", "0.7|a branch was force-pushed", "", "false"),
    ("cat <<E > out{k}.txt\nsrc/no{r}.py\nE\nwc -l a{r}/{t}.txt", "cat <<E > out{k}.txt¦wc -l a{r}/{t}.txt", "true", "", "true", "a{r}/{t}.txt", "", "", "", "", "false"),
    ("echo v{k} | tee conf{r}.ini", "echo v{k} ¦ tee conf{r}.ini", "true", "", "false", "", "", "", "", "", "false"),
    ("git reset --hard HEAD~{r} && cargo build", "git reset --hard HEAD~{r} ¦ cargo build", "false", "reset", "false", "", "", "", "0.6|the working tree was reset, discarding uncommitted work", "true|", "true"),
    ("psql d{k} -c 'DROP TABLE {t}{r}'", "psql d{k} -c 'DROP TABLE {t}{r}'", "false", "", "false", "", "", "", "0.8|a database object was dropped", "", "false"),
    ("cd lib{r}; perl -pi -e 's/x/y/' m{k}.pl", "cd lib{r}¦ perl -pi -e 's/x/y/' m{k}.pl", "true", "", "false", "", "/w/p{r}/lib{r}/m{k}.pl", "", "", "", "false"),
    ("git show HEAD~{r}:src/{t}{k}.rs | grep -n 'a;b'", "git show HEAD~{r}:src/{t}{k}.rs ¦ grep -n 'a;b'", "false", "show", "true", "src/{t}{k}.rs", "", "", "", "", "false"),
    ("mv a{k}.txt b{r}.txt && make lint", "mv a{k}.txt b{r}.txt ¦ make lint", "true", "", "false", "", "", "", "", "", "true"),
    ("x=$(grep -l 'q{k};r' f{r}.md) && yarn add {t}{k}", "x=  ¦ yarn add {t}{k}¦grep -l 'q{k};r' f{r}.md", "false", "", "false", "f{r}.md", "", "yarn: {t}{k}", "", "", "false"),
)
_M = {k: paths.marker(k) for k in ("assignment", "email", "connection_string", "github_token", "aws_key", "openai_key", "anthropic_key", "jwt", "bearer_token", "slack_token", "google_key", "npm_token", "stripe_key", "service_token", "authorization", "cookie", "private_key")}
_RUN = "abcdEFGH1234" * 4
#: Secrets of every kind of rule, with a digit of the event's in each, and what is left of their texts.
SECRETS = (
    ("see {t}{k}@mail{r}.org now", f"see {_M['email']} now"), ("DB{r}_PASSWORD=hunter2x{k}x", f"DB{{r}}_PASSWORD={_M['assignment']}"), ("db{r}://u{k}:hunter2x{k}@h/d", f"db{{r}}://u{{k}}:{_M['connection_string']}@h/d"), ("t ghp" + "_" + _RUN[:35] + "{r} b", f"t {_M['github_token']} b"),
    ("t AKI" + "A" + "ABCD1234" + "EFGH567{r}", f"t {_M['aws_key']}"), ("t sk" + "-" + _RUN[:20] + "{k}", f"t {_M['openai_key']}"), ("t sk" + "-ant-" + _RUN[:20] + "{k}", f"t {_M['anthropic_key']}"), ("t ey" + "J" + _RUN[:12] + "." + _RUN[:12] + "{r}." + _RUN[:12] + "{k}", f"t {_M['jwt']}"),
    ("Bearer abcdef{k}ghi", f"Bearer {_M['bearer_token']}"), ("t xox" + "b-123456789{r}-{k}", f"t {_M['slack_token']}"), ("t AIz" + "a" + _RUN[:34] + "{r}", f"t {_M['google_key']}"), ("t npm" + "_" + _RUN[:35] + "{r}", f"t {_M['npm_token']}"), ("t sk" + "_live_" + _RUN[:16] + "{k}", f"t {_M['stripe_key']}"),
    ("t gsk" + "_" + _RUN[:40] + "{k}", f"t {_M['service_token']}"), ("Authorization: Basic dXNlcjpwYX{k}", f"Authorization: Basic {_M['authorization']}"), ("Cookie: sid=abcdefgh{k}; x=y", f"Cookie: {_M['cookie']}"), ("-----BEGIN RSA PRIV" + "ATE KEY-----\nx{k}", _M["private_key"]), ("accessToken{r}: \"abcdefgh{k}\"", f'accessToken{{r}}: "{_M["assignment"]}"'),
    ("curl -u me{r}:hunter2{k} x", f"curl -u me{{r}}:{_M['assignment']} x"), ("max_tokens: 40960{k}", "max_tokens: 40960{k}"), ("the password of {t}{k} is below", "the password of {t}{k} is below"), ("secret = $SECRET_{k}", "secret = $SECRET_{k}"), ("token = getToken{r}(request)", "token = getToken{r}(request)"),
)
#: Texts with paths, below /home/ann/p{r}, and as they are told.
PATHS = (
    ("see /home/ann/p{r}/src/{t}{k}.ts:3", "see src/{t}{k}.ts:3"), ("/home/ann/q{k}/x.txt.", "~/q{k}/x.txt."), ("at /usr/lib/{t}{k}", "at /usr/lib/{t}{k}"), ("/home/bob{r}/y{k}", "~/y{k}"), ("C:\\Users\\joe{r}\\a{k}", "~\\a{k}"), ("https://a.b/home/ann/p{r}/{k}", "https://a.b/home/ann/p{r}/{k}"),
    ("cd /home/ann/p{r} && ls", "cd . && ls"), ("\\\\host{r}\\share\\f{k}", "\\\\" + paths.marker("host") + "\\share\\f{k}"), ("'/home/ann/p{r}/a b{k}'", "'a b{k}'"),
)
#: Key names with an 8-letter value of the event's, and whether that makes it a secret.
KEYS = (("password", "true"), ("api_key", "true"), ("db{r}Pass", "true"), ("{t}_secret", "true"), ("token_hash", "false"), ("max_tokens", "false"), ("{t}{r}", "false"), ("client-secret-prod", "true"), ("passport{r}", "false"), ("privateKey", "true"))
#: Lines of a dotenv file and the value that is learned of each.
LINES = (("A{r}=Zq8v{k}R2mK9xLp", "Zq8v{k}R2mK9xLp"), ("export B_TOKEN=\"value {k} w{r}\"", "value {k} w{r}"), ("PORT=80{k}", ""), ("URL=https://h{r}.example.org/{t}", ""), ("MODE={t}", ""), ("C=p@ss{k}word!{r}abc", "p@ss{k}word!{r}abc"), ("Zq8v{k}R2mK9xLp", "Zq8v{k}R2mK9xLp"), ("echo D=Zq8v{k}R2mK9xLp>.env", "Zq8v{k}R2mK9xLp,Zq8v{k}R2mK9xLp>.env"))
#: Addresses of remotes and the names of their repositories.
REMOTES = (("git@host{r}.org:own{k}/{t}.git", "own{k}/{t}"), ("https://u@host{r}.org/own{k}/{t}.git/", "own{k}/{t}"), ("ssh://git@host{r}.org/own{k}/{t}", "own{k}/{t}"))
#: A manifest's old and new text, and the names that are new in it.
MANIFESTS = (
    ("package.json", '{"a{r}": "^1"}', '{"a{r}": "^1", "b{k}": "~2"}', "b{k}"), ("requirements.txt", "f{r}==1", "f{r}==1\nq{k}>=2\na-{t}{r}~=3", "a-{t}{r},q{k}"), ("Cargo.toml", "", '[dependencies]\ns{k} = "1"\n[dependencies.z{r}]\nversion = "1"', "s{k},z{r}"),
    ("go.mod", "", "require github.com/x{r}/y{k} v1.2.0", "github.com/x{r}/y{k}"), ("Gemfile", "gem 'a{r}'", "gem 'a{r}'\ngem 'r{k}', '~> 7'", "r{k}"), ("pyproject.toml", "", '[project]\ndependencies = ["h{k}>=1"]\nversion = "{r}"', "h{k}"),
)
#: What a run printed, and whether it failed.
ENDS = (("took {k} s\nProcess exited with code {r}", None), ('{"exit_code": 1{r}, "n": {k}}', "true"), ('{"exit_code":0, "n": {k}}', "false"), ("{t} {k} ok", "false"))
#: Words of a call, and the command that they run.
ARGV = (("bash|-lc|ls {k} && pwd", "ls {k} && pwd"), ("/bin/sh|-c|echo {t}{r}", "echo {t}{r}"), ("ls|-l|d{k}", "ls -l d{k}"), ("zsh|-x|{r}", "zsh -x {r}"))
#: A patch, and the files and tools that it comes to.
PATCHES = (
    ("*** Begin Patch\n*** Add File: n{k}.py\n+v{r}\n*** End Patch", "Write n{k}.py"), ("*** Begin Patch\n*** Update File: {t}{k}.py\n@@\n-a\n+b\n*** Update File: u{r}.py\n@@\n-c\n+d\n*** End Patch", "Edit {t}{k}.py,Edit u{r}.py"),
    ("*** Begin Patch\n*** Update File: m{k}.py\n@@\n-a\n+b\n@@\n-c\n+d{r}\n*** End Patch", "MultiEdit m{k}.py"),
)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type"), "event_id")


def _put(text: str) -> Column:
    out = F.lit(text)
    for sign, value in (("{r}", (F.col("event_id") % 9).cast("string")), ("{k}", F.col("event_id").cast("string")), ("{t}", F.col("event_type"))):
        out = F.replace(out, F.lit(sign), value) if sign in text else out
    return out


def _form(texts) -> Column:
    return F.coalesce(*(F.when(F.col("event_id") % len(texts) == n, _put(x)) for n, x in enumerate(texts)))


def _sql_put(text: str) -> str:
    out = "'" + text.replace("'", "''") + "'"
    for sign, value in (("{r}", "CAST(event_id % 9 AS VARCHAR)"), ("{k}", "CAST(event_id AS VARCHAR)"), ("{t}", "event_type")):
        out = f"replace({out}, '{sign}', {value})" if sign in text else out
    return out


def _sql(answers) -> str:
    return f"SELECT event_id, CASE event_id % {len(answers)} " + " ".join(f"WHEN {n} THEN {_sql_put(x)}" for n, x in enumerate(answers)) + " END AS answer FROM events"


_said = lambda flag: flag.cast("string")
_ASK = {
    "segments": lambda c: F.array_join(shell.segments_of(c), "¦"),
    "writes": lambda c: _said(shell.writes_of(c)),
    "git": lambda c: F.array_join(shell.git_commands_of(c), ","),
    "looks": lambda c: _said(shell.only_looks_of(c)),
    "reads": lambda c: F.array_join(shell.read_paths_of(c), ","),
    "edits": lambda c: F.array_join(shell.edit_paths_of(c, _put("/w/p{r}")), ","),
    "installed": lambda c: F.coalesce(F.concat_ws(": ", shell.installed_of(c)["manager"], F.array_join(shell.installed_of(c)["packages"], ",")), F.lit("")),
    "destroyed": lambda c: F.concat_ws("|", shell.destruction_of(c)["weight"].cast("string"), shell.destruction_of(c)["detail"]),
    "reverted": lambda c: F.concat_ws("|", shell.revert_targets_of(c)["everything"].cast("string"), F.array_join(shell.revert_targets_of(c)["names"], ",")),
    "checks": lambda c: _said(marks.checks(F.lit("Bash"), c)),
}


def _query(answer, *forms):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _events(spark, sf).select("event_id", answer(*(_form(x) for x in forms)).alias("answer"))

    return run


def _columns(rows, *at: int):
    return tuple(tuple(r[k] for r in rows) for k in at)


def queries() -> dict:
    made = {f"command_{q}": (_query(_ASK[q], _columns(COMMANDS, 0)[0]), _sql(_columns(COMMANDS, n + 1)[0])) for n, q in enumerate(_QUESTIONS)}
    tools = lambda v: ",".join(f"{c['name']} {c['input']['file_path']}" for c in patch.parse_patch(v))
    plain = {
        "redacted_forms": (lambda x: redaction.redacted_by(redaction.RULES)(x), SECRETS), "masked_forms": (lambda x: paths.mask_text_of(x, _put("/home/ann/p{r}")), PATHS), "learned_forms": (lambda x: _udf(lambda v: ",".join(sorted(set(dotenv.learned(v)))), x), LINES),
        "remote_forms": (t.remote_name, REMOTES), "argv_forms": (lambda x: _udf(lambda v: shell.argv_command(v.split("|")), x), ARGV), "patch_forms": (lambda x: _udf(tools, x), PATCHES),
        "secret_keys": (lambda x: _udf(lambda k, v: str(redaction.sensitive(k, v)).lower(), x, _put("hunter2{k}")), KEYS),
    }
    for name, (answer, rows) in plain.items():
        made[name] = (_query(answer, _columns(rows, 0)[0]), _sql(_columns(rows, 1)[0]))
    path, old, new, names = _columns(MANIFESTS, 0, 1, 2, 3)
    made["added_forms"] = (_query(lambda p, a, b: F.array_join(dependencies.added_of(p, a, b), ","), path, old, new), _sql(names))
    ends = _sql(tuple(x[1] or "" for x in ENDS)).replace("THEN ''", "THEN CASE WHEN event_id % 9 = 0 THEN 'false' ELSE 'true' END", 1)
    made["failed_forms"] = (_query(lambda x: _said(t.exec_failed(x)), _columns(ENDS, 0)[0]), ends)
    return made
