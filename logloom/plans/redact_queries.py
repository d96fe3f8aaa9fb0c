"""Redaction over logs that are written from ``events``, and the same answers in SQL, which never sees a log.

``dotenv_logs`` makes two lines of each event: a command, a followed task or something said, and what came back. Which of
them show a dotenv file follows in SQL from the kinds of the events before: a task is tainted where an unbroken row of followed tasks
goes back to a command that read such a file.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dotenv, redaction
from ..functions.paths import marker
from ..operators import redact
from ..tables import spread

_M = marker("dotenv")


def _value(k: Column) -> Column:
    return F.concat(F.lit("Zq8v"), k.cast("string"), F.lit("R2mK9xLp"))


def dotenv_logs(spark: SparkSession, sf: str) -> DataFrame:
    """(session_id, line_no, line)"""
    e = spread(spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", "event_type"), "user_id")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.select(
        F.col("user_id").cast("string").alias("session_id"), (F.row_number().over(by) - 1).alias("i"), F.col("event_id").alias("k"), F.col("event_type").alias("kind"),
        F.coalesce(F.lag("event_id").over(by), F.lit(-1)).alias("before"), F.coalesce(F.lead("event_id", 2).over(by), F.col("event_id")).alias("later"),
    )
    k, kind, none = F.col("k"), F.col("kind"), F.lit(None).cast("string")
    pair, call = F.concat(F.lit("PHRASE_"), k, F.lit("="), _value(k)), F.concat(F.lit("c"), k)
    command = F.when(kind == "signup", "cat .env").when(kind == "click", F.concat(F.lit("echo "), pair, F.lit(" > .env"))).when(kind == "purchase", F.when(k % 3 == 0, "tail -f .env").otherwise("npm run dev"))
    given = F.struct(command.alias("command"), F.when(kind == "error", F.concat(F.lit("bg"), F.col("before"))).alias("task_id"))
    use = F.struct(F.lit("tool_use").alias("type"), call.alias("id"), F.when(kind == "error", "TaskOutput").otherwise("Bash").alias("name"), given.alias("input"))
    answer = F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), pair.alias("content"))
    task = F.when(kind.isin("purchase", "error"), F.struct(F.concat(F.lit("bg"), k).alias("backgroundTaskId")))
    message = lambda role, content, **more: F.to_json(F.struct(F.lit(role).alias("type"), F.struct(content.alias("content")).alias("message"), *(v.alias(n) for n, v in more.items())))
    typed = F.when(k % 4 == 0, "cat .env").when(k % 4 == 1, "ls")
    said = F.coalesce(F.concat(F.lit("<bash-input>"), typed, F.lit("</bash-input>")), F.concat(F.lit("use "), _value(F.col("later")), F.lit(" for it")))
    back = F.when(typed.isNull(), "done").otherwise(F.concat(F.lit("<bash-stdout>"), pair, F.lit("</bash-stdout>")))
    view = kind == "view"
    two = F.array(
        F.when(view, message("user", said)).otherwise(message("assistant", F.array(use))),
        F.when(view, message("user", back)).otherwise(message("user", F.array(answer), toolUseResult=task)),
    )
    return e.select("session_id", "i", F.posexplode(two).alias("n", "line")).select("session_id", (F.col("i") * 2 + F.col("n")).cast("int").alias("line_no"), "line")


def log_dotenv_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """What each line says once redacted: its text, its command or task, or its result."""
    get = F.get_json_object
    said = F.coalesce(get("line", "$.message.content[0].input.command"), get("line", "$.message.content[0].input.task_id"), get("line", "$.message.content[0].content"), get("line", "$.message.content"))
    return redact.redacted(dotenv_logs(spark, sf)).select("session_id", "line_no", said.alias("said"))


_CUTS = f"""
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS s, row_number() OVER u - 1 AS i, event_id AS k, event_type AS kind, 'Zq8v' || event_id || 'R2mK9xLp' AS v,
         coalesce(lag(event_id) OVER u, -1) AS before, coalesce(lead(event_id, 2) OVER u, event_id) AS later
  FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
root AS (SELECT *, max(CASE WHEN kind <> 'error' THEN i END) OVER (PARTITION BY s ORDER BY i) AS j FROM e),
t AS (
  SELECT root.*, CASE root.kind WHEN 'error' THEN coalesce(o.kind = 'purchase' AND o.k % 3 = 0, false) WHEN 'purchase' THEN root.k % 3 = 0 WHEN 'view' THEN root.k % 4 = 0 ELSE true END AS shows
  FROM root LEFT JOIN e o ON o.s = root.s AND o.i = root.j),
known AS (SELECT s, k FROM t WHERE shows),
first AS (
  SELECT t.s, 2 * t.i AS line_no, CASE t.kind WHEN 'signup' THEN 'cat .env' WHEN 'click' THEN '{_M} > .env' WHEN 'purchase' THEN CASE WHEN t.k % 3 = 0 THEN 'tail -f .env' ELSE 'npm run dev' END WHEN 'error' THEN 'bg' || before
    ELSE CASE t.k % 4 WHEN 0 THEN '<bash-input>cat .env</bash-input>' WHEN 1 THEN '<bash-input>ls</bash-input>' ELSE 'use ' || CASE WHEN known.k IS NULL THEN 'Zq8v' || later || 'R2mK9xLp' ELSE '{_M}' END || ' for it' END END AS said
  FROM t LEFT JOIN known ON known.s = t.s AND known.k = t.later),
second AS (
  SELECT t.s, 2 * t.i + 1 AS line_no, CASE WHEN shows THEN '{_M}' WHEN kind <> 'view' THEN 'PHRASE_' || k || '=' || v WHEN k % 4 = 1 THEN '<bash-stdout>PHRASE_' || k || '=' || v || '</bash-stdout>' ELSE 'done' END AS said FROM t)
SELECT s AS session_id, CAST(line_no AS INTEGER) AS line_no, said FROM (SELECT * FROM first UNION ALL SELECT * FROM second) x"""


def log_redactions(spark: SparkSession, sf: str) -> DataFrame:
    return redact.summary(redact.redacted(dotenv_logs(spark, sf)))


#: A cut result counts, and so does its structured form beside it; a written command, a typed output, and each value that is cut where it is only said.
_COUNTS = _CUTS.rsplit("SELECT s AS session_id", 1)[0] + """SELECT 'dotenv' AS type,
  (SELECT count(*) FILTER (kind = 'click') + count(*) FILTER (shows) + count(*) FILTER (shows AND kind IN ('purchase', 'error')) FROM t) + (SELECT count(*) FROM first WHERE said LIKE 'use [%') AS n"""


def cut_of(command: Column) -> Column:
    """A command without what it writes into dotenv files, the values that these were, and whether what it prints is one's contents."""

    @F.pandas_udf("command string, values array<string>, reads boolean")
    def run(commands: pd.Series) -> pd.DataFrame:
        found = [(*dotenv.cut_writes(x), dotenv.reads(x)) if isinstance(x, str) else (None, [], False) for x in commands]
        return pd.DataFrame(found, columns=["command", "values", "reads"])

    return run(command)


def dotenv_commands(spark: SparkSession, sf: str) -> DataFrame:
    """An event's command in one of twelve forms, with its names and values from the event."""
    e, k = spread(spark.read.parquet(f"{sf}/events.parquet").select("event_id"), "event_id"), F.col("event_id")
    r, v = (k % 9).cast("string"), _value(k)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    forms = [
        say('echo "P=', v, '" > cfg', r, "/.env"), say("cd a", r, " && printf 'P=", v, "\\n' >> .env.local"), say("sed -i 's/^P=.*/P=", v, "/' .env", r, " && ls"), say("cat > .env <<EOF\nP=", v, "\nEOF\nls ", r),
        say("F=cfg", r, ".env; echo P=", v, " > $F"), say("{ echo A=1; echo P=", v, "; } | tee x", r, ".env"), say('echo "then > .env', r, '"'), say("python3 -c \"open('a", r, "/.env','w').write('P=", v, "')\""),
        say("cut -d= -f2 c", r, "/.env"), say("ls -l .env", r, " && git status"), say("VALUE=", v, "\necho \"P=$VALUE\" >> d", r, "/.env"), say("node -e 'console.log(process.env.P", r, ")'"),
    ]
    made = F.coalesce(*(F.when(k % 12 == n, x) for n, x in enumerate(forms)))
    c = cut_of(made)
    return e.select("event_id", c.alias("c")).select("event_id", "c.command", F.array_join(F.array_sort(F.array_distinct("c.values")), ",").alias("values"), "c.reads")


_COMMANDS = f"""
SELECT event_id, CASE f WHEN 0 THEN m || ' > cfg' || r || '/.env' WHEN 1 THEN 'cd a' || r || ' && ' || m || ' > .env.local' WHEN 2 THEN 'sed -i ' || m || ' .env' || r || ' && ls' WHEN 3 THEN m || ' > .env' || chr(10) || 'ls ' || r
    WHEN 4 THEN m || ' > cfg' || r || '.env' WHEN 5 THEN m || ' > x' || r || '.env' WHEN 6 THEN 'echo "then > .env' || r || '"' WHEN 7 THEN m || ' > a' || r || '/.env' WHEN 8 THEN 'cut -d= -f2 c' || r || '/.env'
    WHEN 9 THEN 'ls -l .env' || r || ' && git status' WHEN 10 THEN m || ' > d' || r || '/.env' ELSE 'node -e ''console.log(process.env.P' || r || ')''' END AS command,
  CASE WHEN f IN (6, 8, 9, 11) THEN '' ELSE 'Zq8v' || event_id || 'R2mK9xLp' END AS values, f IN (2, 3, 4, 5, 7, 8) AS reads
FROM (SELECT event_id, event_id % 12 AS f, CAST(event_id % 9 AS VARCHAR) AS r, '{_M}' AS m FROM events) t"""


#: Commands by which clients take a password: what stands before it and behind it, with ``{r}`` for a digit of the event's.
_CLIENT_FORMS = (
    ("htpasswd -nb bob ", ""), ("htpasswd -b pw{r} bob ", ""), ("sqlplus u{r}/", ""), ("smbclient //h/s{r} ", " -c ls"), ("net use Z: /user:u{r} ", ""), ("composer config http-basic.h{r} u ", ""), ("poetry config pypi-token.p{r} ", ""),
    ("aws configure set aws_secret_access_key ", ""), ("npm config set //r{r}/:_authToken ", ""), ("setx DB_PASSWORD ", ""), ("cd a && ./run{r}.sh --key ", " prod"), ("echo ", " | docker login --password-stdin"), ("mysql -p", " db{r}"), ("sshpass -p ", " ssh h{r}"),
    ("setx EDITOR ", ""), ("npm config set registry ", ""), ("./run{r}.sh --name ", ""), ("net view ", ""), ("htpasswd -c f{r} ", ""),
)
_KEPT_FROM = 14


def client_passwords(spark: SparkSession, sf: str) -> DataFrame:
    """An event's command with a password at the place where its client takes one, or a word where none does; all rules are run."""
    e, k = spread(spark.read.parquet(f"{sf}/events.parquet").select("event_id"), "event_id"), F.col("event_id")
    put = lambda x: F.replace(F.lit(x), F.lit("{r}"), (k % 9).cast("string"))
    forms = [F.concat(put(a), F.lit("hunter2abcd12efgh"), k.cast("string"), put(b)) for a, b in _CLIENT_FORMS]
    made = F.coalesce(*(F.when(k % len(forms) == n, x) for n, x in enumerate(forms)))
    return e.select("event_id", redaction.redacted_by(redaction.RULES)(made).alias("command"))


_CLIENTS = "SELECT event_id, CASE event_id % " + str(len(_CLIENT_FORMS)) + "".join(
    f" WHEN {n} THEN replace('{a}', '{{r}}', r) || {chr(39) + marker('assignment') + chr(39) if n < _KEPT_FROM else chr(39) + 'hunter2abcd12efgh' + chr(39) + ' || event_id'} || replace('{b}', '{{r}}', r)" for n, (a, b) in enumerate(_CLIENT_FORMS)
) + " END AS command FROM (SELECT event_id, CAST(event_id % 9 AS VARCHAR) AS r FROM events) t"


def queries() -> dict:
    return {"log_dotenv_cuts": (log_dotenv_cuts, _CUTS), "log_redactions": (log_redactions, _COUNTS), "dotenv_commands": (dotenv_commands, _COMMANDS), "client_passwords": (client_passwords, _CLIENTS)}
