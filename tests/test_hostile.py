"""Texts made to stall a pattern: 200 KB each, and a second for every question."""

import time

import pytest

from logloom.functions import dependencies, dotenv, marks, paths, patterns, redaction, shell

N = 200_000
RUNS = ["a", " ", "\n", "=", ":", "'", '"', "(", "$(", "/", "\\", "-", ".", "<", ">", "*", "ab ", "a=", "a.", "a-b_", "--a ", "token", "token ", "token=", "password: ", "key=key", "KEY=", "pass", "auth:", "eyJ", "ghp_", "sk-", "://a:", "a@", "a@b.", "curl -u ", "mongo -u a ", "mysql ", "<<<", "<a>", "Bearer ", "cookie=", "machine a ", "&sig=", "-----BEGIN PRIVATE KEY", "[REDACTED:x]", "1.", "AA:", "a" * 23 + "."]
COMMANDS = ["git push ", "git push -f", "git ", "cat a ", "sed -i ", "<<E\n", "sed 's/a/b/' ", "rm -rf ", "$(a) ", "npm i ", "cd a;", "'a' ", '"', "\\", "DROP ", "DELETE FROM a ", "delete from ", "a>", "|| ", "git checkout ", "git -c a ", "./", "a:b:"]
SOURCES = ["catch (", "catch {", "catch(e){console.log(", "except", "except:", "except a:\n", "rescue => ", "catch (e) { //\n", "# noqa", "\n    #"]


def seconds(function, text):
    began = time.process_time()
    function(text)
    return time.process_time() - began


def filled(part):
    return (part * (N // len(part) + 1))[:N]


@pytest.mark.parametrize("part", [*RUNS, *COMMANDS])
def test_every_rule_and_mask(part):
    text = filled(part)
    for rule in redaction.RULES:
        assert seconds(lambda x, r=rule: list(r.spans(x)), text) < 1, rule.kind
    assert seconds(lambda x: paths.mask_text(x, paths.Roots.of("/home/ann/proj")), text) < 1


@pytest.mark.parametrize("part", [*COMMANDS, "a", " ", "'", "(", "a=", "<", "a b "])
def test_every_question_of_a_command(part):
    text = filled(part)
    for ask in (shell.segments, shell.writes, shell.git_commands, shell.only_looks, shell.read_paths, shell.edit_words, shell.installed, shell.destruction, shell.failed_check, shell.revert_targets, marks.runs_check, marks.test_blocks, marks.skips, dotenv.reads, dotenv.learned):
        assert seconds(ask, text) < 1.5, ask.__name__


@pytest.mark.parametrize("part", [*COMMANDS, ".env ", "> .env\n", "<<E\n.env\nE\n", "A=.env;", "$A ", "open('.env','w') ", "sed -i .env ", "tee ", "for f in "])
def test_writes_of_dotenv_files(part):
    assert seconds(dotenv.cut_writes, ".env " + filled(part)[: N // 4]) < 2


@pytest.mark.parametrize("part", SOURCES)
def test_handlers_that_only_log(part):
    assert seconds(patterns.logged_only, filled(part)) < 1


@pytest.mark.parametrize("part", ["[a]\n", 'a = "1"\n', "a = [", '"a": "1",', "<artifactId>", "a==1\n", "[[", "gem '"])
def test_manifests(part):
    for path in ("Cargo.toml", "package.json", "x.txt"):
        assert seconds(lambda x, p=path: dependencies.added(p, "", x), filled(part)[: N // 4]) < 1.5


def test_globs_with_many_stars():
    assert seconds(lambda x: shell.same_path("*a" * 500 + "b", x), "a" * 4000) < 1
    assert seconds(lambda x: shell.same_path("**/a" * 300 + "b", x), "a/" * 2000) < 1


def test_suppression_patterns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(filled(x),) for x in SOURCES], "text string").cache()
    rows.count()
    assert seconds(lambda _: rows.select(marks.silenced_of(F.lit(""), F.col("text"))).collect(), None) < 2 * len(SOURCES)
