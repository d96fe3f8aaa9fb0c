"""Scalar operators over the events table: each event asks one of a list of cases, and the SQL states the answers.

Inputs and answers are written out by hand, so the SQL shares nothing with the code but the cases' numbers.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dependencies, dotenv, fixed, marks, patch, paths, redaction, shell
from ..functions import text as t


def _said(flag: Column) -> Column:
    return flag.cast("string")


def _joined(array: Column, by: str = ",") -> Column:
    return F.array_join(array, by)


def _udf(function, *columns: Column) -> Column:
    @F.pandas_udf("string")
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*values, strict=True)], dtype=object)

    return run(*columns)


def _hidden(*parts: str) -> str:
    """A made-up token, put together here so that no scanner takes this file for a leak."""
    return "".join(parts)


_GH = _hidden("ghp", "_", "a1" * 18)
_M = {k: f"[{fixed.PREFIX}:{k}]" for k in ("assignment", "email", "host", "project", "connection_string", "authorization", "bearer_token", "cookie", "github_token", "service_token", "aws_key", "jwt", "private_key", "slack_token", "anthropic_key", "openai_key", "google_key", "stripe_key", "npm_token")}
_LONG_GLOB = "/".join(["a" * 90] * 4)

#: name: (columns of a case, the operator over them, cases with the answer last).
CASES: dict = {
    "shell_segments": (("command",), lambda c: _joined(shell.segments_of(c), "¦"), [
        ("a; b && c | d", "a¦ b ¦ c ¦ d"), ('grep -E "A|B;C" f', 'grep -E "A|B;C" f'), ("x $(grep -l 'a;b' .) y", "x   y¦grep -l 'a;b' ."), (r"echo 'it''s | x'\; y", r"echo 'it''s | x'\; y"),
        ("cat <<EOF\nrm -rf src\nEOF\nls", "cat <<EOF¦ls"), ("cat <<< word\nls", "cat <<< word¦ls"), ("cat <<-'E' > f\n\tbody; x\n\tE\npwd", "cat <<-'E' > f¦pwd"), ("a || b", "a ¦ b"),
    ]),
    "shell_writes": (("command",), lambda c: _said(shell.writes_of(c)), [
        ("sed -i 's/a/b/' x", "true"), ("sed -n 's/ -i //p' x", "false"), ("echo a > b", "true"), ("ls 2>&1 >/dev/null", "false"), ("cat <<E | python3 -\nopen()\nE", "false"), ("python3 - <<'E'\nopen('x','w')\nE", "true"),
        ("grep '->' a", "false"), ("x | tee out.txt", "true"), ("mv a b", "true"), ("gawk -i inplace '{print}' f", "true"), ("gawk -v inplace f", "false"), ("perl -0pi -e 1 f", "true"), ("perl -Ilib -e 1 f", "false"), ("rm -rf dist", "false"),
        ("git apply p.diff", "true"), ("cmd >> log.txt", "true"), ("x | tee -a /tmp/y", "false"), ("sudo git restore a.py", "true"), ("sort a 2> err.txt", "true"), ("cat < a.txt", "false"), ("if sed -Ei 's/a/b/' x; then ls; fi", "true"),
    ]),
    "shell_git_commands": (("command",), lambda c: _joined(shell.git_commands_of(c)), [
        ("FOO=1 git -C app commit -m 'git push' && git push", "commit,push"), ("pytest tests/git/", ""), ("if git diff --quiet; then git commit -m x; fi", "diff,commit"), ("sudo git -c a=b --no-pager log", "log"),
        ("(git stash)", "stash"), ("time git fetch origin", "fetch"), ("echo git commit", ""), ("npm --prefix tools/commit run dev", ""),
    ]),
    "shell_only_looks": (("command",), lambda c: _said(shell.only_looks_of(c)), [
        ("git status && cat a | sort", "true"), ("make", "false"), ("sort -o x y", "false"), ("git checkout main", "true"), ("git checkout -- a.py b.py", "false"), ("sed -n 'w out' x", "false"), ("sed -n 's/a/b/gw out' x", "false"),
        ("cd src && ls -la", "true"), ("npm test", "false"), ("awk '{print $1}' f", "true"), ("awk '{print > \"x\"}' f", "false"), ("awk '$1 > 5' f", "true"), ("# note", "true"), ("git checkout -b feature", "true"), ("gh pr checkout 12", "false"),
        ("gh pr view 12", "true"), ("echo x > *.txt", "false"), ("cat a > b", "true"), ("git log --output x", "false"), ("uniq a b", "false"), ("uniq -c a", "true"),
    ]),
    "shell_read_paths": (("command",), lambda c: _joined(shell.read_paths_of(c)), [
        ("cat ./src/a.py main:lib/b.ts && sed -n '1,2p' src/c.py", "src/a.py,lib/b.ts,src/c.py"), ("sed -i 's/a/b/' src/c.py", ""), ("grep -rn foo src/ | head", "src/"), ("git show HEAD:src/x.rs", "src/x.rs"),
        ("cat src/*.js > out.txt", "src/*.js"), ("head -n 5 notes.md", "notes.md"), ("cat .", ""), ("echo src/a.py", ""), ("wc -l $FILE a.txt", "a.txt"), ("sudo cat /etc/hosts", "/etc/hosts"), ("cat <<E\nsrc/no.py\nE", ""),
    ]),
    "shell_edit_paths": (("command", "cwd"), lambda c, d: _joined(shell.edit_paths_of(c, d)), [
        ("cd sub; sed -i '' 's/a/b/' x.py *.ts", "/w", "/w/sub/x.py"), ("cd ~; sed -i 's/a/b/' x.py", "/w", "x.py"), ("sed -i.bak -e 's/a/b/' a.c b.c", "/w", "/w/a.c,/w/b.c"), ("perl -pi -e 's/x/y/' ./lib/m.pl", "/w", "/w/lib/m.pl"),
        ("awk '{print}' f", "/w", ""), ("sed -i 's/a/b/' ../o.txt", "/w/p", "/w/o.txt"), ("sed -i 's/a b/c/' f > log", "", "f"), ("gawk -i inplace -v x=1 '{print}' f.csv", "/w", "/w/f.csv"), ("sed -i '$a K=v' conf", "/w", "/w/conf"), ("sed -n p f", "/w", ""),
    ]),
    "tool_may_write": (("tool", "keys"), lambda n, k: _said(shell.may_write_of(n, F.filter(F.split(k, ","), lambda x: x != ""))), [
        ("NewTool", "path", "true"), ("NewTool", "", "true"), ("NewTool", "subject", "false"), ("mcp__fs__write_file", "path", "true"), ("mcp__fs__read_file", "path", "false"), ("mcp__fs__writeFile", "path", "true"), ("mcp__fs__write_file", "subject", "false"),
        ("TaskCreate", "subject", "false"), ("REPL", "", "true"), ("apply_patch", "input", "true"), ("ClaudeDesign", "path", "false"), ("Edit", "file_path", "false"), ("GetGoal", "", "false"),
    ]),
    "shell_installed": (("command",), lambda c: F.coalesce(F.concat_ws(": ", shell.installed_of(c)["manager"], _joined(shell.installed_of(c)["packages"])), F.lit("")), [
        ("npm i --registry http://x left-pad@1.0.0 > log", "npm: left-pad@1.0.0"), ("pip install -r requirements.txt", ""), ("pip3 install 'requests>=2' flask", "pip: requests>=2,flask"), ("cargo add serde --features derive", "cargo: serde"),
        ("uv pip install torch", "pip: torch"), ("uv add httpx", "uv: httpx"), ("yarn add react react-dom && yarn test", "yarn: react,react-dom"), ("npm install", ""), ("go get github.com/x/y@v1.2", "go: github.com/x/y@v1.2"), ("npm install left-pad.", "npm: left-pad"),
        ("pip install --target lib @s/x $PKG", "pip: @s/x"), ("pip install pip", ""),
    ]),
    "added_dependencies": (("path", "old", "new"), lambda p, a, b: _joined(dependencies.added_of(p, a, b)), [
        ("pyproject.toml", "", "[project]\ndependencies = [\"tomli; python_version < '3.11'\", \"b[x]>=1\"]\nversion = \"1\"", "b,tomli"), ("package.json", '{"a": "^1"}', '{"a": "^1", "b": "~2", "name": "x"}', "b"), ("go.mod", "", "require github.com/x/y v1.2.0", "github.com/x/y"),
        ("Cargo.toml", "", '[dependencies]\nserde = "1"\n[dependencies.tokio]\nversion = "1"', "serde,tokio"), ("requirements.txt", "flask==1", "flask==1\nrequests>=2", "requests"), ("Gemfile", "", "gem 'rails', '~> 7'", "rails"), ("pom.xml", "", "<artifactId>junit</artifactId>", "junit"),
        ("build.gradle", "", "implementation 'org.x:lib:1.0'", "org.x:lib"), ("Cargo.toml", "", 'serde = { version = "1" }', "serde"), ("pyproject.toml", "", 'dwmt = "dwmt.cli:main"', ""), ("package.json", "", '"left-pad": "^1.0.0",\n', "left-pad"), ("Cargo.toml", "", "[dependencies]\nserde.workspace = true", "serde"),
        ("pyproject.toml", "", '[dependency-groups]\ntest = ["pytest>=7"]\n[tool.poetry.dependencies]\npython = "^3.9"\nhttpx = "*"', "httpx,pytest"),
    ]),
    "same_path": (("known", "path"), lambda k, p: _said(shell.same_path_of(k, p)), [
        ("src/a.py", "src/a.py", "true"), ("src", "src/a.py", "true"), ("/w/src/a.py", "src/a.py", "true"), ("a.py", "/w/src/a.py", "true"), ("src/*.py", "src/a.py", "true"), ("src/*.py", "src/x/a.py", "false"), ("src/**/a.py", "src/x/y/a.py", "true"), ("src/**/a.py", "src/a.py", "true"),
        ("b.py", "src/ab.py", "false"), ("/*.py", "src/a.py", "false"), ("*.py", "src/x/a.py", "true"), ("src/a?.py", "src/ab.py", "true"), ("src/a?.py", "src/a/.py", "false"), ("a**b", "x/a/y/b", "true"), ("*a*a*a*a*a*a*a*a*b", _LONG_GLOB, "false"), ("/w/**/*.ts", "/w/a/b.ts", "true"),
    ]),
    "shell_destruction": (("command",), lambda c: F.concat_ws("|", shell.destruction_of(c)["weight"].cast("string"), shell.destruction_of(c)["detail"]), [
        ("rm -rf src/old dist", "0.6|deleted recursively: src/old"), ("git push --force", "0.7|a branch was force-pushed"), ("git push --force-with-lease", ""), ("git push origin main -f", "0.7|a branch was force-pushed"), ("git clean -fdx", "0.6|untracked files were deleted by git clean"),
        ("git branch -D x", "0.5|a branch was deleted unmerged"), ("git branch -d x", ""), ("git reset --hard HEAD~1", "0.6|the working tree was reset, discarding uncommitted work"), ("psql -c 'DROP TABLE users'", "0.8|a database object was dropped"), ("psql -c 'TRUNCATE users'", "0.8|a table was truncated"),
        ("sqlite3 x 'DELETE FROM t;'", "0.8|rows were deleted with no WHERE clause"), ("sqlite3 x 'DELETE FROM t WHERE a=1'", ""), ("grep 'DROP TABLE' s.sql", ""), ("cat <<EOF\nrm -rf src\nEOF", ""), ("rm -rf node_modules ~/x", ""), ("rm -r a b c d", "0.6|deleted recursively: a, b, c and 1 more"),
        ("rm file.txt", ""), ("psql -c 'drop index i'", "0.5|an index was dropped"), ("git reset --hard && git clean -fd", "0.6|the working tree was reset, discarding uncommitted work; untracked files were deleted by git clean"),
    ]),
    "shell_revert_targets": (("command",), lambda c: F.concat_ws("|", shell.revert_targets_of(c)["everything"].cast("string"), _joined(shell.revert_targets_of(c)["names"])), [
        ("git reset --hard", "true|"), ("git stash", "true|"), ("git stash pop", ""), ("git checkout -- src/a.py ./b.py", "false|a.py,b.py"), ("git checkout .", "true|."), ("git restore src/x.ts && ls", "false|x.ts"), ("git checkout main", "false|main"), ("git status", ""), ("git reset --soft HEAD", ""),
    ]),
    "check_commands": (("command",), lambda c: _said(marks.checks(F.lit("Bash"), c)), [
        ("npm run build", "true"), ("node --test", "true"), ("npx jest", "true"), ("python3.11 -m pytest", "true"), ("cargo clippy", "true"), ("echo hi", "false"), ("make install", "false"), ("bundle exec rspec", "true"), ("latest", "false"), ("go vet ./...", "true"), ("pnpm lint", "true"), ("gradle :app:test", "true"), ("cmake --build .", "true"), ("testing npm", "false"),
    ]),
    "suppression_added": (("old", "new"), lambda a, b: marks.silenced_of(a, b), [
        ("x", "x  # noqa", "a lint error was suppressed"), ("// @ts-ignore", "// @ts-ignore\n// @ts-ignore", "a TypeScript error was suppressed"), ("try {} catch (e) { f() }", "try {} catch (e) { }", "an exception is caught and dropped"), ("", "except ValueError:\n    pass", "an exception is caught and dropped"),
        ("", "rescue => e\nend", "an exception is caught and dropped"), ("# noqa", "x", None), ("", "#[allow(dead_code)]", "a Rust lint was allowed"), ("", '@SuppressWarnings("x")', "a compiler warning was suppressed"), ("", "/* eslint-disable-next-line */", "an ESLint rule was disabled"), ("", "x: ignore", None),
        ("", "x = f()  # type: ignore", "a type error was suppressed"), ("", "#pylint:disable=x", "a pylint rule was disabled"),
    ]),
    "logged_only": (("old", "new"), lambda a, b: _said(shell.logged_only_of(a, b)), [
        ("", "try { f() } catch (e) { console.error(e); }", "true"), ("", 'const s = "catch (e) { console.log(e) }"', "false"), ("", "catch (e) {\n  console.error(\n    e,\n  );\n}", "true"), ("", "catch (e) { log.warn(e); return null; }", "true"), ("", "catch (e) { log.warn(e); throw e; }", "false"),
        ("", "except E as e:\n    logger.error(e)\n    return None\n", "true"), ("", "except E:\n    print(1)\n    raise", "false"), ("catch (e) { console.log(e) }", "catch (e) { console.log(e) }", "false"), ("", "catch {\n  // never mind\n  this.logger.info('x');\n}", "true"),
    ]),
    "weakened_tests": (("old", "new"), lambda a, b: marks.weakened_of(a, b), [
        ("expect(a)\nexpect(b)", "expect(a)", "assertions removed from the test"), ("a", "it.only('x')", "test marked as skipped or ignored"), ("it(1)\nit(2)", "it(1)", "a test case was deleted"), ("x", "y", None), ("def test_a():\n  1", "pass", "a test case was deleted"), ("a", "@pytest.mark.skipif(x)", "test marked as skipped or ignored"), ("assert x", "assert y", None),
    ]),
    "masked_paths": (("text", "cwd"), lambda x, c: paths.mask_text_of(x, c), [
        ("/home/ann/proj/src/a.ts", "/home/ann/proj", "src/a.ts"), ("see /home/ann/proj/src/a.ts:12.", "/home/ann/proj", "see src/a.ts:12."), ("C:\\Users\\joe\\a", "/home/ann/proj", "~\\a"), ("https://a.b/home/ann/proj", "/home/ann/proj", "https://a.b/home/ann/proj"),
        ("\\\\host\\share", "/home/ann/proj", f"\\\\{_M['host']}\\share"), ("file:///home/ann/x", "/home/ann/proj", "file://~/x"), ("../up/x.ts", "/home/ann/proj", "../up/x.ts"), ("/Users/Shared/x", "/home/ann/proj", "/Users/Shared/x"), ("(/home/bob/y)", "/home/ann/proj", "(~/y)"),
        ("-home-ann-proj", "/home/ann/proj", _M["project"]), ("cd /home/ann/proj", "/home/ann/proj", "cd ."), ("a/b/c", "/home/ann/proj", "a/b/c"), ("~/x and /usr/lib/z", "/home/ann/proj", "~/x and /usr/lib/z"), ("/home/ann/x.txt.", "/home/ann/proj", "~/x.txt."), ("/HOME/Ann/proj/A", "/home/ann/proj", "A"), ("line\\n/home/ann/q", "/home/ann/proj", "line\\n~/q"),
    ]),
    "in_project_tree": (("path", "cwd"), lambda p, c: _said(paths.in_tree_of(p, c)), [
        ("/home/ann/proj/a", "/home/ann/proj", "true"), ("/etc/hosts", "/home/ann/proj", "false"), ("src/a", "/home/ann/proj", "true"), ("/home/ann/other", "/home/ann/proj", "true"), ("/etc/hosts", None, "true"), (None, "/home/ann/proj", "true"),
    ]),
    "redacted_texts": (("text",), lambda x: redaction.redacted_by(redaction.RULES)(x), [
        ("DB_PASSWORD=hunter2hunter2", f"DB_PASSWORD={_M['assignment']}"), ("adminPassword = someVariable", "adminPassword = someVariable"), ('accessToken: "abcdefgh1234"', f'accessToken: "{_M["assignment"]}"'), ("_authToken=abcdef12345", f"_authToken={_M['assignment']}"),
        ("see me.x@site.co.uk now", f"see {_M['email']} now"), ("mongodb://u:hunter22@h/d", f"mongodb://u:{_M['connection_string']}@h/d"), ("Authorization: Basic dXNlcjpwYXNz", f"Authorization: Basic {_M['authorization']}"), ("Bearer abcdef1234", f"Bearer {_M['bearer_token']}"), ("Bearer authentication", "Bearer authentication"),
        ("STRIPE_KEY=abc123def456ghi", f"STRIPE_KEY={_M['assignment']}"), ("SORT_KEY=created_at", "SORT_KEY=created_at"), ("run --token abcd1234efgh x", f"run --token {_M['assignment']} x"), ("curl -u me:hunter22 x", f"curl -u me:{_M['assignment']} x"), ("mysql -phunter22 db", f"mysql -p{_M['assignment']} db"),
        ("mongo -u a -p hunter22", f"mongo -u a -p {_M['assignment']}"), ("docker run --name mongo -p 27017:27017", "docker run --name mongo -p 27017:27017"), ("<password>hunter22x</password>", f"<password>{_M['assignment']}</password>"), ("https://x/?X-Amz-Signature=abcdef123456&a=1", f"https://x/?X-Amz-Signature={_M['assignment']}&a=1"),
        ("Cookie: sid=abcdefghijk; x=y", f"Cookie: {_M['cookie']}"), ("max_tokens: 4096000000", "max_tokens: 4096000000"), ("auth: described elsewhere", "auth: described elsewhere"), ("secret = $SECRET_FROM_ENV", "secret = $SECRET_FROM_ENV"), ("the password is checked below", "the password is checked below"),
        ("ALTER USER x IDENTIFIED BY 'hunter22x'", f"ALTER USER x IDENTIFIED BY '{_M['assignment']}'"), (_hidden("12345678", ":AA", "bcdefghijklmnopqrstuvwxyz0123456"), f"12345678{_M['service_token']}"), (f"a {_GH} b", f"a {_M['github_token']} b"), (_hidden(_GH, "passwd=hunter22x9"), _M["github_token"]),
        (_hidden("AK", "IA", "A1" * 8), _M["aws_key"]), (_hidden("eyJ", "a" * 12, ".", "b" * 12, ".", "c" * 12), _M["jwt"]), (_hidden("-----BEGIN RSA PRIV", "ATE KEY-----\nabc"), _M["private_key"]), (_hidden("xox", "b-1234567890-ab"), _M["slack_token"]), (_hidden("sk-", "ant-", "x" * 20), _M["anthropic_key"]), (_hidden("sk-", "y1" * 10), _M["openai_key"]),
        (_hidden("AI", "za", "B" * 35), _M["google_key"]), (_hidden("sk_", "live_", "c2" * 10), _M["stripe_key"]), (_hidden("npm", "_", "d3" * 18), _M["npm_token"]), (_hidden("gs", "k_", "a" * 40), _M["service_token"]), (_hidden("hf", "_", "e" * 32), _M["service_token"]), (_hidden("gl", "pat-", "f" * 20), _M["service_token"]),
        ('{"token": 1234567890}', '{"token": 1234567890}'), ("password: 'a b'", "password: 'a b'"), (f"password={_M['email']}", f"password={_M['email']}"),
    ]),
    "sensitive_keys": (("key", "value"), lambda k, v: _udf(lambda a, b: str(redaction.sensitive(a, b)).lower(), k, v), [
        ("password", "hunter22", "true"), ("apiKey", "hunter22", "true"), ("tokenHash", "hunter22", "false"), ("max_tokens", "hunter22", "false"), ("SECRET_KEY_BASE", "hunter22", "true"), ("PASSWORD_FILE", "/run/secret", "false"), ("password", "short", "false"), ("STRIPE_KEY", "abc123def456", "true"), ("SORT_KEY", "created_at", "false"), ("bypass", "hunter22", "false"), ("dbPass", "hunter22", "true"), ("accessToken2", "hunter22", "true"), ("token0", "hunter22", "false"), ("token_2022", "hunter22", "false"),
    ]),
    "dotenv_paths": (("path",), lambda p: _udf(lambda x: str(dotenv.is_dotenv(x)).lower(), p), [
        (".env", "true"), ("app/.env.local", "true"), (".env.example", "true"), ("x.env", "true"), (".env*", "true"), (".environment", "true"), ("process.env", "false"), ("a/env", "false"), ("src/foo.env.ts", "false"),
    ]),
    "learned_values": (("text",), lambda x: _udf(lambda v: ",".join(dotenv.learned(v)), x), [
        ("DB=longsecretval9", "longsecretval9"), ("export A_TOKEN='quoted value 1'\nB=\"two words\"", "quoted value 1"), ("PORT=8080\nMODE=production", ""), ("URL=https://a.b/c", ""), ("A=short", ""), ("DB_PASSWORD=hunter22x; ls", "hunter22x"),
    ]),
    "parsed_patches": (("text",), lambda x: _udf(lambda v: json.dumps(patch.parse_patch(v), sort_keys=True), x), [
        ("*** Begin Patch\n*** Add File: n.py\n+a\n*** End Patch", '[{"input": {"content": "a\\n", "file_path": "n.py"}, "name": "Write"}]'),
        ("*** Begin Patch\n*** Update File: u.py\n@@\n ctx\n-old\n+new\n*** End Patch", '[{"input": {"file_path": "u.py", "new_string": "ctx\\nnew", "old_string": "ctx\\nold"}, "name": "Edit"}]'),
    ]),
    "argv_commands": (("argv",), lambda x: _udf(lambda v: shell.argv_command(v.split("|")), x), [
        ("bash|-lc|ls -l", "ls -l"), ("/bin/sh|-c|a && b", "a && b"), ("ls|-l|src", "ls -l src"), ("zsh|-x", "zsh -x"),
    ]),
    "exec_failures": (("text",), lambda x: _said(t.exec_failed(x)), [
        ("Process exited with code 1", "true"), ("Process exited with code 0", "false"), ('{"exit_code": 2}', "true"), ('{"exit_code":0}', "false"), ("ok", "false"), ("Process exited with code -9", "true"),
    ]),
    "remote_names": (("url",), lambda x: t.remote_name(x), [
        ("git@host.org:own/name.git", "own/name"), ("https://u@host.org/own/name/", "own/name"), ("ssh://git@h:22/a/b/c.git", "a/b/c"), ("https://host.org/only", None), ("nonsense", None),
    ]),
    "newer_versions": (("latest", "current"), lambda a, b: _said(t.is_newer(a, b)), [("1.10.0", "1.9", "true"), ("1.0", "1.0.0", "false"), ("v2.0.1", "2.0.0", "true"), ("1.9", "1.10", "false"), ("3", "2.9.9", "true")]),
    "folders_within": (("top", "folder"), lambda a, b: _said(t.is_within(a, b)), [("/a", "/a/b", "true"), ("/a", "/ab", "false"), ("/a/", "/a", "true"), ("/", "/x", "true"), ("/a/b", "/a", "false")]),
    "package_names": (("specifier",), lambda x: t.package_name(x), [("@a/b@1.2", "@a/b"), ("requests>=2", "requests"), ("x[extra]==1", "x"), ("left-pad@^1.0.0", "left-pad"), ("plain", "plain")]),
    "upload_outcomes": (("status",), lambda x: t.upload_outcome(x.cast("int")), [("200", "ok"), ("204", "ok"), ("401", "unauthorized"), ("403", "unauthorized"), ("413", "permanent"), ("429", "throttled"), ("503", "retry"), (None, "retry")]),
    "epoch_times": (("number",), lambda x: t.epoch_ms(x.cast("double")).cast("string"), [("1700000000", "1700000000000"), ("1700000000000", "1700000000000"), ("1.5", "1500"), ("0", "0")]),
    "line_words": (("line",), lambda x: t.line_words(x), [("  a = b(1);", "ab1"), ("--- é_2 ---", "é2"), ("", ""), ("{}", "")]),
    "file_digests": (("text",), lambda x: t.digest(x), [
        ("a  \r\nb\n\n", "fcd127ffa1016069006ad91f3f361248f9bdf272"), ("", "da39a3ee5e6b4b0d3255bfef95601890afd80709"), ("abc", "a9993e364706816aba3e25717850c26c9cd0d89d"), ("abc\n\n", "a9993e364706816aba3e25717850c26c9cd0d89d"), ("abc \t\r\n", "a9993e364706816aba3e25717850c26c9cd0d89d"),
    ]),
    "test_and_code_files": (("path",), lambda p: F.concat_ws(",", _said(t.is_test_file(p)), _said(t.is_code_file(p)), _said(t.is_manifest(p))), [
        ("src/a.test.ts", "true,true,false"), ("x/tests/readme", "true,false,false"), ("UserSpec.java", "true,true,false"), ("src/latest.py", "false,true,false"), ("test.md", "false,false,false"), ("a/package.json", "false,false,true"), ("query.sql", "false,true,false"), ("a/__tests__/b.js", "true,true,false"),
    ]),
    "failed_checks": (("command",), lambda c: _said(shell.failed_check_of(c)), [("npm test | tail -5", "true"), ("grep -rn 'npm test' .", "false"), ("echo npm test", "false"), ("cd a && cargo build", "true"), ("ls", "false")]),
    "known_record_types": (("kind",), lambda k: _said(t.known_type(k)), [("user", "true"), ("tools-used", "true"), ("martian", "false"), ("api-request-blob", "true"), ("", "false")]),
    "patterns_silenced": (("text",), lambda x: _udf(lambda v: str(marks.assertions(v)), x), [("assert expect should", "3"), ("asserted", "0"), ("EXPECT(x)", "1")]),
}


def query(name: str):
    columns, operator, cases = CASES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = spark.createDataFrame([(k, *case[:-1]) for k, case in enumerate(cases)], ", ".join(["k long", *(f"{c} string" for c in columns)]))
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.pmod("event_id", F.lit(len(cases))).cast("long").alias("k"))
        # The list of cases has a fixed size.
        asked = events.join(F.broadcast(given), "k")
        return asked.select("event_id", operator(*(F.col(c) for c in columns)).alias("said"))

    run.__name__ = name
    return run


def _literal(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def sql(name: str) -> str:
    cases = CASES[name][2]
    rows = ",\n  ".join(f"({k}, {_literal(case[-1])})" for k, case in enumerate(cases))
    return f"SELECT event_id, said FROM events JOIN (VALUES\n  {rows}) AS v(k, said) ON event_id % {len(cases)} = k"


def queries() -> dict:
    return {name: (query(name), sql(name)) for name in CASES}
