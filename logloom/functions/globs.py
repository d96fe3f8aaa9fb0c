"""Many globs over many paths in one walk a path.

A glob's folders are a way through a trie: plain names are its edges, names with ``*`` or ``?`` are edges that are tried, ``**/`` is a node
that any folder leads back to, and a closing ``**`` takes whatever is left. A relative glob may begin at any folder of a path. A
path's folders move a set of nodes along, so what globs share is walked once and no glob is held up to a path that leaves it at its first
folder. Only a ``**`` inside of a name, which crosses folders from there, is matched by itself.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shell import Glob


class _Node:
    __slots__ = ("plain", "tried", "deep", "here", "below", "again")

    def __init__(self):
        self.plain: dict[str, _Node] = {}
        self.tried: dict[str, tuple[Glob, _Node]] = {}
        self.deep: _Node | None = None
        #: Globs that end here, and globs that take all that is left.
        self.here: list[str] = []
        self.below: list[str] = []
        self.again = False

    def step(self, name: str) -> _Node:
        if name == "**":
            if self.again:  # **/**/ is **/
                return self
            self.deep = self.deep or _Node()
            self.deep.again = True
            return self.deep
        if "*" in name or "?" in name:
            if name not in self.tried:
                self.tried[name] = (Glob("/" + name), _Node())
            return self.tried[name][1]
        return self.plain.setdefault(name, _Node())


class GlobIndex:
    def __init__(self, globs: Iterable[str]):
        self.fixed, self.free, self.alone = _Node(), _Node(), []
        for glob in dict.fromkeys(globs):
            names = glob.split("/")
            if any("**" in x and x != "**" for x in names):
                self.alone.append((glob, Glob(glob)))
                continue
            node = self.fixed if glob.startswith("/") else self.free
            for name in names[:-1]:
                node = node.step(name)
            if names[-1] == "**":
                node.below.append(glob)
            else:
                node.step(names[-1]).here.append(glob)

    def matches(self, path: str) -> set[str]:
        """The globs that name a path."""
        names = path.split("/")
        found = {glob for glob, matcher in self.alone if matcher.matches(path)}
        now: dict[int, _Node] = {id(self.fixed): self.fixed}
        for k, name in enumerate(names):
            now[id(self.free)] = self.free
            pending = list(now.values())
            while pending:  # ** may stand for no folder
                node = pending.pop()
                if node.deep is not None and id(node.deep) not in now:
                    now[id(node.deep)] = node.deep
                    pending.append(node.deep)
            after: dict[int, _Node] = {}
            last = k == len(names) - 1
            for node in now.values():
                found.update(node.below)
                if node.again and not last:
                    after[id(node)] = node
                reached = [node.plain[name]] if name in node.plain else []
                reached += [to for matcher, to in node.tried.values() if matcher.matches("/" + name)]
                for to in reached:
                    if last:
                        found.update(to.here)
                    else:
                        after[id(to)] = to
            now = after
        return found


def matched(globs: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs (session_id, path, file_path) of globs (session_id, path) and files (session_id, file_path) of a session: its distinct paths are a group."""

    def run(table: pa.Table) -> pa.Table:
        index = GlobIndex(x for x in table["path"].to_pylist() if x is not None)
        session, out = table["session_id"][0], []
        for file in table["file_path"].to_pylist():
            if file is not None:
                out += [(glob, file) for glob in sorted(index.matches(file))]
        return pa.table({"session_id": pa.array([session.as_py()] * len(out), session.type), "path": pa.array([g for g, _ in out], pa.string()), "file_path": pa.array([f for _, f in out], pa.string())})

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    # Sessions without a glob are left out before anything is grouped.
    asked = files.select("session_id", "file_path").distinct().join(globs.select("session_id").distinct(), "session_id", "left_semi")
    rows = globs.select("session_id", "path").distinct().withColumn("file_path", F.lit(None).cast("string")).unionByName(asked.withColumn("path", F.lit(None).cast("string")))
    return rows.repartition("session_id").groupBy("session_id").applyInArrow(run, f"session_id {dict(files.dtypes)['session_id']}, path string, file_path string")
