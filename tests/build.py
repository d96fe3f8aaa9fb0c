"""Hand-built sessions."""

import json


class Builder:
    def __init__(self, session="s1", cwd="/home/ann/proj"):
        self.session, self.cwd, self.records, self.minute = session, cwd, [], 0

    def _add(self, kind, content, minute=None, **extra):
        self.minute = self.minute + 1 if minute is None else minute
        n = len(self.records)
        stamp = f"2026-08-16T{9 + self.minute // 60:02d}:{self.minute % 60:02d}:00.000Z"
        record = {"type": kind, "uuid": f"u{n}", "parentUuid": f"u{n - 1}" if n else None, "sessionId": self.session, "cwd": self.cwd, "gitBranch": "main", "version": "1.0", "timestamp": stamp, "message": {"role": kind, "content": content}}
        self.records.append(record | extra)
        return n

    def use(self, name, call=None, minute=None, **given):
        call = call or f"c{len(self.records)}"
        self._add("assistant", [{"type": "tool_use", "id": call, "name": name, "input": given}], minute)
        return call

    def result(self, call, text="ok", error=False, minute=None, **detail):
        block = {"type": "tool_result", "tool_use_id": call, "content": text} | ({"is_error": True} if error else {})
        self._add("user", [block], minute, **({"toolUseResult": detail} if detail else {}))

    def run(self, command, text="ok", error=False):
        self.result(self.use("Bash", command=command), text, error)

    def edit(self, path, old, new, tool="Edit", **more):
        self.result(self.use(tool, file_path=path, old_string=old, new_string=new, **more))

    def padded(self, n=17):
        for k in range(n):
            if k < 3:
                self.use("Glob", pattern="*.md")
            else:
                self._add("assistant", [{"type": "text", "text": "working"}])
        return self

    def lines(self):
        return [json.dumps(r) for r in self.records]


def table(spark, *sessions):
    rows = [(name, k, line) for name, lines in sessions for k, line in enumerate(lines)]
    return spark.createDataFrame(rows, "session_id string, line_no int, line string")
