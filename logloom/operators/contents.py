"""Following a file's content through a session, to see it return to an earlier state.

Content is a fold over the file's own calls: each depends on the text that the one before left, so
it can't be a window. A task goes through its files one after another, each in the order of its calls.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = "session_id string, file_path string, record_index int, call_seq int, name string, file_content string, content string, olds array<string>, news array<string>, replace_all boolean"
RETURNED = "session_id string, file_path string, record_index int, call_seq int"
#: Characters of a file that are followed; a larger text is unknown from then on.
MOST_CHARS = 32 * 1024 * 1024


def normalise(text: str) -> str:
    lines = text.replace("\r\n", "\n").split("\n")
    return "\n".join(x.rstrip() for x in lines).rstrip("\n")


def digest(text: str) -> str:
    return hashlib.sha1(normalise(text).encode("utf-8", "surrogatepass")).hexdigest()


def apply_edit(text: str, old: str | None, new: str | None, every: bool) -> str | None:
    """A literal replacement, or None if it can't be made."""
    if not old or new is None or old not in text:
        return None
    out = text.replace(old, new) if every else text.replace(old, new, 1)
    return out if len(out) <= MOST_CHARS else None


class _File:
    """A file's content and states as its calls go by."""

    def __init__(self) -> None:
        self.text, self.seen, self.last, self.edited = None, {}, None, False

    def step(self, c: dict) -> bool:
        """Whether a call brings the file back to a state that it had at an earlier record."""
        if c["name"] == "Read" and c["file_content"] is not None:
            self.text, is_edit = c["file_content"], False
        elif c["name"] == "Write" and c["content"] is not None:
            self.text, self.edited, is_edit = c["content"], True, True
        elif c["name"] in ("Edit", "MultiEdit"):
            self.edited = is_edit = True
            for old, new in zip(c["olds"] or [], c["news"] or [], strict=True):
                self.text = None if self.text is None else apply_edit(self.text, old, new, bool(c["replace_all"]))
        else:
            return False
        if self.text is None:
            return False
        key = digest(self.text)
        first, unchanged, self.last = self.seen.get(key), key == self.last, key
        if is_edit and self.edited and not unchanged and first is not None and first < c["record_index"]:
            return True
        if first is None:
            self.seen[key] = c["record_index"]
        return False


def returns(calls: list[dict]) -> list[dict]:
    """The calls of one file that bring it back to a state that it had at an earlier record."""
    file = _File()
    return [c for c in calls if file.step(c)]


def returned(steps: DataFrame) -> DataFrame:
    """The calls that bring their file back, in a task's order of files: many files share a batch, and only the present file is held."""
    key = ("session_id", "file_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, file = None, _File()
        for batch in batches:
            found = []
            for k, c in enumerate(batch.to_pylist()):
                own = (c["session_id"], c["file_path"])
                if own != here:
                    here, file = own, _File()
                if file.step(c):
                    found.append(k)
            yield batch.select([*key, "record_index", "call_seq"]).take(pa.array(found, pa.int32()))

    return steps.repartition(*key).sortWithinPartitions(*key, "call_seq").mapInArrow(run, RETURNED)


def steps_of(uses: DataFrame) -> DataFrame:
    """The calls that say something of a file's content."""
    one = lambda k: F.try_variant_get("input", k, "string")
    many = F.try_variant_get("input", "$.edits", "array<variant>")
    side = lambda k: F.when(many.isNotNull(), F.transform(many, lambda x: F.try_variant_get(x, f"$.{k}", "string"))).otherwise(F.array(one(f"$.{k}")))
    u = uses.where("file_path IS NOT NULL").where(F.col("name").isin("Read", "Write", "Edit", "MultiEdit"))
    return u.select(
        F.col("session_id").cast("string"), "file_path", F.col("record_index").cast("int"), F.col("call_seq").cast("int"), "name",
        F.col("result.file_content").alias("file_content"), one("$.content").alias("content"), side("old_string").alias("olds"), side("new_string").alias("news"),
        F.coalesce(F.try_variant_get("input", "$.replace_all", "boolean"), F.lit(False)).alias("replace_all"),
    )
