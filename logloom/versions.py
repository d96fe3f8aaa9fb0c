"""Tables that several writers change: versions, of which one writer makes the next and the others start again from it.

A version is a claim, a small file named by its number that says where the data lie. It is written under another name and then put in
its place by an operation that fails if the place is taken: a hard link on a local disk, a rename without overwriting on a store whose
renames are atomic, as those of HDFS are. Whoever loses reads the winner's version, makes its change again on top of it and tries
the next number, so no change is lost and no version is ever changed. A writer that dies leaves data that no claim names, and nothing else.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Claims:
    """Numbered claims at a place, each a JSON object."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def latest(self) -> tuple[int, dict]:
        """The last claim's number and what it says; 0 and nothing if there is none."""
        found = self._fs().globStatus(self._path("claims/*.json"))
        number = max((int(x.getPath().getName()[:-5]) for x in found or ()), default=0)
        return number, self.read(number) if number else {}

    def read(self, number: int) -> dict:
        stream = self._fs().open(self._path(f"claims/{number}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def claim(self, number: int, what: dict) -> bool:
        """Make claim ``number`` unless somebody has."""
        fs, target, draft = self._fs(), self._path(f"claims/{number}.json"), self._path(f"drafts/{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        try:
            return self._put(fs.makeQualified(draft), fs.makeQualified(target))
        finally:
            fs.delete(draft, False)

    def _put(self, draft, target) -> bool:
        if draft.toUri().getScheme() == "file":
            try:
                os.link(*(unquote(urlparse(str(p.toUri())).path) for p in (draft, target)))
            except FileExistsError:
                return False
            return True
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, no_options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True


class Versions(Claims):
    """A table by versions, each a folder of Parquet."""

    def table(self, number: int | None = None) -> DataFrame | None:
        """A version, the last by default; None if there is none."""
        what = self.read(number) if number else self.latest()[1]
        return self.spark.read.parquet(f"{self.place}/{what['data']}") if what else None

    def commit(self, change: Callable[[DataFrame | None], DataFrame | None], tries: int = 100) -> DataFrame | None:
        """Make ``change`` of the last version the next one, on whatever version is the last by then. ``change`` may run several times; None changes nothing."""
        for _ in range(tries):
            number, what = self.latest()
            held = self.spark.read.parquet(f"{self.place}/{what['data']}") if what else None
            new = change(held)
            if new is None:
                return held
            data = f"data-{uuid.uuid4().hex}"
            new.write.parquet(f"{self.place}/{data}")
            if self.claim(number + 1, {"data": data}):
                return self.spark.read.parquet(f"{self.place}/{data}")
            self._fs().delete(self._path(data), True)
        raise TimeoutError(f"{self.place}: {tries} other writers were faster")

    def forget(self, keep: int = 2) -> None:
        """Delete the data of all but the last versions; their claims stay, so numbers go on. No reader may still be at them."""
        last = self.latest()[0]
        for number in range(max(1, last - keep - 100), last - keep + 1):
            self._fs().delete(self._path(self.read(number)["data"]), True)


class Lock(Claims):
    """One holder at a time. A holder that hasn't renewed for ``expiry`` seconds counts as gone."""

    def __init__(self, spark: SparkSession, place: str, expiry: float = 300, clock: Callable[[], float] = time.time):
        super().__init__(spark, place)
        self.expiry, self.clock, self.me = expiry, clock, uuid.uuid4().hex

    def take(self) -> bool:
        """Take the lock, or renew it; false if another holds it or took it first."""
        number, what = self.latest()
        if what.get("holder") not in (None, self.me) and self.clock() - what["at"] < self.expiry:
            return False
        return self.claim(number + 1, {"holder": self.me, "at": self.clock()})

    def release(self) -> None:
        number, what = self.latest()
        if what.get("holder") == self.me:
            self.claim(number + 1, {"holder": None, "at": self.clock()})

    @contextmanager
    def held(self):
        """Yields whether the lock was taken, and gives it back."""
        taken = self.take()
        try:
            yield taken
        finally:
            if taken:
                self.release()
