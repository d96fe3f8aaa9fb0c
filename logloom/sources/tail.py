"""A data source for logs that grow: ``spark.read`` and ``spark.readStream`` ``.format("growing_lines")``.

A row is a line with its file and the byte at which it begins, which orders a file's lines and never changes. A partition is a range of
bytes and holds the lines that begin in it, so a file of any size is read in parallel, its text is never exchanged and nobody counts
lines first. Small files share a partition, so many of them are few tasks. The stream's offset is how far each file was read, always up to a line's end: a file that grew costs its growth, and a
half-written last line waits until it is whole. The batch reader also gives a last line without an end.

Options: ``path`` (a file or folder, or several with commas; any store that pyarrow reads), ``suffix`` (``.jsonl``), ``range_bytes``.
Register it with ``spark.dataSource.register(GrowingLines)``. Only ``\\n`` ends a line, one ``\\r`` before it goes; bytes that are no UTF-8
become the replacement character; an empty file has no lines; a file that shrank or was replaced by a shorter one is not read again until it
is longer than before. The offset has an entry a file, on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, line string"
RANGE_BYTES, BLOCK = 64 << 20, 1 << 20
#: What opening a file counts as where ranges share a partition, how many partitions small files may be, and how many files the driver looks into at once.
OPEN_BYTES, SHARES, LOOKS = 128 << 10, 256, 16


class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a file; ``whole`` says that the file's last line counts without a line end."""

    def __init__(self, path: str, start: int, end: int, whole: bool):
        self.path, self.start, self.end, self.whole = path, start, end, whole


class Ranges(InputPartition):
    """Ranges that one task reads one after the other."""

    def __init__(self, parts: list[Range]):
        self.parts = parts


def packed(parts: list[Range], step: int) -> list[Ranges]:
    """Ranges in order, several to a partition where ``step`` bytes hold them and there are many; one at least."""
    out: list[list[Range]] = []
    costs = [r.end - r.start + OPEN_BYTES for r in parts]
    most, held = min(step + OPEN_BYTES, max(sum(costs) // SHARES, 8 * OPEN_BYTES)), 0
    for r, cost in zip(parts, costs, strict=True):
        if not out or held + cost > most:
            out.append([])
            held = 0
        out[-1].append(r)
        held += cost
    return [Ranges(x) for x in out]


def _opened(path: str):
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where, name


def sizes(options: dict) -> dict[str, int]:
    """Bytes of each file below the paths."""
    suffix, found = options.get("suffix", ".jsonl"), {}
    for path in options["path"].split(","):
        where, name = _opened(path.strip())
        info = where.get_file_info(name)
        files = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
        scheme = path.strip().split("://", 1)[0] + "://" if "://" in path else "file://" if path.startswith("file:") else ""
        found |= {f"{scheme}{f.path}": f.size for f in files if f.type == fs.FileType.File and f.path.endswith(suffix)}
    return found


def last_end(path: str, start: int, size: int) -> int:
    """The byte behind the last line end in a file's bytes ``start`` to ``size``; ``start`` if there is none."""
    where, name = _opened(path)
    with where.open_input_file(name) as f:
        while size > start:
            at = max(start, size - BLOCK)
            f.seek(at)
            hit = f.read(size - at).rfind(b"\n")
            if hit >= 0:
                return at + hit + 1
            size = at
    return start


def lines_in(part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a range."""
    where, name = _opened(part.path)
    with where.open_input_file(name) as f:
        at, held = part.start, b""
        if at:
            f.seek(at - 1)
            if f.read(1) != b"\n":  # the line that began before is another range's
                while True:
                    block = f.read(BLOCK)
                    hit = block.find(b"\n")
                    if hit >= 0:
                        at += hit + 1
                        held = block[hit + 1 :]
                        break
                    if not block:
                        return
                    at += len(block)
        pieces = [held] if held else []
        while at < part.end:
            block = f.read(BLOCK)
            # Pieces are joined once a line, so a long line isn't copied block by block.
            *full, rest = block.split(b"\n")
            if not pieces and not block:
                return
            if held:
                *first, held_rest = held.split(b"\n")
                for x in first:
                    if at >= part.end:
                        return
                    yield at, x
                    at += len(x) + 1
                pieces, held = [held_rest] if held_rest else [], b""
            if not block:
                if pieces and part.whole and at < part.end:
                    yield at, b"".join(pieces)
                return
            if full:
                full[0] = b"".join([*pieces, full[0]])
                pieces = []
                for x in full:
                    if at >= part.end:
                        return
                    yield at, x
                    at += len(x) + 1
            if rest:
                pieces.append(rest)


def batches(part: Range) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, str]] = []
    size = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(rows), pa.string()), pa.array([a for a, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], names=["path", "offset", "line"])

    for at, line in lines_in(part):
        rows.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        size += len(line)
        if size > 4 << 20 or len(rows) >= 10_000:
            yield made()
            rows, size = [], 0
    if rows:
        yield made()


def ranges(path: str, start: int, end: int, step: int, whole: bool) -> list[Range]:
    return [Range(path, at, min(at + step, end), whole) for at in range(start, end, step)]


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.step = options, int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        return packed([r for path, size in sorted(sizes(self.options).items()) for r in ranges(path, 0, size, self.step, True)], self.step) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return (b for r in partition.parts for b in batches(r))


class _Growth(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.step, self.seen = options, int(options.get("range_bytes", RANGE_BYTES)), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        grown = [(path, self.seen.get(path, 0), size) for path, size in sizes(self.options).items() if size > self.seen.get(path, 0)]
        with ThreadPoolExecutor(LOOKS) as pool:
            ends = list(pool.map(lambda g: last_end(*g), grown))
        self.seen |= {path: end for (path, _, _), end in zip(grown, ends, strict=True) if end}
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        self.seen = {k: max(v, self.seen.get(k, 0)) for k, v in end.items()} | {k: v for k, v in self.seen.items() if k not in end}
        return packed([r for path, to in sorted(end.items()) for r in ranges(path, start.get(path, 0), to, self.step, False)], self.step)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return (b for r in partition.parts for b in batches(r))


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> _Growth:
        return _Growth(dict(self.options))


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(path, offset, line) of all lines below a path."""
    spark.dataSource.register(GrowingLines)
    return spark.read.format("growing_lines").options(path=path, **options).load()


def read_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same as a stream of what is written from now on, after what is there."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").options(path=path, **options).load()
