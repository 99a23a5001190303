"""Growing session logs as a stream: every complete record, once, from any number of files.

The offset is the size of each log that a listing saw, so a batch is pinned by its two
listings and a restarted query reads the same bytes. A record belongs to the batch, and to the range of
bytes within it, in which its line ends: whoever reads a range looks back for the start of a
record that was cut by the range's beginning, and leaves a record that has no end yet to whoever
gets its end. So appends may be split anywhere, long growth is read by many tasks,
and the driver reads no content.

A log that became shorter was written anew and is read again from its start. Names that
begin with a point or an underscore are being written and wait for their final name. The offset has one entry
for each log; the store is any that Arrow can open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .logs import parse_records
from .shared import ship

FORMAT = "session_log_tail"
SCHEMA = "session_id string, path string, at bigint, line string"
#: Bytes of one task, of what opening a log counts for, of one look back and of one batch of records.
RANGE = 32 << 20
OPENING = 256 << 10
BACK = 64 << 10
TOGETHER = 4 << 20


def sizes(base: str) -> dict[str, int]:
    """The logs below the project folders of ``base``, with their bytes."""
    store, root = fs.FileSystem.from_uri(base)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    out = {}
    for f in found:
        inner = f.path[len(root) :].strip("/")
        if f.type == fs.FileType.File and inner.count("/") == 1 and inner.endswith(".jsonl") and not f.base_name.startswith(("_", ".")):
            out[inner] = f.size
    return out


def ranges(before: dict[str, int], after: dict[str, int], width: int = RANGE) -> list[tuple[str, int, int]]:
    """What a batch has to read: (log, first byte, end) of at most ``width`` bytes each."""
    out = []
    for name, end in sorted(after.items()):
        start = before.get(name, 0)
        start = 0 if end < start else start
        out += [(name, at, min(end, at + width)) for at in range(start, end, width)]
    return out


def record_start(f, at: int) -> int:
    """Where the record that holds byte ``at`` begins."""
    while at > 0:
        low = max(0, at - BACK)
        f.seek(low)
        cut = f.read(at - low).rfind(b"\n")
        if cut >= 0:
            return low + cut + 1
        at = low
    return 0


def records(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, record) of the records whose line ends in [start, end)."""
    at = record_start(f, start)
    f.seek(at)
    held, left = [], end - at
    while left > 0:
        block = f.read(min(left, TOGETHER))
        if not block:
            return
        left -= len(block)
        *lines, rest = block.split(b"\n")
        for line in lines:
            line = b"".join((*held, line))
            yield at, line
            at, held = at + len(line) + 1, []
        held.append(rest)


def bundles(found: list[tuple[str, int, int]], width: int = RANGE, opening: int = OPENING) -> list[list[tuple[str, int, int]]]:
    """Ranges put together to tasks of about ``width`` bytes; to open a log counts as so many bytes."""
    out, size = [], width
    for name, start, end in found:
        if size + end - start + opening > width:
            out.append([])
            size = 0
        out[-1].append((name, start, end))
        size += end - start + opening
    return out


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class TailReader(DataSourceStreamReader):
    def __init__(self, base: str, width: int):
        self.base, self.width = base, width

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return sizes(self.base)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return [Ranges(r) for r in bundles(ranges(start, end, self.width), self.width)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.base)

        def batch(rows):
            types = (pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["session_id", "path", "at", "line"])

        held, size = [], 0
        for name, start, end in partition.ranges:
            session, path = name.removesuffix(".jsonl"), f"{self.base}/{name}"
            with store.open_input_file(f"{root}/{name}") as f:
                for at, line in records(f, start, end):
                    held.append((session, path, at, line.decode(errors="replace")))
                    size += len(line) + 100
                    if size > TOGETHER:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)


class SessionLogTail(DataSource):
    """Options: path, the folder of the project folders; width, the bytes of one task."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"].rstrip("/"), int(self.options.get("width", RANGE)))


def tail_lines(spark: SparkSession, base: str, width: int = RANGE) -> DataFrame:
    """A stream (session_id, path, at, line) of the records of all logs below ``base``."""
    ship(spark)
    spark.dataSource.register(SessionLogTail)
    return spark.readStream.format(FORMAT).option("width", width).load(base)


def tail_messages(spark: SparkSession, base: str, width: int = RANGE) -> DataFrame:
    """A stream of message rows; ``line_no`` is the byte at which a record begins, and idx is not known yet."""
    lines = tail_lines(spark, base, width).filter(F.length(F.trim("line")) > 0)
    return parse_records(lines.select("session_id", F.col("at").alias("line_no"), "line"))
