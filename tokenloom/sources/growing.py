"""A stream over log files that grow in place: every poll opens what changed and reads the new bytes only.

Spark's own file stream sees each path once.  This one is a data source of its own:

* an *offset* is the size of every file at a poll, taken from the listing;
* a *partition* is a byte range of a file between two offsets, at most ``rangeBytes`` long;
* a line belongs to the range that holds its line end.  A reader looks back from the
  start of its range for the place where that line began, so a line that was half written
  at one poll comes whole with a later one, and ranges can be read in any order, again
  after a failure, and by different executors.

A file that became shorter was rotated and starts over.  Unchanged files are listed and
not opened.  Paths are URIs that pyarrow can open (``file``, ``s3``, ``hdfs``, ``gs``).

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").option("path", "s3://lake/sessions").load()
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, byte_offset bigint, byte_len bigint, raw string"
RANGE_BYTES = 64 << 20
#: Bytes read at a time, forwards and when a line's start is looked for.
STEP = 1 << 20
#: Rows of one Arrow batch.
ROWS = 10_000


class Range(InputPartition):
    """Bytes ``start`` to ``end`` of one file."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def ranges(before: dict[str, int], after: dict[str, int], size: int) -> list[Range]:
    """What has to be read to come from one set of sizes to the other."""
    out = []
    for path, end in sorted(after.items()):
        known = before.get(path, 0)
        # A shorter file is another one under the old name.
        at = known if end >= known else 0
        while at < end:
            stop = min(at + size, end)
            out.append(Range(path, at, stop))
            at = stop
    return out


def line_start(file: pa.NativeFile, at: int) -> int:
    """Where the line begins that holds the byte before ``at``'s own; ``at`` itself after a line end."""
    while at > 0:
        begin = max(0, at - STEP)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def lines_ending_in(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, line)`` of every line whose line end lies in ``start .. end``, without it."""
    at = line_start(file, start)
    file.seek(at)
    held, left = b"", end - at
    while left > 0:
        got = file.read(min(STEP, left))
        if not got:
            return
        left -= len(got)
        *whole, held = (held + got).split(b"\n") if b"\n" in got else (held + got,)
        for line in whole:
            yield at, line
            at += len(line) + 1


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        # Hadoop writes local paths with one slash.
        self.path = re.sub("^file:/+", "file:///", options["path"])
        self.suffix = options.get("suffix", ".jsonl")
        self.size = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = fs.FileSystem.from_uri(self.path)
        listed = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in listed if f.type == fs.FileType.File and f.path.endswith(self.suffix)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        names = ["path", "byte_offset", "byte_len", "raw"]

        def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            bare = [line.removesuffix(b"\r") for _, line in rows]
            texts = [line.decode("utf-8", "replace") for line in bare]
            columns = [[partition.path] * len(rows), [at for at, _ in rows], [len(line) for line in bare], texts]
            types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        with files.open_input_file(partition.path) as file:
            held, size = [], 0
            for row in lines_ending_in(file, partition.start, min(partition.end, file.size())):
                # Blank lines hold no record.
                if row[1].strip():
                    held.append(row)
                    size += len(row[1])
                if len(held) == ROWS or size > 16 * STEP:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

    def commit(self, end: dict) -> None:
        """Nothing is kept between polls but the offsets."""


class GrowingLines(DataSource):
    """``growing_lines``: options ``path``, ``suffix`` (``.jsonl``) and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))


