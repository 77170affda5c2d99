"""A batch source of hook events in JSON lines: large files are read by many tasks, filters on the session go to the lines.

A partition is a range of bytes of one file. A line belongs to the range in which it begins: a range that doesn't start a file skips to
the first line that begins in it, and reads past its end as far as its last line goes. Equality and lists of sessions are pushed to
the reader, which parses only lines that hold such a name; Spark applies them again. Lines that aren't an object give a row without session.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SPLIT = 64 << 20
BLOCK = 1 << 20
#: Rows of a batch.
ROWS = 2000
SCHEMA = "path string, offset long, session_id string, hook_event_name string, line string"
_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("session_id", pa.string()), ("hook_event_name", pa.string()), ("line", pa.string())])


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def lines_of(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end)."""
    at = start
    if start:
        # the line that holds the byte before belongs to an earlier range
        source.seek(start - 1)
        at = start - 1
    left, skip = b"", bool(start)
    while at < end or left:
        data = source.read(BLOCK)
        if not data:
            if left and not skip and at - len(left) < end:
                yield at - len(left), left
            return
        begin = at - len(left)
        at += len(data)
        parts = (left + data).split(b"\n")
        left = parts.pop()
        for line in parts:
            if not skip:
                if begin >= end:
                    return
                yield begin, line
            skip = False
            begin += len(line) + 1
        if at - len(left) >= end and not skip:
            return


class EventReader(DataSourceReader):
    def __init__(self, folder: str, suffix: str, split: int):
        self.folder, self.suffix, self.split = folder, suffix, split
        self.sessions: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("session_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                wanted = {v for v in wanted if v is not None}
                self.sessions = wanted if self.sessions is None else self.sessions & wanted
            yield f  # applied again: the reader only leaves out

    def partitions(self) -> list[Range]:
        fs, root = _open(self.folder)
        files = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if fs.get_file_info(root).type != pafs.FileType.File else [fs.get_file_info(root)]
        found = sorted((f.path, f.size) for f in files if f.type == pafs.FileType.File and f.path.endswith(self.suffix))
        ranges = [Range(p, at, min(size, at + self.split)) for p, size in found for at in range(0, size, self.split)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        # a name may be written with escapes: then its line is parsed too
        marks = [json.dumps(s, ensure_ascii=False).encode() for s in self.sessions] if self.sessions is not None else None
        fs, _ = _open(self.folder)
        rows: list[tuple] = []
        with fs.open_input_file(partition.path) as source:
            for offset, line in lines_of(source, partition.start, partition.end):
                if not line.strip() or marks is not None and b"\\u" not in line and b"\\/" not in line and not any(m in line for m in marks):
                    continue
                text = line.decode("utf-8", "replace")
                try:
                    e = json.loads(text)
                except ValueError:
                    e = None
                get = lambda k, e=e: e[k] if isinstance(e, dict) and isinstance(e.get(k), str) else None
                rows.append((partition.path, offset, get("session_id"), get("hook_event_name"), text))
                if len(rows) == ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class EventSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EventReader:
        return EventReader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("split", SPLIT)))


def events(spark: SparkSession, path: str, suffix: str = ".jsonl", split: int = SPLIT) -> DataFrame:
    """A file or folder of JSON lines: path, offset, session_id, hook_event_name, line (for sources.files.hook_events)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventSource)
    return spark.read.format("jsonl_events").option("suffix", suffix).option("split", split).load(path)
