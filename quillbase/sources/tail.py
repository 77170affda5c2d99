"""A streaming source that follows growing JSONL files: offsets are bytes by file, only complete lines are read."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class TailReader(DataSourceStreamReader):
    """A file that became shorter is read again from its start."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = _open(self.folder)
        files = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: self._whole(fs, f.path, f.size) for f in files if f.type == pafs.FileType.File and f.path.endswith(self.suffix)}

    @staticmethod
    def _whole(fs, path: str, size: int) -> int:
        """The end of the last complete line, sought from the file's end."""
        with fs.open_input_file(path) as source:
            at = size
            while at > 0:
                start = max(0, at - 65536)
                source.seek(start)
                found = source.read(at - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                at = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            if stop < begin:
                begin = 0
            if stop > begin:
                out.append(Piece(path, begin, stop))
        return out

    def read(self, piece: Piece):
        fs, _ = _open(self.folder)
        with fs.open_input_file(piece.path) as source:
            at, left = piece.start, b""
            source.seek(at)
            while at < piece.end:
                data = source.read(min(1 << 20, piece.end - at))
                if not data:
                    break
                at += len(data)
                lines = (left + data).split(b"\n")
                left = lines.pop()
                begin = at - len(left) - sum(len(x) + 1 for x in lines)
                for line in lines:
                    if line.strip():
                        yield piece.path, begin, line.decode("utf-8", "replace")
                    begin += len(line) + 1


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"))


def tail(spark: SparkSession, folder: str, suffix: str = ".jsonl"):
    spark.dataSource.register(TailSource)
    return spark.readStream.format("jsonl_tail").option("suffix", suffix).load(folder)
