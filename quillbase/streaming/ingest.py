"""Streams into tables: hook events as JSON lines, sources by content hash, and the blocks of session files.

A batch becomes part of its table by one commit that names the batch; a batch that comes again, after a restart or a replay, finds
its number there and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import session_file, session_title
from ..operators.delta import work_list
from ..operators.versions import Versions
from ..sources.files import HOOK, HOOK_EVENTS
from .sessions import block, is_start

BAD = "bad_record"


class BatchTable:
    """Tables that grow by batches of streams; each batch of a stream is there once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Versions(spark, root)

    def _state(self, version: int | None = None) -> dict:
        return self.store.manifest(version) or {"last": {}, "folders": {}}

    def append(self, tables: dict[str, DataFrame], batch: int, stream: str = "stream") -> bool:
        """Adds rows to tables as one commit; False if the stream's batch is there."""
        version = self.store.latest()
        state = self._state(version)
        if batch <= state["last"].get(stream, -1):
            return False
        folders = {k: list(v) for k, v in state["folders"].items()}
        for name, df in tables.items():
            made = self.store.new_folder(name)
            self.store.write(df, made)
            folders.setdefault(name, []).append(made)
        self.store.commit({"last": state["last"] | {stream: batch}, "folders": folders}, version)
        return True

    def read(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """All rows of a table as of a version; empty, with that schema, before the first batch."""
        folders = self._state(version)["folders"].get(name, [])
        paths = [f"{self.store.root}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self, name: str, schema: str, key: str | None = None, newest: str | None = None) -> None:
        """Rewrites a table's folders as one; with a key, of equal keys the row that is newest by a column stays."""
        version = self.store.latest()
        rows = latest(self.read(name, schema, version), key, newest) if key else self.read(name, schema, version)
        state, made = self._state(version), self.store.new_folder(name)
        self.store.write(rows, made)
        self.store.commit(state | {"folders": state["folders"] | {name: [made]}}, version)


def latest(rows: DataFrame, key: str, newest: str) -> DataFrame:
    """Of each key the row that is newest by a column; a sum before the shuffle, so that hot keys don't meet as rows."""
    whole = F.struct(newest, *[c for c in rows.columns if c not in (key, newest)])
    return rows.groupBy(key).agg(F.max(whole).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rows.columns if c != key])


# ---- events

EVENTS = f"{HOOK}, seq long, ts timestamp, text string"
BAD_RECORDS = f"{BAD} string, file string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Files of JSON lines as a stream of events, with the column bad_record for lines that are none."""
    reader = spark.readStream.schema(f"{EVENTS}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    return reader.option("maxFilesPerTrigger", files_per_batch).json(folder).withColumn("file", F.col("_metadata.file_path"))


def _each_batch(stream: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], object]) -> StreamingQuery:
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def put_events(table: BatchTable, rows: DataFrame, batch: int) -> bool:
    """A batch's lines as the tables events (of a session and a kind that is recorded) and bad_records, in one commit."""
    bad = rows.where(F.col(BAD).isNotNull()).select(BAD, "file")
    kept = rows.where(F.col(BAD).isNull() & F.col("session_id").isNotNull() & F.col("hook_event_name").isin(*HOOK_EVENTS)).drop(BAD, "file")
    return table.append({"events": kept, "bad_records": bad}, batch, "events")


def ingest_events(spark: SparkSession, folder: str, root: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Everything new below a folder into the tables below root; run again, it goes on where it stopped."""
    table = BatchTable(spark, f"{root}/tables")
    # a batch is looked at twice, by its good and its bad lines
    return _each_batch(event_stream(spark, folder, files_per_batch), f"{root}/checkpoint", lambda rows, n: put_events(table, rows.persist(), n) and rows.unpersist())


# ---- sources

SOURCES = "kind string, name string, sha string, mtime timestamp, at long"


def put_sources(table: BatchTable, rows: DataFrame, batch: int) -> bool:
    return table.append({"sources": rows.select("kind", "name", "sha", "mtime", F.lit(batch).cast("long").alias("at"))}, batch, "sources")


def track_sources(stream: DataFrame, root: str) -> StreamingQuery:
    """A stream of sources (kind, name, sha, mtime) into a table below root; of a name that comes again the last batch counts."""
    table = BatchTable(stream.sparkSession, f"{root}/tables")
    return _each_batch(stream, f"{root}/checkpoint", lambda rows, n: put_sources(table, rows, n))


def tracked(spark: SparkSession, root: str) -> DataFrame:
    """The sources below root as they are now: kind, name, sha, mtime."""
    rows = BatchTable(spark, f"{root}/tables").read("sources", SOURCES)
    keyed = rows.withColumn("of", F.struct("kind", "name"))
    return latest(keyed, "of", "at").select("kind", "name", "sha", "mtime")


def due_sources(spark: SparkSession, root: str, summaries: DataFrame) -> DataFrame:
    """The work list of the sources tracked so far."""
    return work_list(tracked(spark, root), summaries)


# ---- blocks of session files

BLOCKS = "session_id string, seq long, ts timestamp, begins boolean, block string"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


class BlockWriter(DataSourceStreamArrowWriter):
    """Each task writes files of its own; a batch's commit names them, in one file that is there once."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.root)
        fs.create_dir(f"{root}/parts", recursive=True)
        name, writer = f"parts/{uuid.uuid4().hex}.parquet", None
        try:
            for batch in iterator:
                if batch.num_rows:
                    writer = writer or pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=fs, compression="zstd")
                    writer.write_batch(batch)
        finally:
            if writer:
                writer.close()
        return Written([name] if writer else [])

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, root = _open(self.root)
        fs.create_dir(f"{root}/commits", recursive=True)
        final = f"{root}/commits/{batchId:012}.json"
        if fs.get_file_info(final).type == pafs.FileType.NotFound:  # else the batch was committed before a restart
            made = f"{root}/commits/{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(made) as out:
                out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())
            fs.move(made, final)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        fs, root = _open(self.root)
        for name in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{name}")


class BlockSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_blocks"

    def schema(self) -> str:
        return BLOCKS

    def streamWriter(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options["path"])


def blocks_of(events: DataFrame) -> DataFrame:
    """What events (a batch or a stream) add to their sessions' files; begins: whether a session can begin with it."""
    begins = is_start(F.col("prompt"), F.col("hook_event_name"))
    return events.select("session_id", "seq", "ts", begins.alias("begins"), block(events).alias("block")).where("block is not null")


def write_blocks(events: DataFrame, root: str, once: bool = True) -> StreamingQuery:
    """A stream of events into blocks below root, each exactly once, however often the stream is killed and begun again."""
    events.sparkSession.dataSource.register(BlockSink)
    out = blocks_of(events).writeStream.format("session_blocks").option("path", f"{root}/blocks").option("checkpointLocation", f"{root}/checkpoint").outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()


def committed_blocks(spark: SparkSession, root: str) -> DataFrame:
    """The blocks of all committed batches; parts of tasks that failed or ran twice aren't among them."""
    fs, at = _open(f"{root}/blocks")
    names: list[str] = []
    for f in fs.get_file_info(pafs.FileSelector(f"{at}/commits", allow_not_found=True)):
        if f.path.endswith(".json"):
            with fs.open_input_stream(f.path) as source:
                names += json.loads(source.read())
    if not names:
        return spark.createDataFrame([], BLOCKS)
    return spark.read.schema(BLOCKS).parquet(*[f"{root}/blocks/{n}" for n in names])


def session_files(blocks: DataFrame) -> DataFrame:
    """One row for each session that has begun: file, session_id, n_blocks, content, in the order of seq from its first prompt on."""
    first = blocks.where("begins").groupBy("session_id").agg(F.min(F.struct("seq", "ts", F.col("block").alias("asked"))).alias("first"))
    kept = blocks.join(first, "session_id").where("seq >= first.seq")
    # a session's file is one row
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block"))), lambda b: b["block"]), "")
    rows = kept.groupBy("session_id").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("n_blocks"), body.alias("body"))
    # the block of a prompt holds it masked, between its heading and a line's end
    title = session_title(F.regexp_extract("first.asked", r"(?s)^\n## User\n\n(.*)\n\z", 1))
    front = F.concat(F.lit("---\ntype: log\nsession_id: "), "session_id", F.lit("\ningested: false\n---\n"))
    return rows.select(session_file(F.col("first.ts"), F.col("session_id"), title).alias("file"), "session_id", "n_blocks", F.concat(front, "body").alias("content"))
