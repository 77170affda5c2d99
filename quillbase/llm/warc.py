"""Operator 6, WARC archives, index first.

Writing: each task writes its rows as gzipped WARC/1.1 records to files in the shared folder and returns an index row for
each record: file, offset, length, URL, digest. The index is itself a stored table, made of what finished
tasks returned; a file left by a lost attempt is in no index row and is never read. Of equal payloads, the record with
the largest id is the response, the others are revisits without a body; payloads under MIN_REVISIT bytes are all
responses.

Reading: index rows, filtered as one likes, are dealt by file and sorted by offset; neighbouring byte ranges are
coalesced to one read of at most MAX_READ bytes (or one record) and parsed.

Null payloads are empty, null URLs have no target header. Ids are percent-encoded in headers, so any text can be one.
A very long payload is one record, written and read whole. An empty table gives an empty index. A null id is smaller than any other; where all ids of
equal payloads are null, each is a response. Repeated rows with the largest id are all responses. Columns other
than id, URL and payload are dropped, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, stored, table

MIN_REVISIT = 0
MAX_FILE = 64 << 20
MAX_READ = 8 << 20
MAX_GAP = 64 << 10
#: What makes two records of a page unlike in nothing but the page: archives of equal input are equal.
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record as a gzip member; refers_to: the response's id, or None for a response."""
    name = lambda i: "<urn:page>" if i is None else f"<urn:page:{quote(str(i), safe='')}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    body = payload if refers_to is None else b""
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return headers, rest[:size]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes a record for each row; returns the index (file, offset, length, url, digest, page_id), stored."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    src = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    src = src.withColumn("key", F.sha2("payload", 256))
    first = src.where(F.octet_length("payload") >= min_revisit).groupBy("key").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = src.join(first, "key", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")).alias("refers_to"))
    kind = src.schema["page_id"]
    schema = T.StructType().add("file", "string").add("offset", "long").add("length", "long").add("url", "string").add("digest", "string").add(kind.name, kind.dataType)

    def run(batches):
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            made = []
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                page_id, url, payload, refers_to = (x.as_py() for x in row)
                data = record(page_id, url, payload, refers_to)
                if out is not None and at + len(data) > MAX_FILE:
                    out.close()
                    out = None
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                made.append((f"{folder}/{name}", at, len(data), url, digest(payload)))
                at += len(data)
            cols = zip(*made, strict=True) if made else [[]] * 5
            arrays = [pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(0)], names=schema.names)
        if out is not None:
            out.close()

    return stored(rows.mapInArrow(run, schema), "warc-index")


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, ranges in it) of the reads that cover sorted (offset, length) ranges."""
    reads: list[tuple[int, int, int]] = []
    for offset, length in ranges:
        if reads and offset - reads[-1][1] <= MAX_GAP and offset + length - reads[-1][0] <= MAX_READ:
            start, end, n = reads[-1]
            reads[-1] = (start, max(end, offset + length), n + 1)
        else:
            reads.append((offset, offset + length, 1))
    return reads


def read_records(index: DataFrame) -> DataFrame:
    """For each index row its page_id, url and what its record says: payload_bytes, payload_digest, record_type, refers_to, body."""
    kind = index.schema["page_id"].dataType
    src = index.select("file", "offset", "length", "url", "page_id").repartition(F.col("file"), F.floor(F.col("offset") / MAX_READ)).sortWithinPartitions("file", "offset")
    schema = T.StructType().add("page_id", kind).add("url", "string").add("payload_bytes", "long").add("payload_digest", "string").add("record_type", "string").add("refers_to", "string").add("body", "binary")

    def run(batches):
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(files):
                end = at
                while end < len(files) and files[end] == files[at]:
                    end += 1
                fs, path = _open(files[at])
                with fs.open_input_file(path) as source:
                    for start, stop, n in coalesced(list(zip(offsets[at:end], lengths[at:end], strict=True))):
                        source.seek(start)
                        data = source.read(stop - start)
                        rows = []
                        for i in range(at, at + n):
                            headers, body = parse(data[offsets[i] - start : offsets[i] - start + lengths[i]])
                            said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                            size = int(headers["WARC-Payload-Length"])
                            if headers["WARC-Type"] == "response" and (said != digest(body) or size != len(body)):
                                raise ValueError(f"{files[i]} at {offsets[i]}: the payload isn't what was written")
                            refers = headers.get("WARC-Refers-To")
                            refers = None if refers is None else unquote(refers[len("<urn:page:") : -1])
                            rows.append((size, said, headers["WARC-Type"], refers, body))
                        cols = zip(*rows, strict=True)
                        arrays = [pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(4).slice(at, n), batch.column(3).slice(at, n), *arrays], names=schema.names)
                        at += n

    return src.mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"))
    kind = index.schema["page_id"].dataType
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
