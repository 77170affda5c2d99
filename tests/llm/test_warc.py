import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from quillbase.llm import warc

ROWS = [(1, "http://a/ x", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é" * 100_000), (None, "http://f", "<p>one</p>"), (2, None, "<p>one</p>"), (None, "u", "alone"), (None, "u", "alone")]


def want(rows):
    top = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if i is not None:
            top[data] = max(i, top.get(data, i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = top.get(data)
        response = first is None or i == first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first))
    return sorted(out, key=str)


def got(index):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in warc.read_records(index).collect()), key=str)


def test_round_trip(spark):
    index = warc.write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    assert got(index) == want(ROWS)
    bodies = {r.page_id: r.body for r in warc.read_records(index).collect()}
    assert bytes(bodies[5]) == ("é" * 100_000).encode()
    assert got(index.where("page_id = 5")) == [r for r in want(ROWS) if r[0] == 5]  # only what is asked for


def test_files_are_warc(spark):
    index = warc.write_archives(spark.createDataFrame(ROWS[:5], "page_id long, url string, html string")).collect()
    path = index[0].file.removeprefix("file:")
    with open(path, "rb") as f:
        data = f.read()
    text = gzip.decompress(data)
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
    for r in index:
        if r.file == index[0].file:
            assert data[r.offset : r.offset + 2] == b"\x1f\x8b"


def test_coalescing():
    assert warc.coalesced([(0, 10), (10, 10), (20, 5)]) == [(0, 25, 3)]
    far = warc.MAX_GAP + 30
    assert warc.coalesced([(0, 10), (far, 10)]) == [(0, 10, 1), (far, far + 10, 1)]
    assert len(warc.coalesced([(i * warc.MAX_READ, warc.MAX_READ) for i in range(3)])) == 3
    assert warc.coalesced([]) == []


def test_damage_is_found(spark):
    index = warc.write_archives(spark.createDataFrame(ROWS[:1], "page_id long, url string, html string"))
    with pytest.raises(Exception, match="."):
        warc.read_records(index.withColumn("offset", F.col("offset") + 1)).collect()


def test_min_revisit_and_empty(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert all(r[3] == "response" for r in got(warc.write_archives(df, min_revisit=11)))
    assert got(warc.write_archives(df.limit(0))) == []


def test_query_against_brute_force(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in warc.op6_warc(spark, sf).collect()), key=str) == want(rows)


def test_any_text_is_an_id(spark):
    """Ids with line ends, spaces, brackets and none at all come back as they were."""
    ids = ["a\r\nb", "", " x>", "ü%41", "z"]
    df = spark.createDataFrame([(i, None, "same") for i in ids] + [("lone", "u", "other")], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_records(warc.write_archives(df)).collect()}
    last = max(ids)
    assert got == {i: ("response", None) if i == last else ("revisit", last) for i in ids} | {"lone": ("response", None)}
    df = spark.createDataFrame([("", None, "same"), (None, None, "same")], "page_id string, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.read_records(warc.write_archives(df)).collect()} == {"": None, None: ""}
