import json

import pytest
from pyspark.sql import functions as F

from quillbase.operators import delta
from quillbase.streaming import ingest


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def event(s, seq, kind="UserPromptSubmit", **more):
    return {"session_id": s, "seq": seq, "ts": f"2024-01-01T00:00:{seq:02}Z", "hook_event_name": kind, **more}


def test_events_once_and_bad_lines_kept(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "out")
    lines(src / "a.jsonl", [event("s1", 1, prompt="hi"), "no json", event("s1", 2, "Stop", text="yes"), event("s1", 3, "Other"), {"seq": 9}])
    lines(src / "b.jsonl", [event("s2", 1, prompt="x"), '{"session_id": "s3", "seq": "one"}'])
    assert ingest.ingest_events(spark, str(src), root, 1).awaitTermination(100)
    table = ingest.BatchTable(spark, f"{root}/tables")
    rows = lambda: sorted((r.session_id, r.seq) for r in table.read("events", ingest.EVENTS).collect())
    bad = lambda: sorted(r.bad_record for r in table.read("bad_records", ingest.BAD_RECORDS).collect())
    want = [("s1", 1), ("s1", 2), ("s2", 1)]
    assert rows() == want and bad() == sorted(["no json", '{"session_id": "s3", "seq": "one"}'])
    version = table.store.latest()
    again = table.read("events", ingest.EVENTS).withColumns({"bad_record": F.lit(None).cast("string"), "file": F.lit("f")})
    assert not ingest.put_events(table, again, 0) and not ingest.put_events(table, again, 1)  # replays
    assert table.store.latest() == version and rows() == want
    lines(src / "c.jsonl", [event("s1", 4, "SessionEnd")])
    assert ingest.ingest_events(spark, str(src), root, 1).awaitTermination(100)  # goes on where it stopped
    assert rows() == sorted([*want, ("s1", 4)])
    table.compact("events", ingest.EVENTS)
    assert rows() == sorted([*want, ("s1", 4)]) and len(table._state()["folders"]["events"]) == 1
    assert not ingest.put_events(table, again, 2)


def test_tracked_sources_are_the_batch_work_list(spark, tmp_path):
    first = [("raw", f"n{i}", f"h{i}", None) for i in range(30)]
    second = [("raw", "n3", "other", None), ("raw", "n50", "h50", None), ("fetched", "n4", "h4", None)]
    schema = "kind string, name string, sha string, mtime timestamp"
    src = tmp_path / "src"
    root = str(tmp_path / "out")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(src))
        assert ingest.track_sources(spark.readStream.schema(schema).parquet(str(src)), root).awaitTermination(100)
    now = [r for r in first if r[1] != "n3"] + second
    summaries = spark.createDataFrame([(f"n{i}", f"h{i}", None) for i in range(0, 60, 2)] + [("n3", "h3", None)], "name string, sha string, mtime timestamp")
    want = delta.work_list(spark.createDataFrame(now, schema), summaries)
    assert sorted(map(tuple, ingest.due_sources(spark, root, summaries).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    table = ingest.BatchTable(spark, f"{root}/tables")
    table.compact("sources", ingest.SOURCES)
    assert ingest.tracked(spark, root).count() == len(now)


def test_a_killed_stream_gives_the_files_of_a_batch(spark, tmp_path, monkeypatch):
    src, root = tmp_path / "in", str(tmp_path / "out")
    every = []
    for k in range(3):
        rows = [event(f"s{i}", 10 * k + j, "UserPromptSubmit" if j == 1 else "Stop", prompt=f"ask {i}" if j == 1 else None, text=f"said {k} {j}") for i in range(4) for j in range(3)]
        every += rows
        lines(src / f"{k}.jsonl", rows)
    events = lambda: ingest.event_stream(spark, str(src), 1).withColumns({"tool_name": F.lit(None).cast("string"), "command": F.lit(None).cast("string"), "file_path": F.lit(None).cast("string"), "stdout": F.lit(None).cast("string")})
    q = ingest.write_blocks(events(), root)
    assert q.awaitTermination(100)
    content = lambda: {r.file: r.content for r in ingest.session_files(ingest.committed_blocks(spark, root)).collect()}
    static = spark.read.schema(ingest.EVENTS).json(str(src)).withColumns({"tool_name": F.lit(None).cast("string"), "command": F.lit(None).cast("string"), "file_path": F.lit(None).cast("string"), "stdout": F.lit(None).cast("string")})
    want = {r.file: r.content for r in ingest.session_files(ingest.blocks_of(static)).collect()}
    assert content() == want and len(want) == 4
    # killed after the sink's commit and before Spark's own: the batch comes again
    last = max(int(p.name) for p in (tmp_path / "out/checkpoint/commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "out/checkpoint/commits").iterdir():
        if str(last) in p.name:
            p.unlink()
    parts = len(list((tmp_path / "out/blocks/parts").iterdir()))
    assert ingest.write_blocks(events(), root).awaitTermination(100)
    assert len(list((tmp_path / "out/blocks/parts").iterdir())) > parts and content() == want


def test_empty(spark, tmp_path):
    table = ingest.BatchTable(spark, str(tmp_path))
    assert table.read("events", ingest.EVENTS).count() == 0
    assert ingest.committed_blocks(spark, str(tmp_path)).count() == 0
    assert ingest.session_files(spark.createDataFrame([], ingest.BLOCKS)).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_latest(spark, n):
    rows = spark.createDataFrame([("a", i, f"v{i}") for i in range(n)], "k string, at long, v string")
    assert ingest.latest(rows, "k", "at").collect()[0].v == f"v{n - 1}"
