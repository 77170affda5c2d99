import io
import json
import random

import pytest
from pyspark.sql import functions as F

from quillbase.operators import graph, snapshots
from quillbase.sources import files, jsonl


def pages(spark, rows):
    return spark.createDataFrame(rows, "path string, name string, type string, tags array<string>, title string, body string")


def rows_of(n):
    rng = random.Random(6)
    return {f"n{i}": (f"wiki/n{i}.md", f"n{i}", rng.choice(["a", "b"]), [f"t{j}" for j in range(i % 3)], f"T{i}", f"[[n{rng.randint(0, n)}]] and [[n{rng.randint(0, n)}]]") for i in range(n)}


def test_only_unequal_buckets_are_read(spark, tmp_path):
    rows = rows_of(1200)
    store = snapshots.Snapshots(spark, str(tmp_path))
    before = pages(spark, list(rows.values()))
    assert store.save(before) == 0
    for i in range(0, 1200, 150):
        rows[f"n{i}"] = (*rows[f"n{i}"][:5], "[[changed]]")
    del rows["n7"]
    rows["new"] = ("wiki/new.md", "new", "a", None, None, "[[n1]]")
    rows["n8"] = (*rows["n8"][:3], rows["n8"][3][::-1], *rows["n8"][4:5], rows["n8"][5] + " text")  # no difference
    after = pages(spark, list(rows.values()))
    assert store.save(after) == 1 and store.save(after.repartition(3)) == 2
    want = sorted(map(tuple, graph.diff(graph.snapshot(before), graph.snapshot(after)).collect()))
    assert sorted(map(tuple, store.diff(0, 1).collect())) == want and len(want) == 10
    assert 0 < store.buckets["read"] <= 10 and store.buckets["total"] == 256
    edges = lambda df: graph.edges(df)
    want = sorted(map(tuple, graph.edge_diff(edges(before), edges(after)).collect()))
    assert sorted(map(tuple, store.edge_diff(0, 1).collect())) == want != []
    assert store.diff(1, 2).count() == 0 and store.buckets["read"] == 0
    assert sorted(store.rows(1).select("name").collect()) == sorted(graph.snapshot(after).select("name").collect())


def test_long_lists_and_empty_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MAX_LISTED", 3)
    store = snapshots.Snapshots(spark, str(tmp_path))
    some = pages(spark, list(rows_of(50).values()))
    store.save(some)
    store.save(some.limit(0))
    got = store.diff(0, 1).collect()
    assert len(got) == 50 and {r.change for r in got} == {"removed"}
    assert {r.change for r in store.diff(1, 0).collect()} == {"added"}


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_lines_of_every_range(block, monkeypatch):
    monkeypatch.setattr(jsonl, "BLOCK", block)
    for data in (b"", b"\n", b"one", b"one\n", b"a\n\nbb\nccc\n\n", b"long line of bytes\nx\ny"):
        want, at = [], 0
        for line in data.split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        want = [w for w in want if w[1]]
        for size in (1, 2, 3, 5, 100):
            got = [x for s in range(0, len(data), size) for x in jsonl.lines_of(io.BytesIO(data), s, min(len(data), s + size)) if x[1]]
            assert got == want, (data, size)


def test_one_file_by_many_tasks(spark, tmp_path):
    rows = [{"session_id": f"s{i % 7}", "hook_event_name": "Stop", "prompt": "é" * (i % 50), "seq": i} for i in range(500)]
    lines = [json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate(rows)] + ["no json", '["list"]', '{"session_id": "\\u00731"}', '{"session_id": 5}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    df = jsonl.events(spark, str(tmp_path), split=1000)
    assert df.rdd.getNumPartitions() > 20
    assert sorted(r.line for r in df.collect()) == sorted(lines)
    few = df.where(F.col("session_id").isin("s1", "s2"))
    assert few.count() == sum(r["session_id"] in ("s1", "s2") for r in rows) + 1
    one = df.where(F.col("session_id") == "s3")
    assert files.hook_events(one.select("line"), "line").count() == sum(r["session_id"] == "s3" for r in rows)
    assert jsonl.events(spark, str(tmp_path / "none")).count() == 0


def test_the_reader_leaves_lines_out(tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"session_id": f"s{i}"}) + "\n" for i in range(50)))
    reader = jsonl.EventReader(str(tmp_path), ".jsonl", 100)
    filters = [jsonl.In(("session_id",), ("s3", "s4")), jsonl.EqualTo(("hook_event_name",), "x")]
    assert list(reader.pushFilters(filters)) == filters
    assert sorted(s for p in reader.partitions() for b in reader.read(p) for s in b.column("session_id").to_pylist()) == ["s3", "s4"]
