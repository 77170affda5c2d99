import random

import pytest
from pyspark.sql import functions as F

from quillbase.streaming import sessions, timed

SCHEMA = "session_id string, seq long, ts timestamp, hook_event_name string, prompt string, text string, tool_name string, command string, file_path string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def some(seed, n=8):
    rng = random.Random(seed)
    rows = []
    for s in range(n):
        for seq in range(12):
            kind = rng.choice(["UserPromptSubmit", "Stop", "PostToolUse", "Stop"]) if seq < 11 else rng.choice(["SessionEnd", "Stop"])
            rows.append((f"s{s}", seq, f"2024-01-01 00:{s:02}:{seq:02}", kind, rng.choice(["ask", " ", "more"]) if kind == "UserPromptSubmit" else None, "said" if kind == "Stop" else None, "Bash" if kind == "PostToolUse" else None, rng.choice(["make", "ls"]) if kind == "PostToolUse" else None, None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


def run(spark, tmp_path, batches, name, **how):
    src = tmp_path / "in"
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(src))
        stream = timed.stream(spark.readStream.schema(SCHEMA).parquet(str(src)), **how)
        put = lambda df, n, k=k: df.write.mode("overwrite").parquet(str(tmp_path / f"rows/batch={100 * k + n}"))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(put).start()
        assert q.awaitTermination(200)
    rows = spark.read.parquet(str(tmp_path / "rows"))
    last = rows.groupBy("session_id").agg(F.max_by(F.struct("file", "ended", *timed.SUMS), "batch").alias("r")).select("session_id", "r.*")
    return sorted(map(tuple, last.collect())), q


def want(spark, rows):
    return sorted(map(tuple, sessions.rollup(frame(spark, rows)).select("session_id", "file", "ended", *timed.SUMS).collect()))


def test_any_order_gives_the_rollup(rocks, tmp_path):
    rows = some(5)
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    got, _ = run(rocks, tmp_path, [mixed[:40], mixed[40:70], mixed[70:]], "any")
    assert got == want(rocks, rows)


def test_states_leave_and_streams_begin_with_a_rollup(rocks, tmp_path):
    old = [r for r in some(7, 3) if r[1] < 6]
    new = [r for r in some(7, 3) if r[1] >= 6]
    firsts = frame(rocks, old).where(sessions.is_start(F.col("prompt"), F.col("hook_event_name"))).groupBy("session_id").agg(F.min("seq").alias("first_seq"))
    begin = timed.first_states(sessions.rollup(frame(rocks, old)), firsts)
    far = [("z", 0, "2024-03-01 00:00:00", "UserPromptSubmit", "late ask", None, None, None, None)]
    later = [("z", 1, "2024-03-01 00:00:01", "Stop", None, "x", None, None, None)]
    got, q = run(rocks, tmp_path, [new, far, later], "begin", begin=begin)
    begun = {r.session_id for r in firsts.collect()}
    expected = [r for r in want(rocks, old + new) if r[0] in begun]
    assert [r for r in got if r[0] in begun] == expected
    # by then the watermark has passed all of January: only the newest session is left
    assert q.lastProgress["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) >= 0
    assert {r[0] for r in got} >= {"z"}


def test_states_come_with_their_events(spark):
    """A stream that begins with nothing doesn't call the state's server for each session."""
    src = spark.readStream.format("rate").load().select(F.lit("s").alias("session_id"), F.col("value").alias("seq"), F.col("timestamp").alias("ts"), *[F.lit("").alias(c) for c in ("hook_event_name", "prompt", "text", "tool_name", "command", "file_path")])
    plan = timed.stream(src)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan
