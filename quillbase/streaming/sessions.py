"""Sessions of hook events: a batch rollup and a stateful stream that agree.

A session begins with its first prompt that isn't blank; what comes before leaves no trace.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import cut, mask, quote_callout, session_file, session_title, strip

#: Commands not worth a record.
DULL = (
    "ls cat head tail wc file stat which where type echo printf pwd cd test true false grep rg find diff sort uniq tr cut mkdir rmdir rm cp mv ln "
    "chmod chown touch basename dirname realpath readlink tree du df less more xargs tee whoami hostname date uname env set export alias id jq"
).split()


def is_dull(command: Column) -> Column:
    """Whether every part of a shell command starts with a dull word, assignments before it aside."""
    parts = F.filter(F.transform(F.split(F.coalesce(command, F.lit("")), r";|&&|\|\||\|"), lambda x: strip(x)), lambda x: x != "")
    word = lambda x: F.regexp_extract(x, r"^(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s*)*(\S*)", 1)
    return F.forall(parts, lambda x: word(x).isin(*DULL))


def is_start(events_prompt: Column, name: Column) -> Column:
    return (name == "UserPromptSubmit") & (strip(F.coalesce(events_prompt, F.lit(""))) != "")


def recorded(events: DataFrame) -> DataFrame:
    """events with prompts, turns, commands and edits: what each adds to its session's counters."""
    name, tool = F.col("hook_event_name"), F.col("tool_name")
    use = name == "PostToolUse"
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return (
        events.withColumn("prompts", one(is_start(F.col("prompt"), name)))
        .withColumn("turns", one((name == "Stop") & (strip(F.coalesce("text", F.lit(""))) != "")))
        .withColumn("commands", one(use & (tool == "Bash") & ~is_dull(F.col("command"))))
        .withColumn("edits", one(use & tool.isin("Edit", "Write", "MultiEdit") & F.col("file_path").isNotNull()))
    )


def rollup(events: DataFrame) -> DataFrame:
    """One row for each session: file, title, started, ended, and the counters.

    events: session_id, seq, ts, hook_event_name, prompt, text, tool_name, command, file_path.
    """
    e = recorded(events)
    first = e.where("prompts = 1").groupBy("session_id").agg(F.min_by(F.struct("seq", "ts", "prompt"), "seq").alias("first"))
    kept = e.join(first, "session_id").where(F.col("seq") >= F.col("first.seq"))
    out = kept.groupBy("session_id").agg(
        F.first("first").alias("first"),
        F.max(F.when(F.col("hook_event_name") == "SessionEnd", F.col("ts"))).alias("ended"),
        *[F.sum(c).alias(c) for c in ("prompts", "turns", "commands", "edits")],
    )
    title = session_title(mask(F.col("first.prompt")))
    return out.select("session_id", session_file(F.col("first.ts"), F.col("session_id"), title).alias("file"), title.alias("title"), F.col("first.ts").alias("started"), "ended", "prompts", "turns", "commands", "edits")


def block(events: DataFrame, stdout_chars: int = 2000, lenient: bool = True) -> Column:
    """The Markdown that an event adds to its session's file; null if none.

    Output is cut before it is masked, so a token cut in two can stay; lenient=False masks first.
    """
    name, tool = F.col("hook_event_name"), F.col("tool_name")
    out = F.coalesce("stdout", F.lit(""))
    shown = mask(cut(out, stdout_chars)) if lenient else cut(mask(out), stdout_chars)
    callout = lambda kind, text: F.concat(F.lit(f"> [!{kind}]\n"), quote_callout(text), F.lit("\n"))
    head = lambda h, text: F.concat(F.lit(f"\n## {h}\n\n"), text, F.lit("\n"))
    return (
        F.when(is_start(F.col("prompt"), name), head("User", mask(F.col("prompt"))))
        .when((name == "Stop") & (F.coalesce("text", F.lit("")) != ""), head("Assistant", mask(F.col("text"))))
        .when((name == "PostToolUse") & (tool == "Bash") & ~is_dull(F.col("command")), callout("terminal", F.concat(F.lit("$ "), mask(F.col("command")), F.lit("\n"), shown)))
        .when((name == "PostToolUse") & tool.isin("Edit", "Write", "MultiEdit") & F.col("file_path").isNotNull(), callout("file", F.concat_ws(": ", tool, mask(F.col("file_path")))))
        .when(name == "SessionEnd", head("Summary", F.concat(F.lit("exit: "), F.coalesce("exit_reason", F.lit("unknown")))))
    )


_STATE = "first_seq long, title string, ts timestamp, ended timestamp, prompts long, turns long, commands long, edits long"
_OUT = "session_id string, title string, started timestamp, ended timestamp, prompts long, turns long, commands long, edits long"


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """Events before a session's first prompt are forgotten, as far as they came before it; a timeout removes the state.

    A session that ended keeps its state until then, since late events of it still count.
    """
    if state.hasTimedOut:
        state.remove()
        return
    first, title, ts, ended, *sums = state.get if state.exists else (None, None, None, None, 0, 0, 0, 0)
    for frame in frames:
        frame = frame.sort_values("seq")
        if first is None:
            starts = frame[frame["prompts"] == 1]
            if starts.empty:
                continue
            first, title, ts = int(starts["seq"].iloc[0]), starts["title"].iloc[0], starts["ts"].iloc[0]
        frame = frame[frame["seq"] >= first]
        sums = [int(a + frame[c].sum()) for a, c in zip(sums, ("prompts", "turns", "commands", "edits"), strict=True)]
        over = frame.loc[frame["hook_event_name"] == "SessionEnd", "ts"]
        if not over.empty:
            ended = over.max() if ended is None else max(ended, over.max())
    if first is None:
        return
    state.update((first, title, ts, ended, *sums))
    if idle_ms is not None:
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame([(key[0], title, ts, ended, *sums)], columns=["session_id", "title", "started", "ended", "prompts", "turns", "commands", "edits"])


def stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The rollup of a stream of events, in update mode: a session's row after each batch that has events of it.

    idle_ms: after so long without events a session's state goes; for streams that don't end, since Spark then goes on
    making batches to look for idle sessions.
    """

    def advance(key, frames, state):
        yield from _advance(key, frames, state, idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    # titles are made before the state: Spark can't run a Python function right on what this operator returns
    title = session_title(mask(F.coalesce("prompt", F.lit(""))))
    e = recorded(events).select("session_id", "seq", "ts", "hook_event_name", title.alias("title"), "prompts", "turns", "commands", "edits")
    out = e.groupBy("session_id").applyInPandasWithState(advance, _OUT, _STATE, "update", timeout)
    return out.select("session_id", session_file(F.col("started"), F.col("session_id"), F.col("title")).alias("file"), "title", "started", "ended", "prompts", "turns", "commands", "edits")


def activity(events: DataFrame, ts: str = "ts", length: str = "1 day", late: str | None = None) -> DataFrame:
    """Events by window and type, for batches and streams; `late` is a stream's watermark."""
    src = events.withWatermark(ts, late) if late else events
    return src.groupBy(F.window(ts, length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
