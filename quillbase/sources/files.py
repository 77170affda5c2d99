"""Files as tables: pages of a vault, URL lists, commits, transcripts and session events."""

from __future__ import annotations

import re
import subprocess

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import front_matter as fm
from ..functions.text import base_name, first_heading, parent, strip


def text_of(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def pages(spark: SparkSession, root: str, cap: int | None = None) -> DataFrame:
    """Markdown files below root: path, name, folder, size, mtime, sha256, fm (raw map), title, type, tags, body."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{re.escape(base)}/", "")
    content = text_of(F.substring("content", 1, cap) if cap else F.col("content"))
    rows = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), content.alias("raw"))
    rows = rows.select("*", fm.parse(F.col("raw")).alias("fm"), fm.body(F.col("raw")).alias("body"))
    fields = F.col("fm")
    title = F.coalesce(fm.string(fields, "title"), F.when(first_heading(F.col("body")) != "", first_heading(F.col("body"))))
    return rows.select("path", base_name(F.col("path")).alias("name"), parent(F.col("path")).alias("folder"), "size", "mtime", "sha256", "fm", title.alias("title"), fm.string(fields, "type").alias("type"), F.coalesce(fm.strings(fields, "tags"), F.array().cast("array<string>")).alias("tags"), "body", "raw")


#: The keys that a line of a URL list may have.
URL_KEYS = ("tags", "title", "source_type", "refresh_days")


def url_list(files: DataFrame, key: str = "file", text: str = "txt") -> DataFrame:
    """Lines `URL [; key=value]*` as rows: url, tags, title, source_type, refresh_days, line_no, warnings.

    A line that isn't a URL is a row without url; a comment is a whole line, or what follows " #".
    """
    lines = files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("at", "raw"))
    bare = F.when(F.regexp_like("raw", F.lit(r"^\s*#")), "").otherwise(F.regexp_replace("raw", r"(?s)^(.*?) #.*$", "$1"))
    lines = lines.select(key, (F.col("at") + 1).alias("line_no"), strip(bare).alias("line")).where("line <> ''")
    parts = F.transform(F.split("line", ";"), lambda x: strip(x))
    lines = lines.select(key, "line_no", parts[0].alias("first"), F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x != "").alias("rest"))
    pairs = F.transform(F.filter("rest", lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(strip(F.regexp_extract(x, "^([^=]*)=", 1)).alias("key"), strip(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("value")))
    lines = lines.withColumn("pairs", pairs).withColumn("is_url", F.regexp_like("first", F.lit("^https?://")))
    valid = lambda v: (v == "never") | (F.regexp_like(v, F.lit(r"^\d{1,9}$")) & v.try_cast("int").between(1, 3650))
    usable = lambda p: p["key"].isin(*URL_KEYS) & ((p["key"] != "refresh_days") | valid(p["value"]))
    last = lambda name: F.element_at(F.transform(F.filter("pairs", lambda p: usable(p) & (p["key"] == name)), lambda p: p["value"]), -1)
    get = lambda name: F.when(F.exists("pairs", lambda p: usable(p) & (p["key"] == name)), last(name))
    at = F.concat(F.lit("line "), "line_no", F.lit(": "))
    no_equals = F.transform(F.filter("rest", lambda x: ~F.contains(x, F.lit("="))), lambda x: F.concat(at, F.lit('malformed DSL (no "="): '), x))
    unknown = F.transform(F.filter("pairs", lambda p: ~p["key"].isin(*URL_KEYS)), lambda p: F.concat(at, F.lit("unknown DSL key: "), p["key"]))
    bad_days = F.transform(F.filter("pairs", lambda p: (p["key"] == "refresh_days") & ~valid(p["value"])), lambda p: F.concat(at, F.lit("invalid refresh_days value: "), p["value"]))
    warnings = F.when(F.col("is_url"), F.concat(no_equals, unknown, bad_days)).otherwise(F.array(F.concat(at, F.lit("not a URL: "), "first")))
    tags = F.filter(F.transform(F.split(get("tags"), ","), lambda t: strip(t)), lambda t: t != "")
    url = F.when(F.col("is_url"), F.col("first"))
    only = lambda c: F.when(F.col("is_url"), c)
    return lines.select(key, url.alias("url"), only(tags).alias("tags"), only(get("title")).alias("title"), only(get("source_type")).alias("source_type"), only(get("refresh_days")).alias("refresh_days"), "line_no", warnings.alias("warnings"))


def parse_commits(logs: DataFrame, text: str = "value") -> DataFrame:
    """Commits of a log text: `COMMIT` and five fields, each behind U+001F, then a line for each file."""
    entries = logs.select(F.explode(F.split(text, "(?m)^COMMIT\x1f")).alias("entry")).where(F.contains("entry", F.lit("\x1f")))
    lines = F.split("entry", r"\r?\n")
    head = F.split(lines[0], "\x1f", 5)
    files = F.filter(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: strip(x)), lambda x: x != "")
    return entries.select(head[0].alias("sha"), head[1].alias("short_sha"), F.timestamp_seconds(head[2].cast("long")).alias("ts"), head[3].alias("author"), head[4].alias("subject"), files.alias("files"))


_SHA = re.compile(r"^[0-9a-f]{4,40}$")
MAX_OUTPUT = 16 << 20
#: Commits that one call of git reads.
SLICE = 500


def _git(repo: str, *args: str) -> str:
    out = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True, timeout=60).stdout
    if len(out) > MAX_OUTPUT:
        raise ValueError("the output of git is over 16 MiB")
    return out.decode("utf-8", "replace")


def _git_rows(spark: SparkSession, repo: str, calls: DataFrame, schema: str, read) -> DataFrame:
    """read(row of calls) -> rows, run by the executors, which must see the repository."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = read(row)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    return calls.mapInArrow(run, schema)


def commits(spark: SparkSession, repo: str, sub_path: str | None = None, since: str | None = None, max_commits: int = 1000) -> DataFrame:
    """A repository's commits without merges, newest first: sha, short_sha, ts, author, subject, files.

    The log is read in slices of SLICE commits, each by the executor that parses it.
    """
    if not 1 <= max_commits <= 100_000:
        raise ValueError("max_commits: 1 to 100000")
    args = ["log", "--no-merges", "--name-only", "--pretty=format:COMMIT%x1f%H%x1f%h%x1f%ct%x1f%an%x1f%s"]
    args += [f"--since={since}"] if since else []
    end = ["--", *([sub_path] if sub_path else [])]
    slices = spark.range(0, -(-max_commits // SLICE), 1, -(-max_commits // SLICE))

    def read(row):
        skip = row["id"] * SLICE
        return [{"value": _git(repo, *args, f"--skip={skip}", f"--max-count={min(SLICE, max_commits - skip)}", *end)}]

    return parse_commits(_git_rows(spark, repo, slices, "value string", read)).orderBy(F.desc("ts"))


def pages_at(spark: SparkSession, repo: str, sha: str, sub_path: str = "") -> DataFrame:
    """The Markdown files of a commit: path, raw. Names are listed by one call, texts are read by the executors, some files a task."""
    if not _SHA.match(sha):
        raise ValueError("not a commit")
    listed = _git_rows(spark, repo, spark.range(0, 1, 1, 1), "path string", lambda _: [{"path": n} for n in _git(repo, "ls-tree", "-r", "--name-only", "-z", sha, *(["--", sub_path] if sub_path else [])).split("\0") if n.endswith(".md")])
    dealt = listed.repartition(spark.sparkContext.defaultParallelism, "path")
    return _git_rows(spark, repo, dealt, "path string, raw string", lambda row: [{"path": row["path"], "raw": _git(repo, "show", f"{sha}:{row['path']}")}])


HOOK = (
    "session_id string, hook_event_name string, prompt string, cwd string, transcript_path string, tool_name string, "
    "tool_input struct<command: string, file_path: string, edits: array<struct<old_string: string>>>, tool_response struct<stdout: string>, exit_reason string"
)
#: The events and tools that are recorded.
HOOK_EVENTS = ("UserPromptSubmit", "Stop", "PostToolUse", "SessionEnd")
TOOLS = ("Bash", "Edit", "Write", "MultiEdit")


def hook_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """Events from JSON lines; what isn't an event of a session is left out."""
    rows = lines.withColumn("e", F.from_json(text, HOOK))
    kept = F.col("e.session_id").isNotNull() & F.col("e.hook_event_name").isin(*HOOK_EVENTS)
    return rows.where(kept).select(*[c for c in lines.columns if c != text], "e.*")


_TRANSCRIPT = "struct<type: string, message: struct<content: array<struct<type: string, text: string>>>>"


def assistant_text(lines: DataFrame, text: str = "line") -> DataFrame:
    """Transcript lines as the assistant's text: parts of a message joined as they are; others left out."""
    rows = lines.withColumn("m", F.from_json(text, _TRANSCRIPT))
    parts = F.transform(F.filter("m.message.content", lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    return rows.where("m.type = 'assistant'").withColumn("text", F.array_join(parts, "")).where("text <> ''").drop("m")


def assistant_messages(lines: DataFrame, key: str = "path", order: str = "offset", text: str = "line") -> DataFrame:
    """For each transcript the assistant's messages of these lines in order, a blank line between them."""
    said = assistant_text(lines, text)
    return said.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda m: m["text"]), "\n\n").alias("text"))
