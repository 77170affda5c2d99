"""Logs and reports: what is still to be ingested, and the figures that a maintainer looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .delta import work_list

#: Pages that aren't content, what a saturated log says, and the words of a report's summary line.
NOT_CONTENT = ("index", "log", "lint-report")
SATURATED = r"(?i)max.?turns?"
SUMMARY = r"(?i)(検出|合計|total|問題の総数|問題数)"


def unprocessed(logs: DataFrame, folder: str = "session-logs", path: str = "path", text: str = "body") -> DataFrame:
    """Log files right in their folder that have a line starting `ingested: false`."""
    return logs.where(F.regexp_like(path, F.lit(rf"^{folder}/[^/]+\.md$")) & F.regexp_like(text, F.lit(r"(?m)^ingested: false")))


def due_counts(logs: DataFrame, sources: DataFrame, summaries: DataFrame, folder: str = "session-logs") -> DataFrame:
    """(kind, n): unprocessed logs, and sources by kind whose summary is missing or stale."""
    open_logs = unprocessed(logs, folder).agg(F.count(F.lit(1)).alias("n")).select(F.lit("log").alias("kind"), "n")
    return open_logs.unionByName(work_list(sources, summaries).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


def page_count(pages: DataFrame, folder: str = "wiki") -> DataFrame:
    """One row: how many pages of content there are."""
    return pages.where(F.startswith("path", F.lit(folder + "/")) & ~F.col("name").isin(*NOT_CONTENT)).agg(F.count(F.lit(1)).alias("n"))


def log_figures(logs: DataFrame, path: str = "path", text: str = "body", pattern: str = SATURATED) -> DataFrame:
    """For each file its lines, the lines that match a pattern, and the first line of a summary (null if none)."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    first = F.filter(lines, lambda x: F.regexp_like(x, F.lit(SUMMARY)))
    return logs.select(path, F.size(lines).alias("n_lines"), F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(pattern)))).alias("n_hits"), F.get(first, F.lit(0)).alias("summary"))


def alerts(flags: DataFrame, path: str = "path", text: str = "body") -> DataFrame:
    """Flag files as (name, raised): the first line says when; ? if there is none."""
    name = F.regexp_extract(path, r"([^/]+)\.flag$", 1)
    return flags.where(F.endswith(path, F.lit(".flag"))).select(name.alias("name"), F.coalesce(F.nullif(F.split(text, "\n")[0], F.lit("")), F.lit("?")).alias("raised"))
