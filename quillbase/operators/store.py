"""Writes: notes, page upserts, archiving, content-addressed images. Pure transforms, then one staged write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import front_matter as fm
from ..functions.text import archive_stamp, dated_append, mask, note_slug, strip
from ..shared import stored
from .delta import numbered


def notes(rows: DataFrame, now: Column, host: str = "", source: str = "cli", max_tags: int = 16) -> DataFrame:
    """Notes (title, body, tags) as files: masked, named by time and slug, with -2, -3, ... where names meet."""
    title, body = mask(F.col("title")), mask(F.col("body"))
    tags = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: strip(t)), lambda t: t != "")), 1, max_tags)
    rows = rows.select(title.alias("title"), body.alias("body"), tags.alias("tags"))
    masked = mask(F.array_join("tags", "\x1f"))
    rows = rows.withColumn("tags", F.when(F.size("tags") > 0, F.split(masked, "\x1f")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("base", F.concat(F.date_format(now, "yyyyMMdd-HHmmss"), F.lit("-mcp-"), note_slug(F.col("title"))))
    fields = {"type": F.lit("mcp-note"), "source": F.lit(source), "created": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "hostname": fm.scalar(F.lit(host)), "ingested": F.lit("false"), "related": F.lit("[]"), "tags": fm.tag_list(F.col("tags"))}
    content = fm.render(fields, F.concat(F.lit("\n# "), "title", F.lit("\n\n"), "body", F.lit("\n")))
    out = rows.withColumn("content", content).withColumn("order", F.sha2("content", 256))
    return numbered(out, "base", "order").select("name", "content")


def upsert(pages: DataFrame, changes: DataFrame, today: str) -> DataFrame:
    """pages (path, fm, body) after changes (path, mode, fm, body), with the column outcome.

    create on an existing path is refused (file_exists); append adds a dated section; merge replaces the body if there
    is one and merges the front matter; append and merge on a missing path create it.
    """
    new = changes.select("path", "mode", F.col("fm").alias("new_fm"), mask(F.col("body")).alias("new_body"))
    both = pages.select("path", F.col("fm").alias("old_fm"), F.col("body").alias("old_body"), F.lit(True).alias("there")).join(new, "path", "full_outer")
    there, mode = F.coalesce("there", F.lit(False)), F.col("mode")
    stamp = F.create_map(F.lit("updated"), F.lit(today))
    created = F.create_map(F.lit("created"), F.lit(today), F.lit("updated"), F.lit(today))
    outcome = F.when(mode.isNull(), "kept").when(~there, "created").when(mode == "create", "file_exists").when(mode == "append", "appended").otherwise("merged")
    body = F.when(mode.isNull() | (there & (mode == "create")), F.col("old_body")).when(~there, F.col("new_body")).when(mode == "append", dated_append(F.col("old_body"), F.lit(today), F.col("new_body"))).otherwise(F.coalesce(F.when(F.col("new_body") != "", F.col("new_body")), "old_body"))
    merged = fm.merge(fm.merge(F.col("old_fm"), F.col("new_fm")), stamp)
    fields = F.when(mode.isNull() | (there & (mode == "create")), F.col("old_fm")).when(~there, fm.merge(created, F.col("new_fm"))).otherwise(merged)
    return both.select("path", fields.alias("fm"), body.alias("body"), outcome.alias("outcome"))


#: Pages that are never archived.
PROTECTED = ("wiki/index.md",)


def archive(pages: DataFrame, paths: DataFrame, now: Column, broken: DataFrame | None = None) -> DataFrame:
    """pages with archived ones moved under .archive, and the column outcome.

    The index is protected; with `broken` (paths that others still link to), those are refused.
    """
    asked = paths.select("path").distinct().withColumn("asked", F.lit(True))
    joined = pages.join(asked, "path", "left")
    if broken is None:
        joined = joined.withColumn("linked", F.lit(None).cast("boolean"))
    else:
        joined = joined.join(broken.select("path").distinct().withColumn("linked", F.lit(True)), "path", "left")
    outcome = F.when(F.col("asked").isNull(), "kept").when(F.col("path").isin(*PROTECTED), "protected").when(F.col("linked"), "broken_links").otherwise("archived")
    rel = F.regexp_replace("path", "^wiki/", "")
    moved = F.concat(F.lit("wiki/.archive/"), F.regexp_replace(rel, r"\.md$", ""), F.lit("-"), archive_stamp(now), F.lit(".md"))
    return joined.withColumn("outcome", outcome).withColumn("path", F.when(F.col("outcome") == "archived", moved).otherwise(F.col("path"))).drop("asked", "linked")


def images(rows: DataFrame) -> DataFrame:
    """(host, sha256, ext, content) stored once for each host and content."""
    hashed = rows.withColumn("sha256", F.sha2("content", 256))
    return hashed.groupBy("host", "sha256").agg(F.min("ext").alias("ext"), F.first("content").alias("content")).withColumn("path", F.concat_ws("", F.lit("media/"), "host", F.lit("/"), "sha256", F.lit("."), "ext"))


def expired(files: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return files.where(F.col("mtime") < now - F.make_dt_interval(F.lit(days)))


def write(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Replaces a table; Spark's committer stages the files, so readers see the old or the new ones."""
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def stored_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """df in the shared folder, dealt out and sorted by a key, so that filters on the key read few row groups.

    By hashes, not ranges: for the bounds of ranges Spark would compute df once more.
    """
    return stored(df.repartition(F.col(key)).sortWithinPartitions(key), label)
