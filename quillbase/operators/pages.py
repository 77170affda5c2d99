"""Pages: listing, reading, lint of invisible characters, context, dashboard views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import INVISIBLE, base_name, safe_for_prompt

#: Folders that listings and scans leave out.
HIDDEN = (".obsidian", ".archive", ".trash", "templates")


def listing(pages: DataFrame, base: str = "", depth: int = 3, limit: int = 1000) -> DataFrame:
    """Files and folders below `base`, by path, to a depth and at most `limit` (the listing's own cap).

    pages: path, size, mtime. Returns path, type, size, mtime and truncated (whether the limit cut the list).
    """
    depth = max(1, min(5, depth))
    rel = F.when(F.lit(base) == "", F.col("path")).otherwise(F.regexp_replace("path", f"^{base}/", ""))
    parts = F.split("rel", "/")
    shown = pages.where(F.lit(base == "") | F.startswith("path", F.lit(f"{base}/"))).withColumn("rel", rel)
    shown = shown.where(F.endswith("path", F.lit(".md")) & ~F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(*HIDDEN)))
    files = shown.where(F.size(parts) <= depth).select("path", F.lit("file").alias("type"), "size", "mtime")
    levels = F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(depth)))
    folders = shown.where(F.size(parts) > 1).select(F.explode(F.transform(levels, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("rel")).distinct()
    folders = folders.select(F.concat(F.lit(f"{base}/" if base else ""), "rel").alias("path"), F.lit("dir").alias("type"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"))
    top = files.unionByName(folders).orderBy("path", "type").limit(limit + 1)
    # the window runs over at most limit + 1 rows
    w = Window.orderBy("path", "type")
    return top.withColumn("n", F.row_number().over(w)).withColumn("truncated", F.max("n").over(Window.partitionBy()) > limit).where(F.col("n") <= limit).drop("n")


def read(content: Column, cap: int = 262_144) -> dict[str, Column]:
    """A file's text to a number of bytes, with its true size; a character cut in two becomes U+FFFD."""
    return {
        "contents": F.make_valid_utf8(F.substring(content, 1, cap).cast("string")),
        "truncated": F.octet_length(content) > cap,
        "byte_size": F.octet_length(content),
    }


def invisible_lines(pages: DataFrame, key: str = "path", text: str = "body") -> DataFrame:
    """For each page with invisible characters: the numbers of the lines that hold them, as text.

    Lines stay within their row (arrays), so nothing is shuffled.
    """
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.when(F.regexp_like(x, F.lit(INVISIBLE)), i + 1))
    found = F.filter(lines, lambda x: x.isNotNull())
    return pages.where(F.regexp_like(text, F.lit(INVISIBLE))).select(safe_for_prompt(F.col(key).cast("string")).alias(key), F.array_join(found.cast("array<string>"), ",").alias("lines"), F.size(found).alias("n_lines"))


def missing_fields(pages: DataFrame, required=("title", "tags", "updated"), fields: str = "fm") -> DataFrame:
    """Pages without some of the required front matter, and which."""
    absent = F.array_compact(F.array(*[F.when(F.col(fields)[k].isNull() | F.col(fields)[k].isin("", "null", "~"), k) for k in required]))
    return pages.select("path", absent.alias("missing")).where(F.size("missing") > 0)


def with_age(pages: DataFrame, now: Column, mtime: str = "mtime") -> DataFrame:
    return pages.withColumn("age_days", F.floor((F.unix_timestamp(now) - F.unix_timestamp(mtime)) / 86400).cast("long"))


def in_folder(folder: str, path: str = "path") -> Column:
    return F.contains(F.concat(F.lit("/"), path), F.lit(f"/{folder}/"))


def page_names(pages: DataFrame) -> DataFrame:
    return pages.withColumn("name", base_name(F.col("path")))
