"""New and changed sources by content hash; chunk plans; per-document state of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

#: A stored hash counts only as a double-quoted 64-digit value at the start of a line.
_STORED = r'(?m)^%s:\s*"([0-9a-fA-F]{64})"'


def stored_sha(text: Column, field: str = "source_sha256") -> Column:
    found = F.regexp_extract(text, _STORED % field, 1)
    return F.when(found != "", F.lower(found))


def needs_summary(src_sha: Column, has_summary: Column, sum_sha: Column) -> Column:
    """No summary, or one of another content; a source without a hash counts as done once it has a summary."""
    return ~has_summary | ((F.coalesce(src_sha, F.lit("")) != "") & (sum_sha.isNull() | (sum_sha != src_sha)))


def work_list(sources: DataFrame, summaries: DataFrame) -> DataFrame:
    """sources (kind raw, fetched or chunk; name, sha, mtime) whose summary (name, sha, mtime) is missing or stale.

    A chunk without a hash goes by time: stale if newer than its summary.
    """
    s = summaries.select("name", F.col("sha").alias("sum_sha"), F.col("mtime").alias("sum_mtime"), F.lit(True).alias("has_summary"))
    joined = sources.join(s, "name", "left").withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))
    by_time = (F.col("kind") == "chunk") & F.col("sha").isNull()
    due = F.when(by_time, ~F.col("has_summary") | (F.col("mtime") > F.col("sum_mtime"))).otherwise(needs_summary(F.col("sha"), F.col("has_summary"), F.col("sum_sha")))
    reason = F.when(~F.col("has_summary"), "missing").otherwise("stale")
    return joined.where(due).select("kind", "name", reason.alias("reason"))


def chunk_plan(docs: DataFrame, key: str = "doc", pages: str = "pages", size: int = 15, overlap: int = 1, soft: int = 500, hard: int = 1000) -> DataFrame:
    """Overlapping page ranges: (key, chunk, page_first, page_last, total_pages, truncated); above `hard` none.

    Blocks of `size` pages, each reaching `overlap` pages back; a last block of at most max(1, size // 3) new pages
    joins the one before it.
    """
    e = F.least(F.col(pages), F.lit(soft))
    n = F.ceil(e / size).cast("int")
    short = (n >= 2) & (e - (n - 1) * size <= max(1, size // 3))
    count = F.when(short, n - 1).otherwise(n)
    planned = docs.where((F.col(pages) > 0) & (F.col(pages) <= hard)).select(key, F.col(pages).alias("total_pages"), e.alias("e"), count.alias("count"))
    i = F.col("i")
    rows = planned.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i"))
    first = F.when(i == 0, 1).otherwise(F.greatest(F.lit(1), 1 + i * size - overlap))
    last = F.when(i == F.col("count") - 1, F.col("e")).otherwise((i + 1) * size)
    return rows.select(key, i.alias("chunk"), first.cast("int").alias("page_first"), last.cast("int").alias("page_last"), "total_pages", (F.col("total_pages") > soft).alias("truncated"))


def chunk_state(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """For each document: chunks, those due, the largest total_pages, whether any was truncated, whether all are empty."""
    s = summaries.select("name", F.col("sha").alias("sum_sha"), F.lit(True).alias("has_summary"))
    joined = chunks.join(s, "name", "left")
    due = needs_summary(F.col("sha"), F.coalesce("has_summary", F.lit(False)), F.col("sum_sha"))
    empty = F.regexp_replace("text", r"\s+", "") == ""
    return joined.groupBy("doc").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(due).alias("due"), F.max("total_pages").alias("total_pages"), F.bool_or("truncated").alias("truncated"), F.bool_and(empty).alias("all_empty"))


def numbered(rows: DataFrame, base: str, order: str) -> DataFrame:
    """Names that meet get -2, -3, ... in the order of a column without ties.

    One name may be shared by a large part of all rows: rows are dealt by ranges of name and order, numbered within
    each range, and moved on by the sums of the ranges before, of which there are few.
    """
    dealt = stored(rows.repartitionByRange(base, order).withColumn("_part", F.spark_partition_id()), "numbered")
    sums = dealt.groupBy(base, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(base).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(base, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(base, "_part").orderBy(order))
    placed = dealt.withColumn("_local", local).join(offsets, [base, "_part"])
    n = F.col("_local") + F.col("_before")
    return placed.withColumn("name", F.concat(base, F.when(n > 1, F.concat(F.lit("-"), n)).otherwise(""), F.lit(".md"))).drop("_part", "_local", "_before")


def of_document(names: DataFrame, docs: DataFrame, summaries: bool = False) -> DataFrame:
    """The chunk files (column name) of documents (subdir, stem), by the names of now (subdir--stem-pp) and before (subdir-stem-pp).

    summaries: also their indexes (-index). Matched by equality on what stands before the last -pp or -index.
    """
    def heads(mark: str) -> Column:
        # a stem can hold the mark itself: what stands before each place of it is a candidate
        parts = F.split("name", mark)
        return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda _, k: F.array_join(F.slice(parts, F.lit(1), k + 1), mark))

    found = F.concat(heads("-pp"), heads("-index")) if summaries else heads("-pp")
    rows = names.where(F.endswith("name", F.lit(".md"))).select("name", F.explode(F.array_distinct(found)).alias("head"))
    wanted = docs.select("subdir", "stem", F.explode(F.array(F.concat_ws("--", "subdir", "stem"), F.concat_ws("-", "subdir", "stem"))).alias("head"))
    return rows.join(wanted, "head").select("subdir", "stem", "name").distinct()


def expected_summary(subdir: Column, name: Column) -> Column:
    """The summary that a source's chunk is to have."""
    return F.concat(F.lit("wiki/summaries/"), F.when(F.startswith(name, F.concat(subdir, F.lit("-"))), name).otherwise(F.concat(subdir, F.lit("--"), name)))
