"""The link graph: edges, snapshots and their differences, orphans, broken links, backlinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import append_related, link_targets, wikilinks


def snapshot(pages: DataFrame) -> DataFrame:
    """One row for each page name (of equal names the last path counts): name, path, type, tags, title, links."""
    last = F.max_by(F.struct("path", "type", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "title", wikilinks(F.col("body")).alias("links")), "path")
    return pages.groupBy("name").agg(last.alias("p")).select("name", "p.*")


def edges(pages: DataFrame, name: str = "name", text: str = "body") -> DataFrame:
    """Distinct links (from, to) by page name."""
    return pages.select(F.col(name).alias("from"), F.explode(wikilinks(F.col(text))).alias("to")).distinct()


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """added, removed and modified pages of two snapshots; order of tags and links is no difference, nor is the body."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        same = F.struct("type", "title", F.sort_array("tags").alias("tags"), F.sort_array("links").alias("links"))
        return df.select("name", same.alias(tag))

    both = side(before, "b").join(side(after, "a"), "name", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return both.select("name", change.alias("change")).where("change is not null")


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Links added and removed between two edge lists."""
    new = after.join(before, ["from", "to"], "left_anti").withColumn("change", F.lit("added"))
    return new.unionByName(before.join(after, ["from", "to"], "left_anti").withColumn("change", F.lit("removed")))


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that no other page links to."""
    linked = links.where(F.col("from") != F.col("to")).select(F.col("to").alias("name")).distinct()
    return pages.select("name").distinct().join(linked, "name", "left_anti")


def missing_pages(pages: DataFrame, links: DataFrame, least: int = 1) -> DataFrame:
    """Link targets without a page, and how many pages link there."""
    known = pages.select(F.explode(F.array("name", "title")).alias("to")).where("to is not null and to <> ''").distinct()
    return links.join(known, "to", "left_anti").groupBy("to").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)


def broken_links(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """For each page, however large, how often it links to one of the targets (column target), which are about to go."""
    found = pages.select("path", F.explode(link_targets(F.col("body"))).alias("target"))
    return found.join(targets.select("target").distinct(), "target", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("occurrences"))


def reference_scan(files: DataFrame, targets: DataFrame, max_bytes: int | None = None, wiki: str = "wiki/") -> DataFrame:
    """Every file (path, body, error) as far as it matters to pages about to go: status, occurrences, in_wiki and error.

    status: links; too_large (over max_bytes, so not looked at; without it all are) or unreadable (an error, 200 characters of it).
    """
    status = F.when(F.col("error").isNotNull(), "unreadable")
    if max_bytes is not None:
        status = status.when(F.octet_length("body") > max_bytes, "too_large")
    rows = files.withColumn("status", status.otherwise("links"))
    found = broken_links(rows.where("status = 'links'"), targets).select("path", F.lit("links").alias("status"), "occurrences", F.lit(None).cast("string").alias("error"))
    skipped = rows.where("status <> 'links'").select("path", "status", F.lit(0).cast("long").alias("occurrences"), F.left("error", F.lit(200)).alias("error"))
    return found.unionByName(skipped).withColumn("in_wiki", F.startswith("path", F.lit(wiki)))


def title_index(pages: DataFrame) -> DataFrame:
    """(key, path): titles and names of pages; a title beats a name, of equal titles the last path counts."""
    keys = pages.select("path", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.col("title").alias("key")), F.struct(F.lit(0).alias("rank"), F.col("name").alias("key")))).alias("k"))
    return keys.select("path", "k.*").where("key is not null and key <> ''").groupBy("key").agg(F.max_by("path", F.struct("rank", "path")).alias("path"))


def add_backlinks(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """pages with links appended: wanted has (related, target), a title or name and what to link to from there."""
    asked = wanted.join(title_index(pages).withColumnRenamed("key", "related"), "related").groupBy("path").agg(F.sort_array(F.collect_set("target")).alias("targets"))
    joined = pages.join(asked, "path", "left")
    body = F.aggregate(F.coalesce("targets", F.array().cast("array<string>")), F.col("body"), lambda text, t: F.when(t == F.col("name"), text).otherwise(append_related(text, t)))
    return joined.withColumn("body", body).drop("targets")
