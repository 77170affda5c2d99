"""Missing cross-links: pages that name another page's title without linking to it.

A dictionary of many titles is matched against all texts as joins by runs of words. Each title is filed under its beginning,
its first ANCHOR words (all of a shorter one); the beginnings at each place of a text fetch the lengths of the titles that could
stand there, and the runs of these lengths meet the titles by equality. So the work grows with the places and with what is found:
titles of the same words elsewhere, or of the same beginning, are never compared with a text one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import wikilinks
from ..shared import stored
from .search import words_of

#: Titles of up to so many are broadcast.
MAX_BROADCAST = 50_000
#: Words of a title's beginning.
ANCHOR = 4


def _code(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def _places(words: Column, k: int) -> Column:
    """Every place with the code of the k words from there on; null for fewer words."""
    every = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(every, lambda i: F.struct(i.alias("at"), _code(words, i, k).alias("code"))))


def titles_of(pages: DataFrame, least: int = 2) -> DataFrame:
    """(title, path, words): titles of at least `least` words as a run of words; of equal ones the last path counts."""
    words = words_of(F.coalesce("title", F.lit("")))
    rows = pages.select("path", words.alias("words")).where(F.size("words") >= least)
    return rows.groupBy("words").agg(F.max("path").alias("path")).select(F.array_join("words", " ").alias("title"), "path", "words")


def possible(texts: DataFrame, titles: DataFrame) -> DataFrame:
    """(row, path, at, size, title): runs of words in texts (row, path, w) that begin as a title (size, words) of their length does."""
    k = F.least("size", F.lit(ANCHOR))
    sizes = sorted(r[0] for r in titles.select(k).distinct().collect())  # at most ANCHOR numbers
    code = F.coalesce(*[F.when(k == n, _code(F.col("words"), F.lit(0), n)) for n in sizes or [1]])
    filed = titles.select(code.alias("code"), "size").groupBy("code").agg(F.collect_set("size").alias("sizes"))
    none = F.array().cast("array<struct<at: int, code: bigint>>")
    begins = F.concat(none, *[F.coalesce(_places(F.col("w"), n), none) for n in sizes])
    places = texts.select("row", F.explode(begins).alias("b")).select("row", "b.*")
    could = places.join(_small(titles)(filed), "code").select("row", F.explode("sizes").alias("size"), "at").distinct()
    asked = could.groupBy("row").agg(F.collect_list(F.struct("at", "size")).alias("asked"))  # at most so many as a text has places, for each length
    runs = texts.join(asked, "row").select("row", "path", "w", F.explode("asked").alias("a")).where(F.col("a.at") + F.col("a.size") <= F.size("w"))
    return runs.select("row", "path", "a.at", "a.size", F.array_join(F.slice("w", F.col("a.at") + 1, F.col("a.size")), " ").alias("title"))


def _small(titles: DataFrame):
    return F.broadcast if titles.count() <= MAX_BROADCAST else (lambda df: df)


def mentions(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(path, title, target, times): how often each page's body names each title (title, path, words); its own too."""
    titles = stored(titles.select("title", F.col("path").alias("target"), F.size("words").alias("size"), "words"), "titles")
    texts = pages.select("path", words_of(F.coalesce("body", F.lit(""))).alias("w")).withColumn("row", F.monotonically_increasing_id())
    texts = stored(texts.where(F.size("w") > 0), "words")
    found = possible(texts, titles).join(_small(titles)(titles.select("title", "target")), "title")
    # names are counted from the left, without overlaps
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("times"))
    step = lambda s, at: F.when(at >= s["end"], F.struct((at + F.col("size")).alias("end"), (s["times"] + 1).alias("times"))).otherwise(s)
    counted = found.groupBy("row", "path", "title", "target", "size").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return counted.select("path", "title", "target", F.aggregate("at", start, step)["times"].alias("times"))


def missing_links(pages: DataFrame, least: int = 2) -> DataFrame:
    """(path, target, title, times): pages (path, name, title, body) that name another page's title and don't link to it.

    A link counts by the other page's title or name, as written or in other case; least: words of a title that is looked for.
    """
    named = stored(mentions(pages, titles_of(pages, least)).where(F.col("path") != F.col("target")), "mentions")
    names = pages.select(F.col("path").alias("target"), F.lower("name").alias("name"), F.array_join(words_of(F.coalesce("title", F.lit(""))), " ").alias("whole"))
    links = pages.select("path", F.explode(wikilinks(F.col("body"))).alias("to"))
    linked = links.select("path", F.lower("to").alias("to"), F.array_join(words_of(F.col("to")), " ").alias("whole"))
    by_name = named.join(names.select("target", "name"), "target").join(linked.select("path", F.col("to").alias("name")).distinct(), ["path", "name"], "left_semi").select("path", "target")
    by_title = named.join(linked.select("path", F.col("whole").alias("title")).distinct(), ["path", "title"], "left_semi").select("path", "target")
    return named.join(by_name.unionByName(by_title).distinct(), ["path", "target"], "left_anti").select("path", "target", "title", "times")
