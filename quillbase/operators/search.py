"""Search: words as substrings, BM25, vectors, and both fused by reciprocal ranks. All end in a top-k."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_heading, hit_count, snippet, tokens
from ..shared import stored

_WORD = r"[\p{L}\p{N}]+"


def lexical(pages: DataFrame, query: str, limit: int = 10, key: str = "path", text: str = "body", head: int | None = None) -> DataFrame:
    """Pages that hold most of the query's words, best first; ties by key.

    head: only so many characters of a page are searched, as in the reference's fallback scan (8192).
    """
    words = tokens(query)
    if not words:
        return pages.select(F.col(key), F.lit("").alias("title"), F.lit(0).alias("score"), F.lit("").alias("snippet")).where(F.lit(False))
    start = F.col(text) if head is None else F.left(text, F.lit(head))
    hits = pages.withColumn("score", hit_count(start, words)).where("score > 0")
    top = hits.orderBy(F.desc("score"), key).limit(max(1, min(50, limit)))
    return top.select(key, first_heading(start).alias("title"), "score", snippet(start, words[0]).alias("snippet"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0)


def query_words(query: str) -> list[str]:
    """The distinct words of a query, split as texts are: c++ is c, e-mail is e and mail."""
    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def _okapi(tf: Column, n: Column, docs: Column, mean: Column, df: Column, k1: float, b: float) -> Column:
    return F.log((docs - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))


def bm25(pages: DataFrame, query: str, limit: int = 10, key: str = "path", text: str = "body", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 for one query: one scan of the texts, whose counts are stored; the sums over all pages are of those."""
    words = query_words(query)
    low = F.lower(text)
    near = lambda q: F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}]){q}(?![\p{{L}}\p{{N}}])"))
    # most texts don't hold the word at all, which is quickly seen
    whole = lambda q: F.when(F.contains(low, F.lit(q)), near(q)).otherwise(0)
    rows = pages.select(key, F.regexp_count(low, F.lit(_WORD + "+")).alias("n"), *[whole(q).cast("double").alias(f"t{i}") for i, q in enumerate(words)])
    rows = stored(rows, "bm25")
    stats = rows.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(words))])
    score = F.lit(0.0)
    for i in range(len(words)):
        score = score + _okapi(F.col(f"t{i}"), F.col("n"), F.col("s.docs"), F.col("s.mean"), F.col(f"s.d{i}"), k1, b)
    # one row, as a scalar subquery
    scored = rows.withColumn("s", stats.select(F.struct("*").alias("s")).scalar()).select(key, F.round(score, 6).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def term_counts(rows: DataFrame) -> DataFrame:
    """rows (w: words) with n, how many, and terms, the distinct ones with their counts (term, tf) in order, in place of w.

    Counted within the rows, so that nothing is shuffled.
    """
    names = [c for c in rows.columns if c != "w"]
    words = rows.select(*names, F.size("w").alias("n"), F.sort_array("w").alias("w"))
    # sorted words: a term's count is the distance of its first places
    at = F.filter(F.transform("w", lambda x, i: F.when((i == 0) | (F.get("w", i - 1) != x), i)), lambda i: i.isNotNull())
    terms = F.transform("at", lambda i, k: F.struct(F.get("w", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.col("n")) - i).alias("tf")))
    return words.select(*names, "n", "w", at.alias("at")).select(*names, "n", terms.alias("terms"))


def inverted_index(pages: DataFrame, key: str = "path", text: str = "body") -> DataFrame:
    """(term, key, tf, n): each distinct word of each page with its count there and the page's words; a page without words is one row without term.

    Counted within the rows; store it by term to serve many queries.
    """
    counted = term_counts(pages.select(F.col(key).alias("key"), words_of(F.col(text)).alias("w")))
    return counted.select("key", "n", F.explode_outer("terms").alias("t")).select("t.term", "key", F.coalesce("t.tf", F.lit(0)).alias("tf"), "n")


def bm25_indexed(index: DataFrame, query: str, docs: int, mean: float, limit: int = 10, key: str = "path", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 from a stored inverted index: only the rows of the query's words are read. docs, mean: of the index's pages."""
    hits = index.where(F.col("term").isin(query_words(query)))
    # a row for each word of the query
    sizes = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    score = _okapi(F.col("tf").cast("double"), F.col("n"), F.lit(docs), F.lit(mean), F.col("df"), k1, b)
    scored = hits.join(F.broadcast(sizes), "term").groupBy(F.col("key").alias(key)).agg(F.round(F.sum(score), 6).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), key).limit(limit)


#: The collections and their folders; logs only where asked for.
COLLECTIONS = {"brain-wiki": "wiki", "brain-sources": "raw-sources", "brain-logs": "session-logs"}


def in_collections(pages: DataFrame, include_logs: bool = False, path: str = "path") -> DataFrame:
    """pages of the collections, with the column collection."""
    found = F.lit(None).cast("string")
    for name, folder in COLLECTIONS.items():
        if include_logs or name != "brain-logs":
            found = F.coalesce(found, F.when(F.startswith(path, F.lit(folder + "/")), name))
    return pages.withColumn("collection", found).where("collection is not null")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: Sequence[float], limit: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows by cosine to one vector, best first."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(cosine(F.col(vector), literal), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def fuse(lists: Sequence[DataFrame], limit: int = 10, key: str = "path", k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of top-k lists (key, score)."""
    ranked = None
    for hits in lists:
        # a list of hits is a top-k already
        r = hits.select(key, (1.0 / (k + F.row_number().over(Window.orderBy(F.desc("score"), key)))).alias("part"))
        ranked = r if ranked is None else ranked.unionByName(r)
    return ranked.groupBy(key).agg(F.round(F.sum("part"), 8).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def normal_hits(hits: DataFrame) -> DataFrame:
    """Hits of another engine (file, title, score, snippet) as ours: the path without its scheme, a score or null."""
    plain = F.regexp_replace("file", r"\x1b\[[0-9;?]*[a-zA-Z]", "")
    return hits.select(F.regexp_replace(plain, r"^[a-z]+://[^/]*/?", "").alias("path"), F.coalesce("title", F.lit("")).alias("title"), F.expr("try_cast(score as double)").alias("score"), F.coalesce("snippet", F.lit("")).alias("snippet"))


def term_statistics(pages: DataFrame, key: str = "path", text: str = "body") -> DataFrame:
    """(term, docs, n) over all pages, in one shuffle by term: a page's words, and each of them once more, marked, for the page."""
    words = words_of(F.col(text))
    # no word holds the mark
    once = F.transform(F.array_distinct("w"), lambda x: F.concat(F.lit("\0"), x))
    rows = pages.select(words.alias("w")).select(F.explode(F.concat("w", once)).alias("x"))
    marked = F.startswith("x", F.lit("\0"))
    rows = rows.select(F.when(marked, F.expr("substring(x, 2)")).otherwise(F.col("x")).alias("term"), marked.cast("long").alias("docs"))
    return rows.groupBy("term").agg(F.sum("docs").alias("docs"), (F.count(F.lit(1)) - F.sum("docs")).alias("n"))
