"""One vault as an object: the tools of the knowledge base over its tables."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import KBConfig, check_search
from .operators import graph, pages, search, store
from .plans import ingest, views
from .sources import files


class KBError(ValueError):
    """code and message of a refused call."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def checked_path(path: str, limit: int = 512) -> str:
    """A relative path that stays below its root."""
    if not path or len(path) > limit or "\0" in path:
        raise KBError("invalid_path", "empty, too long, or with a null character")
    if path.startswith("/"):
        raise KBError("absolute_path", path)
    if not re.fullmatch(r"[\w/. -]+", path):
        raise KBError("invalid_path", "unsafe characters")
    depth = 0
    for part in path.split("/"):
        depth += {"..": -1, ".": 0, "": 0}.get(part, 1)
        if depth < 0:
            raise KBError("path_traversal", path)
    return path


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str, config: KBConfig | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or KBConfig()

    @property
    def pages(self) -> DataFrame:
        return files.pages(self.spark, self.root).where(F.startswith("path", F.lit("wiki/")))

    def now(self):
        return F.lit(dt.datetime.now(dt.UTC).replace(tzinfo=None))

    def read(self, path: str) -> DataFrame:
        rows = self.spark.read.format("binaryFile").load(f"{self.root}/wiki/{checked_path(path)}")
        return rows.select(*[c.alias(k) for k, c in pages.read(F.col("content"), self.config.read_max_bytes).items()])

    def list(self, subdir: str = "", depth: int = 3) -> DataFrame:
        base = "wiki" + (f"/{checked_path(subdir)}" if subdir else "")
        return pages.listing(self.pages.select("path", "size", "mtime"), base, min(depth, self.config.list_max_depth), self.config.list_max_entries)

    def search(self, query: str, limit: int = 10, mode: str = "lex", near: DataFrame | None = None, include_logs: bool | None = None) -> DataFrame:
        """Hits (path, score, note). near: (path, score), the top of the pages' vectors by operators.search.nearest.

        Without near, vec and hybrid fall back to BM25, and note says so. include_logs: search the collections (wiki
        and sources, logs if true) instead of the wiki alone.
        """
        query, limit, mode = check_search(query, limit, mode)
        p = self.pages if include_logs is None else search.in_collections(files.pages(self.spark, self.root), include_logs)
        note = None
        if mode == "lex" or near is None:
            hits = search.bm25(p, query, limit)
            note = None if mode == "lex" else "no vectors were given: BM25 alone"
        elif mode == "vec":
            hits = near.select("path", "score").orderBy(F.desc("score"), "path").limit(limit)
        else:
            hits = search.fuse([search.bm25(p, query, 50), near], limit)
        return hits.withColumn("note", F.lit(note).cast("string"))

    def write_notes(self, notes: DataFrame) -> DataFrame:
        return store.notes(notes, self.now())

    def upsert_pages(self, changes: DataFrame) -> DataFrame:
        return store.upsert(self.pages.select("path", "fm", "body"), changes, dt.datetime.now(dt.UTC).date().isoformat())

    def archive(self, path: str, force: bool = False) -> DataFrame:
        """Pages after one is archived; refused while others link to it, unless forced."""
        target = f"wiki/{checked_path(path)}"
        p = self.pages
        one = p.where(F.col("path") == target)
        names = one.select(F.explode(F.array("name", "title")).alias("target")).where("target is not null")
        broken = None if force else graph.broken_links(p.where(F.col("path") != target), names).select(F.lit(target).alias("path"))
        return store.archive(p, one.select("path"), self.now(), broken)

    def ingest_documents(self, glob: str, page_texts: DataFrame | None = None) -> DataFrame:
        found = self.spark.read.format("binaryFile").load(f"{self.root}/raw-sources/{glob}")
        return ingest.documents(found.select("path", "content"), page_texts, self.config)

    def ingest_pages(self, web: DataFrame, stored: DataFrame, rules: DataFrame | None = None) -> DataFrame:
        return ingest.fetched(web, stored, self.now(), self.config, rules)

    def view(self, view: views.View) -> DataFrame:
        p = self.pages
        keys = [c for c in view.columns if c not in (*p.columns, "age_days", "name")]
        for k in {*keys, "status"}:
            p = p.withColumn(k, F.col("fm")[k])
        return views.evaluate(p, view, self.now())

    def lint(self) -> DataFrame:
        return ingest.lint(self.pages)
