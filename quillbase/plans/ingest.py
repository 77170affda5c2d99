"""Ingestion flows as single plans: fetched pages, page texts of documents, archives, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..config import KBConfig
from ..functions import front_matter as fm
from ..functions import html, text, urls
from ..operators import delta, graph, mentions, pages
from ..sources import archives


def fetched(web: DataFrame, stored: DataFrame, now: Column, config: KBConfig | None = None, rules: DataFrame | None = None, agent: str = "kb") -> DataFrame:
    """web (url, html, content_type, truncated) against stored (name, source_sha256, refresh_days, fetched_at).

    status: an error code of the URL, robots_disallowed, unsupported_content_type, dispatched_to_pdf,
    skipped_never, skipped_within_refresh, extraction_failed (too little text), skipped_same_sha, or
    fetched_and_summarized_pending; markdown and source_sha256 (of the masked text) where a page was read.
    """
    config = config or KBConfig()
    src = web.withColumn("name", urls.file_name(F.col("url"))).withColumn("host", urls.parts(F.col("url"))["host"]).withColumn("path", urls.parts(F.col("url"))["path"])
    if rules is not None and not config.ignore_robots:
        src = urls.robots_allowed(src.withColumn("ua", F.lit(agent)), rules).drop("ua")
    else:
        src = src.withColumn("allowed", F.lit(True))
    old = stored.select("name", F.col("source_sha256").alias("old_sha"), F.col("refresh_days").cast("string").alias("policy"), "fetched_at")
    src = src.join(old, "name", "left")
    fresh = urls.fresh(F.col("old_sha"), F.col("policy"), F.col("fetched_at"), now, config.refresh_days, not config.lenient)
    route = urls.content_route(F.col("content_type"), F.col("url"))
    never = (F.lit(config.refresh_days is None) | (F.coalesce("policy", F.lit("")) == "never")) & (F.coalesce("old_sha", F.lit("")) != "")
    early = F.coalesce(
        urls.safety_code(F.col("url")),
        F.when(~F.col("allowed"), "robots_disallowed").when(route == "reject", "unsupported_content_type").when(route == "pdf", "dispatched_to_pdf").when(never, "skipped_never").when(fresh, "skipped_within_refresh"),
    )
    # pages that an earlier step decides aren't parsed
    read = src.withColumn("early", early).withColumn("a", html.article(F.when(F.col("early").isNull(), F.col("html")), "title", "markdown", "needs_fallback"))
    markdown = text.mask(F.col("a.markdown"))
    read = read.withColumn("markdown", F.when(F.col("early").isNull(), markdown))
    read = read.withColumn("source_sha256", F.when(F.col("early").isNull(), F.sha2(F.col("markdown").cast("binary"), 256)))
    status = F.coalesce("early", F.when(F.col("a.needs_fallback"), "extraction_failed").when(F.col("source_sha256") == F.col("old_sha"), "skipped_same_sha").otherwise("fetched_and_summarized_pending"))
    return read.select("url", "name", status.alias("status"), F.when(F.col("early").isNull(), F.col("a.title")).alias("title"), "markdown", "source_sha256")


def fetched_file(rows: DataFrame, now: Column) -> Column:
    """The Markdown file of a fetched page, its front matter quoted."""
    quoted = lambda c: text.json_quoted(F.col(c))
    fields = {"title": quoted("title"), "source_type": F.lit('"url"'), "source_url": quoted("url"), "source_sha256": quoted("source_sha256"), "fetched_at": text.json_quoted(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'"))}
    return fm.render(fields, F.concat(F.lit("\n"), "markdown", F.lit("\n")))


def html_cache(web: DataFrame) -> DataFrame:
    """Fetched pages (url, html) as they came, by the name of their Markdown: (path, html), to be read again later."""
    return web.where("html is not null").select(F.concat(F.lit(".cache/html/"), F.regexp_replace(urls.file_name(F.col("url")), r"\.md$", ".html")).alias("path"), "html")


def documents(files: DataFrame, page_texts: DataFrame | None = None, config: KBConfig | None = None) -> DataFrame:
    """files (path, content) by what reads them: (path, reader, name, title, text, status).

    Markdown is its own chunk, masked; EPUB and DOCX give their chapters; PDF and files without a suffix need page_texts
    (doc, page_no, text) and give page chunks. A file with another suffix has the status unsupported_extension.
    """
    dealt = files.withColumn("reader", archives.reader_of(F.col("path")))
    word = lambda c: c.cast("string")
    body = text.mask(F.make_valid_utf8(word(F.col("content"))))
    none = F.lit(None).cast("string")
    markdown = dealt.where("reader = 'md'").select("path", "reader", text.flat_name(F.col("path")).alias("name"), F.coalesce(F.nullif(text.first_heading(body), F.lit("")), text.base_name(F.col("path"))).alias("title"), body.alias("text"), F.lit("extracted").alias("status"))
    chapters = archives.chapters(dealt.where("reader in ('epub', 'docx')"), config)
    read = chapters.select("path", archives.reader_of(F.col("path")).alias("reader"), F.concat(text.flat_name(F.col("path")), F.lit("-"), F.col("chapter_index")).alias("name"), "title", text.mask(F.col("text")).alias("text"), "status")
    rest = dealt.where("reader is null").select("path", none.alias("reader"), none.alias("name"), none.alias("title"), none.alias("text"), F.lit("unsupported_extension").alias("status"))
    out = markdown.unionByName(read).unionByName(rest)
    if page_texts is not None:
        meta = dealt.where("reader = 'pdf'").select(F.col("path").alias("doc"), F.sha2("content", 256).alias("sha"), none.alias("title"), F.lit(False).alias("encrypted"))
        out = out.unionByName(page_chunks(page_texts, meta, config).select(F.col("doc").alias("path"), F.lit("pdf").alias("reader"), "name", "title", "text", F.lit("extracted").alias("status")))
    return out


#: Titles that say nothing.
JUNK_TITLE = r"^$|^Microsoft\sWord(?:\s-.*)?$|^Untitled$|^\.$|^Document[0-9]*$"


def document_title(title: Column, name: Column) -> Column:
    return F.when(title.isNull() | F.regexp_like(title, F.lit(JUNK_TITLE)), name).otherwise(F.left(title, F.lit(200)))


def page_chunks(page_texts: DataFrame, docs: DataFrame, config: KBConfig | None = None, sidecars: DataFrame | None = None) -> DataFrame:
    """Chunks of page texts (doc, page_no, text): name, page_range, text (masked), total_pages, truncated.

    docs (doc, sha, title, encrypted); a sidecar (doc, title) overrides the title. Encrypted documents and those
    over the hard limit have none; a document whose chunks are all empty has none either.
    """
    config = config or KBConfig()
    meta = docs.where(~F.coalesce("encrypted", F.lit(False)))
    if sidecars is not None:
        meta = meta.join(sidecars.select("doc", F.col("title").alias("given")), "doc", "left").withColumn("title", F.coalesce("given", "title")).drop("given")
    sizes = page_texts.groupBy("doc").agg(F.max("page_no").cast("int").alias("pages")).join(meta, "doc")
    plan = delta.chunk_plan(sizes, "doc", "pages", config.chunk_pages, config.chunk_overlap, config.soft_max_pages, config.hard_max_pages)
    # a page belongs to few chunks: its pages are dealt to them, so both sides meet by (doc, chunk)
    spread = plan.select("*", F.explode(F.sequence("page_first", "page_last")).alias("page_no"))
    joined = spread.join(page_texts, ["doc", "page_no"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    rows = joined.groupBy("doc", "chunk", "page_first", "page_last", "total_pages", "truncated").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"))
    rows = rows.withColumn("filled", F.max(F.regexp_like("text", F.lit(r"\S"))).over(Window.partitionBy("doc"))).where("filled").drop("filled")
    stem = F.regexp_replace(F.translate("doc", "/", "-"), r"(?i)\.pdf$", "")
    out = rows.join(meta.select("doc", F.col("sha").alias("source_sha256"), document_title(F.col("title"), text.base_name(F.col("doc"))).alias("title")), "doc")
    label = text.page_range(F.col("page_first"), F.col("page_last"))
    return out.select("doc", "chunk", F.concat(text.subdir(F.col("doc")), F.lit("--"), F.regexp_replace(stem, "^[^-]*-", ""), F.lit("-pp"), label, F.lit(".md")).alias("name"), label.alias("page_range"), "title", "source_sha256", "total_pages", "truncated", text.mask(F.col("text")).alias("text"))


def lint(vault: DataFrame) -> DataFrame:
    """Findings (path, kind, detail) of the deterministic checks; index, log and report pages aren't looked at."""
    kept = vault.where(~F.col("name").isin("index", "log", "lint-report"))
    edges = graph.edges(kept)
    odd = pages.invisible_lines(kept).select("path", F.lit("invisible_characters").alias("kind"), F.col("lines").alias("detail"))
    bare = pages.missing_fields(kept).select("path", F.lit("missing_front_matter").alias("kind"), F.array_join("missing", ",").alias("detail"))
    alone = kept.join(graph.orphans(kept, edges), "name").select("path", F.lit("orphan").alias("kind"), F.lit("").alias("detail"))
    wanted = graph.missing_pages(kept, edges, 3).select(F.col("to").alias("path"), F.lit("missing_page").alias("kind"), F.col("pages").cast("string").alias("detail"))
    unlinked = mentions.missing_links(kept).select("path", F.lit("missing_link").alias("kind"), F.col("target").alias("detail"))
    return odd.unionByName(bare).unionByName(alone).unionByName(wanted).unionByName(unlinked)


#: The sections of a report, in their order.
SECTIONS = {"invisible_characters": "Invisible characters", "missing_front_matter": "Missing front matter", "orphan": "Orphan pages", "missing_page": "Pages to write", "missing_link": "Missing links"}


def lint_report(findings: DataFrame, shown: int = 200) -> DataFrame:
    """A report's sections: place, kind, n, and text, which lists the first `shown` (at most 1000) findings by path."""
    findings = shared.stored(findings, "findings")
    order = Window.partitionBy("kind").orderBy("path", "detail")
    first = findings.withColumn("at", F.row_number().over(order)).where(F.col("at") <= shown)
    line = F.concat(F.lit("- "), "path", F.when(F.col("detail") != "", F.concat(F.lit(": "), "detail")).otherwise(""))
    lines = first.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    counted = findings.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(lines, "kind")
    heads = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("kind"))
    more = F.when(F.col("n") > shown, F.concat(F.lit("\n- and "), F.col("n") - shown, F.lit(" more"))).otherwise("")
    text = F.concat(F.lit("## "), heads[F.col("kind")], F.lit(" ("), "n", F.lit(")\n\n"), "lines", more, F.lit("\n"))
    return counted.select(place.alias("place"), "kind", "n", text.alias("text"))


def commit_report(commits: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Commits of the last days by ISO week and author."""
    recent = commits.where(F.col("ts") > now - F.make_dt_interval(F.lit(days)))
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), "ts").cast("int"), F.extract(F.lit("WEEK"), "ts").cast("int"))
    return recent.groupBy(week.alias("week"), "author").agg(F.count(F.lit(1)).alias("commits"), F.sum(F.size("files")).alias("files"))


#: The templates of new pages.
TEMPLATES = {"concept": "## Summary\n\n## Details\n", "decision": "## Context\n\n## Decision\n\n## Consequences\n", "project": "## Goal\n\n## Status\n"}


def from_template(name: str, body: Column) -> Column:
    """A template with the body put in after its first heading."""
    head, _, rest = TEMPLATES[name].partition("\n")
    return F.concat(F.lit(head + "\n\n"), text.strip(body), F.lit("\n" + rest))
