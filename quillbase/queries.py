"""Registered queries of the knowledge-base operators, each over whole tables, with the SQL that says the same.

The tables stand in for a vault: documents are pages (wiki/<source>/<doc_id>.md), pages are fetched HTML, labels are page
properties, conversations are sessions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import front_matter, html, text, urls
from .operators import delta, graph, pages, search, store
from .plans import ingest, views
from .shared import shared_dir
from .streaming import sessions

NOW = "2024-12-31 00:00:00"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages: path, name, body, size, mtime and the columns of documents."""
    d = read(spark, sf_dir, "documents")
    return d.select("*", F.concat_ws("/", F.lit("wiki"), "source", F.concat("doc_id", F.lit(".md"))).alias("path"), F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"), F.octet_length("text").cast("long").alias("size"))


_VAULT = "v AS (SELECT *, 'wiki/' || source || '/' || doc_id || '.md' AS path, CAST(doc_id AS VARCHAR) AS name, text AS body, CAST(strlen(text) AS BIGINT) AS size FROM documents)"


def re2(pattern: str) -> str:
    """A pattern of ours as DuckDB writes it."""
    import re

    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern).replace("'", "''")


def _masked(column: str) -> str:
    sql = f"nfc_normalize(regexp_replace({column}, '{re2(text.INVISIBLE)}', '', 'g'))"
    for pattern, put in text.MASKS:
        sql = f"regexp_replace({sql}, '{re2(pattern)}', '{put.replace('$1', chr(92) + '1')}', 'g')"
    return sql


_WS = re2(text.SPACES)


def _strip(sql: str) -> str:
    return f"regexp_replace({sql}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


@query(f"SELECT doc_id, sha256(m) AS masked_sha256, m <> text AS changed FROM (SELECT doc_id, text, {_masked('text')} AS m FROM documents)")
def x01_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", text.mask(F.col("text")).alias("m"))
    return d.select("doc_id", F.sha2(F.col("m").cast("binary"), 256).alias("masked_sha256"), (F.col("m") != F.col("text")).alias("changed"))


@query(f"""WITH {_VAULT}, h AS (SELECT path, body AS t FROM v), s AS (SELECT path, t, CAST(contains(lower(t), 'idiot') AS INT) + CAST(contains(lower(t), 'token') AS INT) + CAST(contains(lower(t), 'the') AS INT) AS score FROM h)
SELECT path, {_strip("coalesce(regexp_extract(t, '(?m)^#[" + _WS + "]+(.+)$', 1), '')")} AS title, score, {_strip("regexp_replace(substring(t, greatest(1, instr(lower(t), 'idiot') - 60), 200), '[" + _WS + "]+', ' ', 'g')")} AS snippet
FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 10""")
def q01_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lexical(vault(spark, sf_dir), "idiot token the")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = vault(spark, sf_dir).withColumn("body", text.mask(F.col("body")))
    return search.lexical(masked, "token the")


@query(r"""WITH b AS (SELECT doc_id, string_split(replace(text, '%%%', chr(8203)), chr(10)) AS l FROM documents),
n AS (SELECT doc_id, list_filter(range(1, len(l) + 1), lambda i: contains(l[i], chr(8203)) OR regexp_matches(l[i], '[\x{00ad}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]')) AS n FROM b)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, array_to_string(n, ',') AS lines, CAST(len(n) AS INT) AS n_lines FROM n WHERE len(n) > 0""")
def a07_invisible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", "%%%", "\u200b"))
    return pages.invisible_lines(d, "doc_id", "text")


_LINKED = "p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS name, regexp_replace(html, '<a href=\"/([^\"]*)\">', '[[\\1]]', 'g') AS body FROM pages), l AS (SELECT page_id, name, list_filter(list_transform(regexp_extract_all(body, '\\[\\[([^\\]\\n]+)\\]\\]', 1), lambda x: " + _strip("regexp_extract(x, '^([^|#]*)', 1)") + "), lambda x: x <> '') AS links FROM p)"


def _linked_sql() -> str:
    return _LINKED


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with their root-relative anchors as wikilinks: path, name, title, type, tags, body."""
    body = F.regexp_replace("html", '<a href="/([^"]*)">', "[[$1]]")
    return read(spark, sf_dir, "pages").select(F.concat(F.lit("wiki/"), "page_id", F.lit(".md")).alias("path"), F.col("page_id").cast("string").alias("name"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.lit("page").alias("type"), F.array(F.split("url", "/")[3]).alias("tags"), body.alias("body"), "page_id")


@query(f"WITH {_LINKED} SELECT DISTINCT name AS \"from\", unnest(links) AS \"to\" FROM l")
def a06_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(linked(spark, sf_dir))


@query(f"WITH {_LINKED} SELECT name, CAST(len(links) AS INT) AS n_links, array_to_string(list_sort(list_distinct(links)), '|') AS targets FROM l")
def x10_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = linked(spark, sf_dir)
    return p.select("name", F.size(text.link_targets(F.col("body"))).alias("n_links"), F.array_join(F.array_sort(text.wikilinks(F.col("body"))), "|").alias("targets"))


@query(f"WITH {_LINKED}, e AS (SELECT DISTINCT name AS f, unnest(links) AS t FROM l) SELECT DISTINCT name FROM p WHERE name NOT IN (SELECT t FROM e WHERE f <> t)")
def j13_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = linked(spark, sf_dir)
    return graph.orphans(p, graph.edges(p))


@query(f"WITH {_LINKED}, e AS (SELECT DISTINCT name AS f, unnest(links) AS t FROM l), k AS (SELECT name AS t FROM p UNION SELECT regexp_extract(html, '<title>([^<]*)', 1) FROM pages) SELECT t AS \"to\", count(*) AS pages FROM e WHERE t NOT IN (SELECT t FROM k WHERE t <> '') GROUP BY t HAVING count(*) >= 2")
def j13_missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = linked(spark, sf_dir)
    return graph.missing_pages(p, graph.edges(p), 2)


@query(f"WITH {_LINKED}, o AS (SELECT page_id, unnest(links) AS t FROM l) SELECT 'wiki/' || page_id || '.md' AS path, count(*) AS occurrences FROM o WHERE t IN (SELECT n_name FROM nation UNION ALL SELECT 'the' UNION ALL SELECT 'and' UNION ALL SELECT 'En') GROUP BY page_id")
def j06_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    going = read(spark, sf_dir, "nation").select(F.col("n_name").alias("target")).unionByName(spark.createDataFrame([("the",), ("and",), ("En",)], "target string"))
    return graph.broken_links(linked(spark, sf_dir), going)


_DIFF = """b AS (SELECT CAST(doc_id AS VARCHAR) AS name, lang, source, NULL AS q FROM documents), a AS (SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN toxic = 1 THEN 'toxic' ELSE lang END AS lang, source FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'item-' || item_id, 'item', '' FROM benchmark)"""


@query(f"WITH {_DIFF} SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL OUTER JOIN a ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.lang <> b.lang")
def j07_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vault(spark, sf_dir).withColumn("title", F.col("source")).withColumn("tags", F.array("source"))
    lab = read(spark, sf_dir, "labels")
    shape = lambda x: x.select("name", "path", "type", "tags", "title", "body")
    before = shape(d.withColumn("type", F.col("lang")))
    after = shape(d.join(lab, "doc_id").withColumn("type", F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("lang"))))
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), "item_id").alias("name"), F.lit("wiki/item.md").alias("path"), F.lit("item").alias("type"), F.array(F.lit("")).alias("tags"), F.lit("").alias("title"), F.col("text").alias("body"))
    return graph.diff(graph.snapshot(before), graph.snapshot(after.unionByName(items)))


@query("""WITH s AS (SELECT source || '-' || doc_id || '.md' AS name, sha256(text) AS sha, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'raw' AS kind, name, CASE WHEN quality IS NULL THEN 'missing' ELSE 'stale' END AS reason FROM s WHERE quality IS NULL OR quality = 0""")
def j01_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    name = F.concat("source", F.lit("-"), text.flat_name(F.concat_ws("/", "source", F.concat("doc_id", F.lit(".md")))))
    sources = d.select(F.lit("raw").alias("kind"), name.alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.lit(None).cast("timestamp").alias("mtime"), "doc_id")
    # a labelled document has a summary; one of low quality was made from another text
    summaries = sources.join(lab, "doc_id").select("name", F.when(F.col("quality") == 1, F.col("sha")).otherwise(F.sha2(F.col("sha").cast("binary"), 256)).alias("sha"), "mtime")
    return delta.work_list(sources.drop("doc_id"), summaries)


@query("""WITH d AS (SELECT doc_id, CAST((n_chars + 39) // 40 AS BIGINT) AS total_pages FROM documents), e AS (SELECT *, least(total_pages, 500) AS e FROM d WHERE total_pages BETWEEN 1 AND 1000), n AS (SELECT *, (e + 14) // 15 AS n FROM e),
c AS (SELECT *, CASE WHEN n >= 2 AND e - (n - 1) * 15 <= 5 THEN n - 1 ELSE n END AS c FROM n), i AS (SELECT *, unnest(range(0, c)) AS i FROM c)
SELECT doc_id, CAST(i AS INT) AS chunk, CAST(CASE WHEN i = 0 THEN 1 ELSE greatest(1, 1 + i * 15 - 1) END AS INT) AS page_first, CAST(CASE WHEN i = c - 1 THEN e ELSE (i + 1) * 15 END AS INT) AS page_last, total_pages, total_pages > 500 AS truncated FROM i""")
def w01_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.expr("(n_chars + 39) div 40").alias("pages"))
    return delta.chunk_plan(d, "doc_id")


_LIST = f"""WITH {_VAULT}, f AS (SELECT path, 'file' AS type, size, TIMESTAMP '2024-01-01' AS mtime FROM v UNION ALL SELECT DISTINCT 'wiki/' || source, 'dir', NULL, NULL FROM v)
SELECT path, type, size, mtime, (SELECT count(*) FROM f) > 1000 AS truncated FROM f ORDER BY path, type LIMIT 1000"""


@query(_LIST)
def s01_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.listing(vault(spark, sf_dir).withColumn("mtime", F.lit("2024-01-01").cast("timestamp")), "wiki", 3)


# ---- dashboard

_FOLDERS = {"en": "projects", "fr": "concepts", "de": "decisions", "es": "bugs"}
_BOARD = """w AS (SELECT 'wiki/' || CASE WHEN source = 'src7' THEN 'summaries' WHEN source = 'src3' THEN 'patterns' WHEN source = 'src5' THEN 'analyses' WHEN lang = 'en' THEN 'projects' WHEN lang = 'fr' THEN 'concepts' WHEN lang = 'de' THEN 'decisions' ELSE 'bugs' END || '/' || CASE WHEN doc_id = 1 THEN 'hot' ELSE CAST(doc_id AS VARCHAR) END || '.md' AS path,
  CASE WHEN doc_id = 1 THEN 'hot' ELSE CAST(doc_id AS VARCHAR) END AS name, CASE WHEN quality = 1 THEN 'active' WHEN quality = 0 THEN 'done' END AS status, lang AS type, source AS tech_stack, CAST(n_chars % 90 AS BIGINT) AS age_days, CAST(n_chars % 90 AS VARCHAR) AS updated FROM documents LEFT JOIN labels USING (doc_id))"""


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as wiki pages with properties; the newest ones were written NOW."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    folder = F.when(F.col("source") == "src7", "summaries").when(F.col("source") == "src3", "patterns").when(F.col("source") == "src5", "analyses")
    for lang, name in _FOLDERS.items():
        folder = folder.when(F.col("lang") == lang, name) if name != "bugs" else folder
    name = F.when(F.col("doc_id") == 1, "hot").otherwise(F.col("doc_id").cast("string"))
    mtime = F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) - (F.col("n_chars") % 90) * 86400)
    return d.select(
        F.concat_ws("/", F.lit("wiki"), folder.otherwise("bugs"), F.concat(name, F.lit(".md"))).alias("path"), mtime.alias("mtime"), F.when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "done").alias("status"),
        F.col("lang").alias("type"), F.col("source").alias("tech_stack"), (F.col("n_chars") % 90).cast("string").alias("updated"),
    )


_WHERE = {
    "hot_cache": "name = 'hot'",
    "active_projects": "path LIKE 'wiki/projects/%' AND status = 'active'",
    "recent_activity": "true",
    "concepts": "path LIKE 'wiki/concepts/%'",
    "decisions": "path LIKE 'wiki/decisions/%'",
    "analyses": "path LIKE 'wiki/analyses/%'",
    "patterns": "path LIKE 'wiki/patterns/%'",
    "bugs": "path LIKE 'wiki/bugs/%'",
    "stale": "age_days > 30",
}
for _view in views.DASHBOARD:
    _order = ("age_days, " if "age_days" in _view.columns else "") + "name, path"
    _limit = f" LIMIT {_view.limit}" if _view.limit else ""

    def _run(spark: SparkSession, sf_dir: str, view=_view) -> DataFrame:
        return views.evaluate(board(spark, sf_dir), view, F.lit(NOW).cast("timestamp"))

    QUERIES[f"view_{_view.name}"] = _run
    ORACLE_SQL[f"view_{_view.name}"] = f"WITH {_BOARD} SELECT {', '.join(_view.columns)} FROM (SELECT * FROM w WHERE path NOT LIKE 'wiki/summaries/%' AND {_WHERE[_view.name]} ORDER BY {_order}{_limit})"


# ---- URLs

_URLS = """u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'http://127.0.0.' || (page_id % 250) || '/x' FROM pages UNION ALL SELECT page_id, 'http://172.' || (page_id % 40) || '.1.1/' FROM pages UNION ALL SELECT page_id, 'ftp://example.com/' || page_id FROM pages UNION ALL SELECT page_id, 'https://me:pw@example.com/' || page_id FROM pages UNION ALL SELECT page_id, 'http://' || (page_id + 2130706433) || '/' FROM pages UNION ALL SELECT page_id, 'http://[::ffff:7f00:' || (page_id % 9 + 1) || ']/' FROM pages)"""


def _url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = read(spark, sf_dir, "pages"), F.col("page_id")
    forms = [F.col("url"), F.concat(F.lit("http://127.0.0."), i % 250, F.lit("/x")), F.concat(F.lit("http://172."), i % 40, F.lit(".1.1/")), F.concat(F.lit("ftp://example.com/"), i), F.concat(F.lit("https://me:pw@example.com/"), i), F.concat(F.lit("http://"), i + 2130706433, F.lit("/")), F.concat(F.lit("http://[::ffff:7f00:"), i % 9 + 1, F.lit("]/"))]
    return p.select("page_id", F.explode(F.array(*forms)).alias("url"))


@query(f"""WITH {_URLS} SELECT page_id, url, CASE WHEN url LIKE 'ftp:%' THEN 'url_scheme' WHEN url LIKE '%@%' THEN 'url_credentials' WHEN regexp_matches(url, '^http://[0-9]+/') THEN 'url_non_standard_ip' WHEN url LIKE 'http://127.%' OR url LIKE '%::ffff:7f%' THEN 'url_loopback' WHEN regexp_matches(url, '^http://172\\.(1[6-9]|2[0-9]|3[01])\\.') THEN 'url_private_ip' END AS code FROM u""")
def f03_url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url_forms(spark, sf_dir).withColumn("code", urls.safety_code(F.col("url")))


@query(r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1) AS q FROM pages),
s AS (SELECT *, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(url_decode(path), '^/', ''), '(?i)\.html?$', ''), '[^\p{L}\p{N}_./-]+', '-', 'g'), '/', '-'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM p),
w AS (SELECT *, host || '-' || CASE WHEN slug = '' THEN 'root' ELSE slug END AS whole FROM s)
SELECT page_id, left(whole, 80) || CASE WHEN length(whole) > 80 OR (length(q) > 1 AND regexp_replace(regexp_replace(path, '^/', ''), '(?i)\.html?$', '') = '') THEN '-' || left(sha256(url), 8) ELSE '' END || '.md' AS name FROM w""")
def x12_url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", urls.file_name(F.col("url")).alias("name"))


ROBOTS = {
    "example.com": "User-agent: *\nDisallow: /en/\nAllow: /en/7 # open\n",
    "example.net": "User-agent: kb\nUser-agent: other\nDisallow: /*/8\n\nUser-agent: *\nDisallow: /\n",
    "example.org": "User-agent: *\nDisallow: /*.html$\nDisallow:\n",
}


@query(r"""WITH p AS (SELECT page_id, regexp_extract(lower(url), '(example\.(?:com|net|org))', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE host WHEN 'example.com' THEN NOT starts_with(path, '/en/') OR starts_with(path, '/en/7') WHEN 'example.net' THEN NOT regexp_matches(path, '^/.*/8') WHEN 'example.org' THEN NOT regexp_matches(path, '\.html$') ELSE true END AS allowed FROM p""")
def f04_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(F.lower("url"), r"(example\.(?:com|net|org))", 1).alias("host"), urls.parts(F.col("url"))["path"].alias("path"), F.lit("kb").alias("ua"))
    rules = urls.robots_rules(spark.createDataFrame(list(ROBOTS.items()), "host string, txt string"))
    return urls.robots_allowed(p, rules).select("page_id", "host", "path", "allowed")


# ---- sessions

_TITLE = "regexp_replace(regexp_replace(regexp_replace(m, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '[/\\\\]', '-', 'g'), '[<>:\"|?*]', '-', 'g')"
_SESSIONS = f"""c AS (SELECT conv_id, turn, role, text, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INT)) + to_minutes(CAST(turn AS INT)) AS ts, role = 'user' AND {_strip('text')} <> '' AS start FROM conversations),
f AS (SELECT conv_id, min(turn) AS first FROM c WHERE start GROUP BY conv_id),
k AS (SELECT c.*, f.first FROM c JOIN f USING (conv_id) WHERE turn >= first),
g AS (SELECT conv_id, arg_min({_masked('text')}, turn) AS m, min(ts) AS started, count(*) FILTER (start) AS prompts, count(*) FILTER (role = 'assistant' AND {_strip('text')} <> '') AS turns FROM k GROUP BY conv_id),
t AS (SELECT *, regexp_replace({_strip("regexp_replace(nfc_normalize(" + _TITLE + "), '[" + _WS + "]+', ' ', 'g')")}, ' ', '-', 'g') AS t0 FROM g),
t1 AS (SELECT *, regexp_replace(t0, '^[-.]+|[-.]+$', '', 'g') AS t1 FROM t),
t2 AS (SELECT *, CASE WHEN length(t1) > 50 THEN regexp_replace(left(t1, 50), '^[-.]+|[-.]+$', '', 'g') ELSE t1 END AS t2 FROM t1)
SELECT CAST(conv_id AS VARCHAR) AS session_id, strftime(started, '%Y%m%d-%H%M%S') || '-' || left(CAST(conv_id AS VARCHAR), 4) || '-' || CASE WHEN t2 = '' THEN 'untitled' ELSE t2 END || '.md' AS file, CAST(prompts AS BIGINT) AS prompts, CAST(turns AS BIGINT) AS turns FROM t2"""


def conversation_events(c: DataFrame) -> DataFrame:
    """Turns as hook events: a user's are prompts, the assistant's are stops."""
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    none = F.lit(None).cast("string")
    name = F.when(F.col("role") == "user", "UserPromptSubmit").when(F.col("role") == "assistant", "Stop").otherwise("Other")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("seq"), ts.alias("ts"), name.alias("hook_event_name"), F.when(F.col("role") == "user", F.col("text")).alias("prompt"), F.col("text"), none.alias("tool_name"), none.alias("command"), none.alias("file_path"))


@query(f"WITH {_SESSIONS}")
def a01_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.rollup(conversation_events(read(spark, sf_dir, "conversations"))).select("session_id", "file", "prompts", "turns")


@query(f"WITH {_SESSIONS}")
def t02_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the stateful stream, over all there is; each batch's rows are written, the last of a session counts."""
    static = read(spark, sf_dir, "conversations")
    source = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/conversations.parque[t]")  # a pattern, so it may be a file
    out = f"{shared_dir(spark)}/session-stream-{uuid.uuid4().hex}"
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
    q = sessions.stream(conversation_events(source)).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.groupBy("session_id").agg(F.max_by(F.struct("file", "prompts", "turns"), "batch").alias("r"))
    return last.select("session_id", "r.file", "r.prompts", "r.turns")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def w10_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.activity(read(spark, sf_dir, "events"))


@query("SELECT CAST(isoyear(ts) AS INT) AS year, CAST(week(ts) AS INT) AS week, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def w10_iso_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.extract(F.lit("YEAROFWEEK"), "ts").cast("int").alias("year"), F.extract(F.lit("WEEK"), "ts").cast("int").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


# ---- ranking

_BM = f"""WITH {_VAULT}, w AS (SELECT path, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM v), t AS (SELECT path, len(w) AS n, len(list_filter(w, lambda x: x = 'clown')) AS t0, len(list_filter(w, lambda x: x = 'idiot')) AS t1, len(list_filter(w, lambda x: x = 'pathetic')) AS t2 FROM w),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM t),
r AS (SELECT path, round({" + ".join(f"ln((docs - d{i} + 0.5) / (d{i} + 0.5) + 1) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(3))}, 6) AS score FROM t, s)
"""


@query(_BM + "SELECT path, score FROM r WHERE score > 0 ORDER BY score DESC, path LIMIT 10")
def q02_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(vault(spark, sf_dir), "idiot clown pathetic")


@query("SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(range(1, len(embedding) + 1), lambda i: CAST(1.0 / i AS DOUBLE))), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def q03_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    size = e.select(F.max(F.size("embedding"))).first()[0] or 0
    return search.nearest(e, [1.0 / i for i in range(1, size + 1)])


@query(_BM + """, a AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS n FROM (SELECT * FROM r WHERE score > 0 ORDER BY score DESC, path LIMIT 50)),
x AS (SELECT path, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(range(1, len(embedding) + 1), lambda i: CAST(1.0 / i AS DOUBLE))), 6) AS score FROM embeddings JOIN v ON doc_id = vec_id),
b AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS n FROM (SELECT * FROM x ORDER BY score DESC, path LIMIT 50))
SELECT path, round(sum(1.0 / (60 + n)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY path ORDER BY score DESC, path LIMIT 10""")
def q04_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 fused with vectors; a vector belongs to the document of its number."""
    v, e = vault(spark, sf_dir), read(spark, sf_dir, "embeddings")
    size = e.select(F.max(F.size("embedding"))).first()[0] or 0
    vectors = e.join(v.select("path", "doc_id"), F.col("vec_id") == F.col("doc_id"))
    near = search.nearest(vectors, [1.0 / i for i in range(1, size + 1)], 50, "path")
    return search.fuse([search.bm25(v, "idiot clown pathetic", 50), near])


@query(f"WITH {_VAULT}, t AS (SELECT doc_id, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+')) AS term FROM v) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS n FROM t GROUP BY term")
def k15_term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_statistics(vault(spark, sf_dir), "doc_id")


# ---- HTML

@query("SELECT page_id, CAST(len(a) AS INT) AS n_anchors, CAST(len(list_distinct(a)) AS INT) AS n_distinct FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS a FROM pages)")
def x21_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = html.anchors(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.size(a).alias("n_anchors"), F.size(F.array_distinct(a)).alias("n_distinct"))


@query()
def x19_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages as masked Markdown with the hash that tells whether they changed."""
    a = read(spark, sf_dir, "pages").select("page_id", "url", html.article(F.col("html")).alias("a"))
    rows = a.select("page_id", urls.file_name(F.col("url")).alias("name"), "a.title", "a.needs_fallback", F.size("a.images").alias("n_images"), text.mask(F.col("a.markdown")).alias("markdown"))
    return rows.select("*", F.sha2(F.col("markdown").cast("binary"), 256).alias("source_sha256"))


# ---- writes

@query(f"""WITH d AS (SELECT doc_id, text, source, toxic, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'wiki/' || source || '/' || doc_id || '.md' AS path, CASE WHEN toxic IS NULL THEN 'kept' WHEN toxic = 1 THEN 'file_exists' WHEN quality = 1 THEN 'appended' ELSE 'merged' END AS outcome,
sha256(CASE WHEN toxic IS NULL OR toxic = 1 THEN text WHEN quality = 1 THEN regexp_replace(text, '[{_WS}]+$', '') || chr(10) || chr(10) || '## 2024-12-31' || chr(10) || chr(10) || 'seen' || chr(10) ELSE 'seen' END) AS body_sha256 FROM d
UNION ALL SELECT 'wiki/items/' || item_id || '.md', 'created', sha256('seen') FROM benchmark""")
def k04_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, lab = vault(spark, sf_dir), read(spark, sf_dir, "labels")
    fm = F.create_map(F.lit("title"), F.lit("x"))
    mode = F.when(F.col("toxic") == 1, "create").when(F.col("quality") == 1, "append").otherwise("merge")
    changes = v.join(lab, "doc_id").select("path", mode.alias("mode"), fm.alias("fm"), F.lit("seen").alias("body"))
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("wiki/items/"), "item_id", F.lit(".md")).alias("path"), F.lit("merge").alias("mode"), fm.alias("fm"), F.lit("seen").alias("body"))
    done = store.upsert(v.select("path", fm.alias("fm"), "body"), changes.unionByName(items), "2024-12-31")
    return done.select("path", "outcome", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


@query(f"WITH {_VAULT} SELECT CASE WHEN toxic = 1 THEN 'wiki/.archive/' || source || '/' || doc_id || '-2024-12-31T00-00-00-000Z.md' ELSE path END AS path, CASE WHEN toxic = 1 THEN 'archived' ELSE 'kept' END AS outcome FROM v LEFT JOIN labels USING (doc_id)")
def k06_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vault(spark, sf_dir)
    going = v.join(read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("path")
    return store.archive(v.select("path", "body"), going, F.lit(NOW).cast("timestamp")).select("path", "outcome")


@query("SELECT role AS title, count(*) AS notes, count(*) AS names FROM conversations GROUP BY role")
def k03_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a note named by its role: each gets a name of its own."""
    c = read(spark, sf_dir, "conversations").select(F.col("role").alias("title"), F.concat_ws(" ", "conv_id", "turn", "text").alias("body"), F.array("role").alias("tags"))
    made = store.notes(c, F.lit(NOW).cast("timestamp"))
    return made.groupBy(F.regexp_extract("name", r"-mcp-([a-z]+)", 1).alias("title")).agg(F.count(F.lit(1)).alias("notes"), F.count_distinct("name").alias("names"))


# ---- ingestion

@query(r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'skipped_within_refresh' WHEN page_id % 4 = 1 THEN 'skipped_never' WHEN page_id % 4 = 2 THEN 'dispatched_to_pdf' ELSE 'unsupported_content_type' END AS status FROM u""")
def f06_fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page under one of four conditions that are decided before it is read."""
    p, k = read(spark, sf_dir, "pages"), F.col("page_id") % 4
    kind = F.when(k == 2, "application/pdf").when(k == 3, "image/png").otherwise("text/html")
    web = p.select("page_id", F.concat(F.lit("https://example.com/p/"), "page_id").alias("url"), "html", kind.alias("content_type"), F.lit(False).alias("truncated"))
    stored = web.select(urls.file_name(F.col("url")).alias("name"), F.lit("x").alias("source_sha256"), F.when(F.col("page_id") % 4 == 1, "never").alias("refresh_days"), F.lit("2024-12-30T00:00:00Z").alias("fetched_at"))
    done = ingest.fetched(web, stored, F.lit(NOW).cast("timestamp"))
    return done.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_id"), "status")


@query()
def x20_ingest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page read, masked and hashed, with nothing in store yet."""
    # a file can be one row group, thus one task, however many pages it has; parsing is what costs, so pages are dealt out evenly
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    web = read(spark, sf_dir, "pages").repartition(tasks, "page_id").select("url", "html", F.lit("text/html").alias("content_type"), F.lit(False).alias("truncated"))
    # a relation that Spark knows to be empty: the size of an RDD's isn't known, and a join with it shuffles and sorts all pages
    none = spark.sql("SELECT '' AS name, '' AS source_sha256, '' AS refresh_days, '' AS fetched_at WHERE false")
    return ingest.fetched(web, none, F.lit(NOW).cast("timestamp"))


@query("""WITH p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS page_no, unnest(l) AS text, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), f AS (SELECT doc_id, n FROM p WHERE n <= 1000 GROUP BY doc_id, n HAVING bool_or(regexp_matches(text, '\\S'))),
e AS (SELECT doc_id, n, least(n, 500) AS e FROM f), b AS (SELECT *, (e + 14) // 15 AS b FROM e), c AS (SELECT *, CASE WHEN b >= 2 AND e - (b - 1) * 15 <= 5 THEN b - 1 ELSE b END AS c FROM b), i AS (SELECT *, unnest(range(0, c)) AS i FROM c),
r AS (SELECT doc_id, n, i, CASE WHEN i = 0 THEN 1 ELSE i * 15 END AS page_first, CASE WHEN i = c - 1 THEN e ELSE (i + 1) * 15 END AS page_last FROM i)
SELECT r.doc_id, 'pdf--' || r.doc_id || '-pp' || lpad(CAST(page_first AS VARCHAR), 3, '0') || '-' || lpad(CAST(page_last AS VARCHAR), 3, '0') || '.md' AS name, CAST(r.n AS INT) AS total_pages, sha256(MASKED) AS text_sha256
FROM r JOIN p ON p.doc_id = r.doc_id AND page_no BETWEEN page_first AND page_last GROUP BY r.doc_id, r.n, page_first, page_last""".replace("MASKED", _masked("string_agg(text, chr(10) || chr(10) ORDER BY page_no)")))
def s14_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDFs whose pages are their lines."""
    d = read(spark, sf_dir, "documents").withColumn("doc", F.concat(F.lit("pdf/"), "doc_id", F.lit(".pdf")))
    texts = d.select("doc", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("doc", (F.col("at") + 1).alias("page_no"), "text")
    meta = d.select("doc", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.lit("Untitled").alias("title"), F.lit(False).alias("encrypted"))
    made = ingest.page_chunks(texts, meta)
    return made.select(F.regexp_extract("doc", r"(\d+)\.pdf$", 1).cast("long").alias("doc_id"), "name", "total_pages", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


# ---- state of chunks, names, contexts

@query("""SELECT source AS doc, count(*) AS chunks, CAST(count_if(quality IS NULL OR quality = 0) AS BIGINT) AS due, max(n_chars) AS total_pages, bool_or(n_chars > 5000) AS truncated, bool_and(regexp_replace(text, '\\s+', '', 'g') = '') AS all_empty
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def a04_chunk_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the chunks of their source; a label says whether a summary is there and of this content."""
    d = read(spark, sf_dir, "documents").withColumn("name", F.col("doc_id").cast("string")).withColumn("sha", F.sha2("text", 256))
    chunks = d.select(F.col("source").alias("doc"), "name", "sha", "text", F.col("n_chars").alias("total_pages"), (F.col("n_chars") > 5000).alias("truncated"))
    summaries = d.join(read(spark, sf_dir, "labels"), "doc_id").select("name", F.when(F.col("quality") == 1, F.col("sha")).otherwise("old").alias("sha"))
    return delta.chunk_state(chunks, summaries)


@query(f"""WITH {_LINKED}, b AS (SELECT DISTINCT name AS f, unnest(links) AS t FROM l), a AS (SELECT DISTINCT f, lower(t) AS t FROM b)
SELECT f AS "from", t AS "to", 'added' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT f, t, 'removed' FROM (FROM b EXCEPT FROM a)""")
def j08_edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links before and after every page was put in lower case."""
    p = linked(spark, sf_dir)
    return graph.edge_diff(graph.edges(p), graph.edges(p.withColumn("body", F.lower("body"))))


@query(f"""WITH {_LINKED}, k AS (SELECT 'wiki/' || page_id || '.md' AS path, 1 AS rank, regexp_extract(html, '<title>([^<]*)', 1) AS key FROM pages UNION ALL SELECT 'wiki/' || page_id || '.md', 0, name FROM p)
SELECT key, path FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank DESC, path DESC) AS n FROM k WHERE key <> '') WHERE n = 1""")
def j05_title_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.title_index(linked(spark, sf_dir))


@query("""SELECT doc_id, concat_ws('-', lang, source) || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS name
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)""")
def w05_numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that all want the name of their language and source."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "lang", "source").alias("base"))
    return delta.numbered(d, "base", "doc_id").select("doc_id", "name")


@query("""SELECT host, sha256(html) AS sha256, concat('media/', host, '/', sha256(html), '.html') AS path, CAST(min(strlen(html)) AS BIGINT) AS size
FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, html FROM pages) GROUP BY host, html""")
def k09_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of their host, each content stored once."""
    p = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1).alias("host"), F.col("html").cast("binary").alias("content"), F.lit("html").alias("ext"))
    return store.images(p).select("host", "sha256", "path", F.octet_length("content").cast("long").alias("size"))


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-04-20 00:00:00' - INTERVAL 90 DAY")
def k16_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cached files with their times."""
    return store.expired(read(spark, sf_dir, "events").withColumn("mtime", F.col("ts")), F.lit("2024-04-20 00:00:00").cast("timestamp")).select("event_id")


@query("SELECT regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path, '' AS title, CAST(page_id AS DOUBLE) AS score, coalesce(html, '') AS snippet FROM pages")
def q05_normal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "pages").select(F.col("url").alias("file"), F.lit(None).cast("string").alias("title"), F.col("page_id").cast("string").alias("score"), F.col("html").alias("snippet"))
    return search.normal_hits(hits)


@query(f"WITH {_VAULT} SELECT doc_id, name, regexp_extract(path, '([^/]+)/[^/]*$', 1) AS parent, string_split(path, '/')[1] AS subdir, replace(regexp_replace(path, '^[^/]*/', ''), '/', '-') AS flat FROM v")
def x14_path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return vault(spark, sf_dir).select("doc_id", text.base_name(path).alias("name"), text.parent(path).alias("parent"), text.subdir(path).alias("subdir"), text.flat_name(path).alias("flat"))


_TITLE = _strip(rf"""regexp_replace(nfc_normalize(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '[/\\]', '-', 'g'), '[<>:"|?*]', '-', 'g')), '[{_WS}]+', ' ', 'g')""")


@query(f"""WITH t AS (SELECT conv_id, turn, regexp_replace(replace({_TITLE}, ' ', '-'), '^[-.]+|[-.]+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, '20241231-000000-' || left(CAST(conv_id AS VARCHAR), 4) || '-' || coalesce(nullif(CASE WHEN length(t) > 50 THEN regexp_replace(left(t, 50), '^[-.]+|[-.]+$', '', 'g') ELSE t END, ''), 'untitled') || '.md' AS file FROM t""")
def x05_session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that each turn would name, were it a session's first prompt."""
    name = text.session_file(F.lit(NOW).cast("timestamp"), F.col("conv_id").cast("string"), text.session_title(F.col("text")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("file"))


@query(r"""SELECT doc_id, sha256(translate(text, '`' || chr(10) || chr(13) || chr(92) || '$', '?????')) AS prompt_sha256, sha256('> ' || replace(text, chr(10), chr(10) || '> ')) AS callout_sha256,
CASE WHEN length(c) > 100 THEN left(c, 100) || '…' ELSE c END AS error, sha256(CASE WHEN length(text) > 2000 THEN left(text, 2000) || ' ... (truncated)' ELSE text END) AS cut_sha256
FROM (SELECT doc_id, text, regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g') AS c FROM documents)""")
def x25_safe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", sha(text.safe_for_prompt(t)).alias("prompt_sha256"), sha(text.quote_callout(t)).alias("callout_sha256"), text.safe_for_error(t).alias("error"), sha(text.cut(t, 2000)).alias("cut_sha256"))


@query(f"""SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), nullif(hot, ''), nullif(source, ''))) AS context_sha256
FROM (SELECT doc_id, source, {_masked("CASE WHEN length(text) > 4000 THEN left(text, 4000) || ' ... (truncated)' ELSE text END")} AS hot FROM documents)""")
def x30_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the hot cache beside an index that is its source."""
    made = text.context(F.col("text"), F.col("source"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(made.cast("binary"), 256).alias("context_sha256"))


@query(f"""SELECT conv_id, turn, sha256(CASE WHEN role = 'user' AND {_strip('text')} <> '' THEN chr(10) || '## User' || chr(10) || chr(10) || m || chr(10) WHEN role = 'assistant' AND text <> '' THEN chr(10) || '## Assistant' || chr(10) || chr(10) || m || chr(10) END) AS block_sha256
FROM (SELECT *, {_masked('text')} AS m FROM conversations)""")
def k01_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn adds to its session's file."""
    none = F.lit(None).cast("string")
    e = conversation_events(read(spark, sf_dir, "conversations")).select("*", none.alias("stdout"), none.alias("exit_reason"))
    return e.select(F.col("session_id").cast("long").alias("conv_id"), F.col("seq").alias("turn"), F.sha2(sessions.block(e).cast("binary"), 256).alias("block_sha256"))


@query(f"WITH {_LINKED} SELECT page_id, sha256(body || CASE WHEN ends_with(body, chr(10)) THEN '' ELSE chr(10) END || chr(10) || '## {text.RELATED}' || chr(10) || chr(10) || '- [[Start here]]' || chr(10)) AS body_sha256 FROM p")
def k05_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a link to one page that names it."""
    p = linked(spark, sf_dir)
    made = graph.add_backlinks(p, p.select(F.col("name").alias("related"), F.lit("Start here").alias("target")))
    return made.select("page_id", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


@query("SELECT doc_id, sha256(text) AS title_sha256, array_to_string([lang, source], '|') AS tags, sha256(text) AS body_sha256 FROM documents")
def x08_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as titles and bodies, written as front matter and read back as they were."""
    d = read(spark, sf_dir, "documents")
    file = front_matter.render({"title": front_matter.scalar(F.col("text")), "tags": front_matter.tag_list(F.array("lang", "source"))}, F.col("text"))
    d = d.select("doc_id", file.alias("file")).withColumn("fields", front_matter.parse(F.col("file")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select("doc_id", sha(front_matter.string(F.col("fields"), "title")).alias("title_sha256"), F.array_join(front_matter.strings(F.col("fields"), "tags"), "|").alias("tags"), sha(front_matter.body(F.col("file"))).alias("body_sha256"))
