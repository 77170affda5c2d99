"""Registered queries of refreshed indexes, cross-links and streams into tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import delta, graph, logs, mentions, pages
from .operators.index import SearchIndex
from .operators.snapshots import Snapshots
from .operators.vectors import VectorIndex
from .operators.versions import Versions
from .plans.ingest import from_template, lint, lint_report
from .queries import _BM, _SESSIONS, _VAULT, ORACLE_SQL, _linked_sql, _masked, _strip, conversation_events, linked, query, read, vault
from .shared import shared_dir
from .sources import files, jsonl
from .streaming import ingest, timed


def folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# ---- the refreshed index


def refreshed(spark: SparkSession, sf_dir: str, key: str = "path") -> SearchIndex:
    """An index of an earlier state of the documents, brought up to date: one in a hundred had other words, one in 150 is new, others are gone."""
    v = vault(spark, sf_dir).select(F.col(key).cast("string").alias("key"), "body", F.col("doc_id").alias("id"))
    old = v.where("id % 150 <> 1").withColumn("body", F.when(F.col("id") % 100 == 0, F.concat(F.lit("stale idiot words "), "body")).otherwise(F.col("body")))
    gone = v.where("id % 120 = 7").select(F.concat(F.lit("gone/"), "key").alias("key"), F.concat("body", F.lit(" clown")).alias("body"), "id")
    index = SearchIndex(spark, folder(spark, "search-index"), "key", "body")
    index.refresh(old.unionByName(gone))
    index.refresh(v)
    return index


@query(ORACLE_SQL["k15_term_statistics"])
def k15_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term statistics of an index after a refresh are those of the pages."""
    return refreshed(spark, sf_dir).term_statistics()


@query(ORACLE_SQL["q02_bm25"])
def q02_bm25_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking from an index after a refresh and a merge; blocks that can't reach the top ten stay unread."""
    index = refreshed(spark, sf_dir)
    index.merge(most=1)
    return index.search("idiot clown pathetic").withColumnRenamed("key", "path")


@query(f"""WITH {_VAULT}, d AS (SELECT path, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM v),
s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d), p AS (SELECT path, len(w) AS n, unnest(w) AS term FROM d), t AS (SELECT path, n, term, count(*) AS tf FROM p GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark), k AS (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term),
r AS (SELECT item_id, path, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM q JOIN k USING (term) JOIN t USING (term), s GROUP BY item_id, path)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, path) AS INT) AS rank, path, score FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, path) <= 10""")
def q02_bm25_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of the benchmark as a query, all in one plan."""
    index = SearchIndex(spark, folder(spark, "search-index"), postings=False)
    index.refresh(vault(spark, sf_dir))
    return index.search_many(read(spark, sf_dir, "benchmark"), 10, "item_id", "text")


# ---- vectors


def _vectors(spark: SparkSession, sf_dir: str) -> VectorIndex:
    index = VectorIndex(spark, folder(spark, "vector-index"))
    index.build(read(spark, sf_dir, "embeddings"))
    return index


@query(ORACLE_SQL["q03_nearest"])
def q03_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows from an index of which every list is probed."""
    index = _vectors(spark, sf_dir)
    size = read(spark, sf_dir, "embeddings").select(F.max(F.size("embedding"))).first()[0] or 0
    return index.search([1.0 / i for i in range(1, size + 1)])


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e, e AS q WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def q03_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row in a hundred as a query against all rows, with every list probed."""
    asked = read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = _vectors(spark, sf_dir)
    return index.search_many(asked, 10, probes=len(index.store.manifest()["centres"]) or 1)


# ---- cross-links

_RUN = r"array_to_string(regexp_extract_all(lower(X), '[\p{L}\p{N}]+'), 'S')"


def _run(column: str, space: str = " ") -> str:
    return _RUN.replace("X", column).replace("'S'", f"'{space}'")


@query(f"""WITH {_linked_sql()}, t AS (SELECT 'wiki/' || page_id || '.md' AS path, CAST(page_id AS VARCHAR) AS name, {_run("regexp_extract(html, '<title>([^<]*)', 1)")} AS title FROM pages),
d AS (SELECT title, max(path) AS target FROM t WHERE contains(title, ' ') GROUP BY title), n AS (SELECT title, target, ' ' || replace(title, ' ', '  ') || ' ' AS name FROM d),
b AS (SELECT 'wiki/' || page_id || '.md' AS path, '  ' || {_run("body", "  ")} || '  ' AS s FROM p),
m AS (SELECT path, target, title, CAST((length(s) - length(replace(s, name, ''))) // length(name) AS BIGINT) AS times FROM b, n WHERE path <> target AND contains(s, name)),
k AS (SELECT 'wiki/' || page_id || '.md' AS path, lower(x) AS to, {_run("x")} AS run FROM (SELECT page_id, unnest(links) AS x FROM l))
SELECT path, target, title, times FROM m WHERE NOT EXISTS (SELECT 1 FROM k JOIN t ON t.path = m.target WHERE k.path = m.path AND (k.to = t.name OR k.run = m.title))""")
def j13_cross_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that name the title of another page, of two words or more, without a link to it."""
    return mentions.missing_links(linked(spark, sf_dir))


_LINT = f"""SELECT 'wiki/' || name || '.md' AS path, 'orphan' AS kind, '' AS detail FROM ({ORACLE_SQL["j13_orphans"]})
UNION ALL SELECT "to", 'missing_page', CAST(pages AS VARCHAR) FROM ({ORACLE_SQL["j13_missing_pages"]}) WHERE pages >= 3
UNION ALL SELECT path, 'missing_link', target FROM ({ORACLE_SQL["j13_cross_links"]})
UNION ALL SELECT 'wiki/' || page_id || '.md', 'missing_front_matter', concat_ws(',', CASE WHEN regexp_extract(html, '<title>([^<]*)', 1) = '' THEN 'title' END, 'tags', CASE WHEN page_id % 2 = 1 THEN 'updated' END) FROM pages"""


def linted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = linked(spark, sf_dir)
    fields = F.create_map(F.lit("title"), F.col("title"), F.lit("tags"), F.lit("~"), F.lit("updated"), F.when(F.col("page_id") % 2 == 0, "2024-01-01"))
    return lint(p.withColumn("fm", fields))


@query(_LINT)
def k12_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings about pages whose front matter has no tags, and half of which say no date."""
    return linted(spark, sf_dir)


@query(f"""WITH f AS ({_LINT}), o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path, detail) AS place FROM f)
SELECT kind, count(*) AS n, sha256('## ' || CASE kind WHEN 'missing_front_matter' THEN 'Missing front matter' WHEN 'orphan' THEN 'Orphan pages' WHEN 'missing_page' THEN 'Pages to write' WHEN 'missing_link' THEN 'Missing links' END || ' (' || count(*) || ')' || chr(10) || chr(10)
|| string_agg('- ' || path || CASE WHEN detail <> '' THEN ': ' || detail ELSE '' END, chr(10) ORDER BY place) FILTER (WHERE place <= 50) || CASE WHEN count(*) > 50 THEN chr(10) || '- and ' || (count(*) - 50) || ' more' ELSE '' END || chr(10)) AS text_sha256 FROM o GROUP BY kind""")
def k12_lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's sections, with the first fifty findings of each."""
    made = lint_report(linted(spark, sf_dir), 50)
    return made.select("kind", "n", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


# ---- versions and streams


@query("SELECT 0 AS version, lang, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 1, lang, count(*) FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def k14_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents published, then only those with labels: a reader of the first version still sees all."""
    store = Versions(spark, folder(spark, "published"))
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    first = store.publish({"documents": d})
    reader = store.table("documents", first)
    second = store.publish({"documents": d.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id")}, first)
    store.collect(keep=2)
    counts = lambda df, v: df.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("version"), "lang", "n")
    return counts(reader, first).unionByName(counts(store.table("documents", second), second))


@query("""SELECT CAST(conv_id AS VARCHAR) AS session_id, count_if(role IN ('user', 'assistant')) AS events, count_if(role = 'user') AS prompts, count_if(turn % 5 = 3) AS bad,
CAST(sum(CASE WHEN role IN ('user', 'assistant') THEN length(coalesce(text, '')) ELSE 0 END) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""")
def t01_ingested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as files of JSON lines, some of them broken, streamed into tables, and one batch replayed."""
    root = folder(spark, "events")
    c = read(spark, sf_dir, "conversations")
    e = conversation_events(c).select("session_id", "seq", "ts", "hook_event_name", "prompt", "text")
    whole = e.select(F.to_json(F.struct("*")).alias("value"))
    broken = c.where("turn % 5 = 3").select(F.concat(F.lit('{"session_id": "'), F.col("conv_id").cast("string"), F.lit('", "seq":')).alias("value"))
    whole.unionByName(broken).repartition(4).write.text(f"{root}/in")
    ingest.ingest_events(spark, f"{root}/in", root, 2).awaitTermination()
    table = ingest.BatchTable(spark, f"{root}/tables")
    events = table.read("events", ingest.EVENTS)
    ingest.put_events(table, events.withColumns({ingest.BAD: F.lit(None).cast("string"), "file": F.lit("")}), 0)  # changes nothing
    bad = table.read("bad_records", ingest.BAD_RECORDS).groupBy(F.regexp_extract(ingest.BAD, r'"session_id": "(\d+)"', 1).alias("session_id")).agg(F.count(F.lit(1)).alias("bad"))
    good = table.read("events", ingest.EVENTS).groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("hook_event_name") == "UserPromptSubmit").alias("prompts"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return good.join(bad, "session_id", "full_outer").select("session_id", zero("events"), zero("prompts"), zero("bad"), zero("chars"))


@query(ORACLE_SQL["j01_work_list"])
def t05_tracked_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work list of documents that came as a stream of sources, an older state of some before."""
    root = folder(spark, "sources")
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    sources = lambda text: d.select(F.lit("raw").alias("kind"), F.concat("source", F.lit("-"), "doc_id", F.lit(".md")).alias("name"), F.sha2(text.cast("binary"), 256).alias("sha"), F.lit(None).cast("timestamp").alias("mtime"), "doc_id")
    now = sources(F.col("text"))
    old = sources(F.concat("text", F.lit(" before"))).where("doc_id % 3 = 0")
    schema = old.drop("doc_id").schema
    for state in (old, now):
        state.drop("doc_id").write.mode("append").parquet(f"{root}/in")
        ingest.track_sources(spark.readStream.schema(schema).parquet(f"{root}/in"), root).awaitTermination()
    summaries = now.join(lab, "doc_id").select("name", F.when(F.col("quality") == 1, F.col("sha")).otherwise(F.sha2(F.col("sha").cast("binary"), 256)).alias("sha"), "mtime")
    return delta.work_list(ingest.tracked(spark, root), summaries)


_FILES = _SESSIONS.replace("SELECT CAST(conv_id AS VARCHAR) AS session_id, strftime", "SELECT conv_id, strftime").replace("CAST(prompts AS BIGINT) AS prompts, CAST(turns AS BIGINT) AS turns FROM t2", "prompts FROM t2")


@query(f"""WITH n AS ({"WITH " + _FILES}), b AS (SELECT conv_id, turn, role, text, {_masked('text')} AS m FROM conversations), s AS (SELECT conv_id, min(turn) AS first FROM conversations WHERE role = 'user' AND {_strip('text')} <> '' GROUP BY conv_id),
k AS (SELECT b.conv_id, turn, chr(10) || CASE role WHEN 'user' THEN '## User' ELSE '## Assistant' END || chr(10) || chr(10) || m || chr(10) AS block FROM b JOIN s USING (conv_id) WHERE turn >= first AND (role = 'user' AND {_strip('text')} <> '' OR role = 'assistant' AND text <> ''))
SELECT CAST(conv_id AS VARCHAR) AS session_id, file, count(*) AS n_blocks, sha256('---' || chr(10) || 'type: log' || chr(10) || 'session_id: ' || conv_id || chr(10) || 'ingested: false' || chr(10) || '---' || chr(10) || string_agg(block, '' ORDER BY turn)) AS content_sha256
FROM k JOIN n USING (conv_id) GROUP BY conv_id, file""")
def k01_session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of sessions from a stream of events through the sink of blocks."""
    root = folder(spark, "session-files")
    static = read(spark, sf_dir, "conversations")
    source = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/conversations.parque[t]")  # a pattern, so it may be a file
    none = F.lit(None).cast("string")
    ingest.write_blocks(conversation_events(source).select("*", none.alias("stdout"), none.alias("exit_reason")), root).awaitTermination()
    made = ingest.session_files(ingest.committed_blocks(spark, root))
    return made.select("session_id", "file", "n_blocks", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))


# ---- snapshots, sources and sessions


@query(ORACLE_SQL["j07_snapshot_diff"])
def j07_stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same difference between two stored snapshots, of whose buckets only the unequal ones are read."""
    d = vault(spark, sf_dir).select("name", "path", F.col("lang").alias("type"), F.array("source").alias("tags"), F.col("source").alias("title"), "body", "doc_id")
    after = d.join(read(spark, sf_dir, "labels"), "doc_id").withColumn("type", F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("type"))).select(d.columns).drop("doc_id")
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), "item_id").alias("name"), F.lit("wiki/item.md").alias("path"), F.lit("item").alias("type"), F.array(F.lit("")).alias("tags"), F.lit("").alias("title"), F.col("text").alias("body"))
    store = Snapshots(spark, folder(spark, "snapshots"))
    return store.diff(store.save(d.drop("doc_id")), store.save(after.unionByName(items)))


@query(ORACLE_SQL["j08_edge_diff"])
def j08_stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of two stored snapshots, before and after every page was put in lower case."""
    p, store = linked(spark, sf_dir), Snapshots(spark, folder(spark, "snapshots"))
    return store.edge_diff(store.save(p), store.save(p.withColumn("body", F.lower("body"))))


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'UserPromptSubmit' ELSE 'Stop' END AS kind, sha256(text) AS prompt_sha256 FROM conversations WHERE role IN ('user', 'assistant')""")
def s06_events_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as one file of JSON lines, read by ranges of bytes."""
    root = folder(spark, "event-file")
    e = conversation_events(read(spark, sf_dir, "conversations")).select("session_id", "hook_event_name", F.col("text").alias("prompt"), F.concat(F.lit("/t/"), "seq").alias("cwd"))
    e.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(root)
    made = files.hook_events(jsonl.events(spark, root, ".txt", 256 << 10).select("line"), "line")
    turn = F.regexp_extract("cwd", r"(\d+)$", 1)
    return made.select(F.col("session_id").cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.col("hook_event_name").alias("kind"), F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"))


@query(f"WITH {_SESSIONS}")
def t02_timed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from a stream whose later turns come first."""
    root = folder(spark, "timed-sessions")
    c = read(spark, sf_dir, "conversations")
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        put = lambda df, n: df.write.mode("overwrite").parquet(f"{root}/rows/batch={n}")
        # a batch for each part, however many files it has; the second goes on from the first one's states
        for part in (c.where("turn % 2 = 1"), c.where("turn % 2 = 0")):
            part.write.mode("append").parquet(f"{root}/in")
            out = timed.stream(conversation_events(spark.readStream.schema(c.schema).parquet(f"{root}/in")), late="3650 days")
            out.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    last = spark.read.parquet(f"{root}/rows").groupBy("session_id").agg(F.max_by(F.struct("file", "prompts", "turns"), "batch").alias("r"))
    return last.select("session_id", "r.file", "r.prompts", "r.turns")


# ---- what had no query


@query(r"""WITH r AS (SELECT page_id, regexp_extract(url, '(?s)://[^/]*(.*)$', 1) AS p FROM pages), c AS (SELECT page_id, unnest([p, p[2:], '../' || p[2:], 'a/../../' || p[2:], 'a/./b/../..' || p, regexp_replace(p, '[^a-z/]', '', 'g')[2:], '']) AS path FROM r),
s AS (SELECT *, list_transform(string_split(path, '/'), lambda x: CASE WHEN x = '..' THEN -1 WHEN x IN ('.', '') THEN 0 ELSE 1 END) AS s FROM c)
SELECT page_id, path, CASE WHEN path = '' OR length(path) > 512 THEN 'invalid_path' WHEN starts_with(path, '/') THEN 'absolute_path' WHEN NOT regexp_full_match(path, '[\p{L}\p{N}/._ -]+') THEN 'invalid_path'
WHEN list_min(list_transform(range(1, len(s) + 1), lambda i: list_sum(s[1:i]))) < 0 THEN 'path_traversal' END AS code FROM s""")
def f01_path_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages' addresses, as they are and with steps up, and why they are refused."""
    p = F.regexp_extract("url", r"(?s)://[^/]*(.*)\z", 1)
    rest = F.expr("substring(p, 2)")
    shapes = F.array(F.col("p"), rest, F.concat(F.lit("../"), rest), F.concat(F.lit("a/../../"), rest), F.concat(F.lit("a/./b/../.."), "p"), F.expr("substring(regexp_replace(p, '[^a-z/]', ''), 2)"), F.lit(""))
    rows = read(spark, sf_dir, "pages").select("page_id", p.alias("p")).select("page_id", F.explode(shapes).alias("path"))
    return rows.select("page_id", "path", text.path_code(F.col("path")).alias("code"))


@query("SELECT source AS name, arg_max('wiki/' || doc_id || '.md', 'wiki/' || doc_id || '.md') AS path, arg_max(lang, 'wiki/' || doc_id || '.md') AS type FROM documents GROUP BY source")
def w03_equal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages named by their source: of equal names the last path counts."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.concat(F.lit("wiki/"), "doc_id", F.lit(".md")).alias("path"), F.col("lang").alias("type"), F.array(F.lit("")).alias("tags"), F.lit("").alias("title"), F.col("text").alias("body"))
    return graph.snapshot(d).select("name", "path", "type")


@query("SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN string_split(text, chr(10))[1] = '' THEN '?' ELSE string_split(text, chr(10))[1] END AS raised FROM documents WHERE lang <> 'en'")
def k17_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of which those in other languages than English are flags."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("wiki/.alerts/"), "doc_id", F.when(F.col("lang") == "en", ".md").otherwise(".flag")).alias("path"), F.col("text").alias("body"))
    return logs.alerts(d)


@query(f"SELECT doc_id, sha256('## Summary' || chr(10) || chr(10) || {_strip('text')} || chr(10) || chr(10) || '## Details' || chr(10)) AS page_sha256 FROM documents")
def s23_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put into the template of concepts."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(from_template("concept", F.col("text")).cast("binary"), 256).alias("page_sha256"))


@query("SELECT doc_id, CAST(strlen(text) AS INT) AS byte_size, strlen(text) > 3000 AS truncated, CASE WHEN strlen(text) <= 3000 THEN sha256(text) END AS whole_sha256 FROM documents")
def s02_page_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files read up to a number of bytes."""
    d = read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in pages.read(F.col("text").cast("binary"), 3000).items()])
    return d.select("doc_id", "byte_size", "truncated", F.when(~F.col("truncated"), F.sha2(F.col("contents").cast("binary"), 256)).alias("whole_sha256"))
