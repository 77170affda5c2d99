import duckdb
import pytest
from pyspark.sql import functions as F

from quillbase import queries, queries_more
from quillbase.config import KBConfig, unsafe_settings
from quillbase.functions import html, urls
from quillbase.operators import delta, graph, logs, search
from quillbase.plans import ingest
from quillbase.sources import files
from quillbase.streaming import sessions

NAMES = sorted(n for n in queries.ORACLE_SQL if n in vars(queries_more) or n in ("q01_search", "q02_bm25", "q04_hybrid", "k15_term_statistics"))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("documents", "labels", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


def test_words_of_queries_and_indexes(spark):
    rows = [("a", "C++ and e-mail, Über"), ("b", "e mail c c"), ("c", ""), ("d", None), ("e", "nothing here")]
    pages = spark.createDataFrame(rows, "path string, body string")
    assert search.query_words("E-mail c++ c") == ["c", "e", "mail"]
    direct = {r.path: r.score for r in search.bm25(pages, "c++ e-mail").collect()}
    assert set(direct) == {"a", "b"}
    index = search.inverted_index(pages)
    terms = {(r.key, r.term): (r.tf, r.n) for r in index.collect()}
    assert terms["b", "c"] == (2, 4) and terms["c", None] == (0, 0) and terms["a", "über"] == (1, 5)
    full = pages.where("body is not null")
    a = search.bm25(full, "c++ e-mail").collect()
    n, mean = search.inverted_index(full).groupBy("key").agg(F.first("n").alias("n")).agg(F.count(F.lit(1)), F.avg("n")).first()
    assert [tuple(r) for r in search.bm25_indexed(search.inverted_index(full), "c++ e-mail", n, mean).collect()] == [tuple(r) for r in a]


def test_reference_scan_of_large_and_broken_files(spark):
    rows = [("wiki/a.md", "[[x]] " * 400_000, None), ("raw-sources/b.md", "[[x|y]] [[z]]", None), ("wiki/c.md", None, "EIO " * 100), ("wiki/d.md", None, None)]
    df = spark.createDataFrame(rows, "path string, body string, error string")
    going = spark.createDataFrame([("x",)], "target string")
    got = {r.path: (r.status, r.occurrences, r.in_wiki, r.error and len(r.error)) for r in graph.reference_scan(df, going).collect()}
    assert got == {"wiki/a.md": ("links", 400_000, True, None), "raw-sources/b.md": ("links", 1, False, None), "wiki/c.md": ("unreadable", 0, True, 200)}
    got = {r.path: r.status for r in graph.reference_scan(df, going, 2_000_000).collect()}
    assert got["wiki/a.md"] == "too_large"


def test_logs(spark):
    rows = [("session-logs/a.md", "---\ningested: false\n---\n"), ("session-logs/x/b.md", "ingested: false"), ("session-logs/c.md", " ingested: false"), ("session-logs/d.txt", "ingested: false"), ("session-logs/e.md", None)]
    df = spark.createDataFrame(rows, "path string, body string")
    assert [r.path for r in logs.unprocessed(df).collect()] == ["session-logs/a.md"]
    log = spark.createDataFrame([("l", "ok\nMax turns reached\nmaxturn\nTotal: 3\ntotal: 4\n"), ("m", "")], "path string, body string")
    assert sorted(tuple(r) for r in logs.log_figures(log).collect()) == [("l", 5, 2, "Total: 3"), ("m", 1, 0, None)]
    flags = spark.createDataFrame([("v/.alerts/robots.flag", "2024-01-01\nx"), ("v/.alerts/empty.flag", ""), ("v/no.txt", "")], "path string, body string")
    assert sorted(tuple(r) for r in logs.alerts(flags).collect()) == [("empty", "?"), ("robots", "2024-01-01")]
    assert unsafe_settings(KBConfig(ignore_robots=True), True) == ["ignore-robots", "allow-loopback"] and unsafe_settings(KBConfig()) == []


def test_chunk_names_with_marks_in_stems(spark):
    names = spark.createDataFrame([("s--a-pp-b-pp001-002.md",), ("s-a-pp-b-index.md",), ("s--a-ppx.md",), ("t--a-pp-b-pp1.md",), ("s--a-pp-b-pp1.txt",)], "name string")
    docs = spark.createDataFrame([("s", "a-pp-b"), ("s", "a")], "subdir string, stem string")
    assert sorted((r.stem, r.name) for r in delta.of_document(names, docs).collect()) == [("a", "s--a-pp-b-pp001-002.md"), ("a", "s--a-ppx.md"), ("a", "s-a-pp-b-index.md"), ("a-pp-b", "s--a-pp-b-pp001-002.md")]
    assert ("a-pp-b", "s-a-pp-b-index.md") in {(r.stem, r.name) for r in delta.of_document(names, docs, True).collect()}


def test_addresses(spark):
    cases = [("http://h/a/b", "c", "http://h/a/c"), ("http://h", "c", "http://h/c"), ("http://h/a/", "..", "http://h/"), ("http://h/a/b?q", "", "http://h/a/b?q"), ("http://h/a/b?q", "?r", "http://h/a/b?r"), ("http://h/a/b?q", "#f", "http://h/a/b?q#f"), ("https://u@h:1/a", "/x/./y/../z", "https://u@h:1/x/z")]
    df = spark.createDataFrame(cases, "base string, src string, want string")
    for r in df.withColumn("got", urls.absolute(F.col("src"), F.col("base"))).collect():
        assert r.got == r.want, r


def test_transcripts_and_documents(spark):
    line = lambda *t: '{"type": "assistant", "message": {"content": [' + ", ".join('{"type": "text", "text": "%s"}' % x for x in t) + "]}}"
    lines = spark.createDataFrame([("p", 2, line("c")), ("p", 1, line("a", "b")), ("p", 3, "no json"), ("q", 1, line())], "path string, offset long, line string")
    assert [tuple(r) for r in files.assistant_messages(lines).collect()] == [("p", "ab\n\nc")]
    docs = spark.createDataFrame([("r/a.md", bytearray(b"# T\nx")), ("r/b.zip", bytearray(b"")), ("r/c.epub", bytearray(b"?")), ("r/d.pdf", bytearray(b"%"))], "path string, content binary")
    pages = spark.createDataFrame([("r/d.pdf", 1, "one")], "doc string, page_no int, text string")
    got = {r.path: (r.reader, r.title, r.text, r.status) for r in ingest.documents(docs, pages).collect()}
    assert got == {"r/a.md": ("md", "T", "# T\nx", "extracted"), "r/b.zip": (None, None, None, "unsupported_extension"), "r/c.epub": ("epub", None, None, "bad_archive"), "r/d.pdf": ("pdf", "d.pdf", "one", "extracted")}


def test_deep_pages(spark):
    deep = "<b>" * 1500 + "x" + "</b>" * 1500
    lists = "<ul><li>" * 400 + "y" + "</li></ul>" * 400
    df = spark.createDataFrame([(f"<article><p>{deep}</p></article>",), (f"<div>{lists}</div>",)], "h string")
    got = [r.m for r in df.select(html.article(F.col("h"))["markdown"].alias("m")).collect()]
    assert "x" in got[0] and "y" in got[1]


def test_idle_sessions_leave_the_state():
    class State:
        hasTimedOut, exists, removed, timeout = False, False, False, None

        def update(self, value):
            self.value, self.exists = value, True

        def setTimeoutDuration(self, ms):
            self.timeout = ms

        def remove(self):
            self.removed = True

    import pandas as pd

    frame = pd.DataFrame([("s", 1, pd.Timestamp("2024-01-01"), "UserPromptSubmit", "t", 1, 0, 0, 0)], columns=["session_id", "seq", "ts", "hook_event_name", "title", "prompts", "turns", "commands", "edits"])
    state = State()
    assert len(list(sessions._advance(("s",), iter([frame]), state, 1000))) == 1 and state.timeout == 1000
    state.hasTimedOut = True
    assert list(sessions._advance(("s",), iter([]), state, 1000)) == [] and state.removed
