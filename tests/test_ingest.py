import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillbase import kb as K
from quillbase import queries
from quillbase.functions import html, text, urls
from quillbase.plans import ingest, views

AT = dt.datetime(2024, 6, 10)
LONG = "<article><p>" + "Some words of an article. " * 30 + "</p></article>"


def test_fetched(spark):
    rows = [("https://a.com/new", LONG, "text/html"), ("https://a.com/same", LONG, "text/html"), ("https://a.com/short", "<p>x</p>", "text/html"), ("http://10.0.0.1/", LONG, "text/html"), ("https://a.com/f.pdf", "", "application/pdf"), ("https://a.com/no/x", LONG, "text/html"), ("https://a.com/fresh", LONG, "text/html")]
    web = spark.createDataFrame(rows, "url string, html string, content_type string").withColumn("truncated", F.lit(False))
    none = spark.createDataFrame([], "name string, source_sha256 string, refresh_days string, fetched_at string")
    sha = next(r.source_sha256 for r in ingest.fetched(web, none, F.lit(AT)).collect() if r.name == "a.com-same.md")
    old = spark.createDataFrame([("a.com-same.md", sha, None, "2020-01-01T00:00:00Z"), ("a.com-fresh.md", "x", None, "2024-06-09T00:00:00Z")], "name string, source_sha256 string, refresh_days string, fetched_at string")
    rules = urls.robots_rules(spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /no/")], "host string, txt string"))
    got = ingest.fetched(web, old, F.lit(AT), None, rules)
    status = {r.url: r.status for r in got.collect()}
    assert list(map(status.get, [r[0] for r in rows])) == ["fetched_and_summarized_pending", "skipped_same_sha", "extraction_failed", "url_private_ip", "dispatched_to_pdf", "robots_disallowed", "skipped_within_refresh"]
    (text,) = [r.t for r in got.withColumn("t", ingest.fetched_file(got, F.lit(AT))).where("url = 'https://a.com/new'").collect()]
    assert text.startswith('---\ntitle: ""\nsource_type: "url"\nsource_url: "https://a.com/new"\nsource_sha256: "')


def test_ingest_pages_cost(spark, sf):
    """A store that is empty joins nothing; pages are dealt out even from one row group; a page's text is computed once."""
    df = queries.QUERIES["x20_ingest_pages"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert plan.count(text.INVISIBLE) <= 3  # 25 where each head of a rule names the text again
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert {r.status for r in df.select("status").distinct().collect()} <= {"fetched_and_summarized_pending", "extraction_failed"} and df.count() == queries.read(spark, sf, "pages").count()


def test_article_fields(spark):
    df = spark.createDataFrame([(LONG,), (None,)], "h string").select(html.article(F.col("h")).alias("a"), html.article(F.col("h"), "needs_fallback", "markdown").alias("b"))
    assert df.schema["b"].dataType.names == ["markdown", "needs_fallback"]
    assert all(r.a.markdown == r.b.markdown and r.a.needs_fallback == r.b.needs_fallback for r in df.collect())


def test_page_chunks(spark):
    texts = [("papers/a.pdf", n, f"page {n} token=abc") for n in range(1, 43)] + [("papers/b.pdf", 1, " \n")] + [("papers/c.pdf", 1, "x")]
    docs = [("papers/a.pdf", "s", "Document1", False), ("papers/b.pdf", "s", "T", False), ("papers/c.pdf", "s", "T", True)]
    side = spark.createDataFrame([("papers/a.pdf", "Given")], "doc string, title string")
    got = ingest.page_chunks(spark.createDataFrame(texts, "doc string, page_no int, text string"), spark.createDataFrame(docs, "doc string, sha string, title string, encrypted boolean"), sidecars=side).orderBy("chunk").collect()
    assert [r.name for r in got] == ["papers--a-pp001-015.md", "papers--a-pp015-030.md", "papers--a-pp030-042.md"]
    assert got[1].text.startswith("page 15 token=***\n\npage 16") and got[0].title == "Given" and got[0].total_pages == 42
    names = [("Microsoft Word - x.doc", "n"), ("Untitled", "n"), (".", "n"), ("Document12", "n"), (None, "n"), ("Real", "n")]
    df = spark.createDataFrame(names, "t string, n string")
    assert [r.x for r in df.select(ingest.document_title(F.col("t"), F.col("n")).alias("x")).collect()] == ["n"] * 5 + ["Real"]


@pytest.fixture()
def vault(spark, tmp_path):
    def put(path, body):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)

    put("wiki/index.md", "# Index")
    put("wiki/projects/alpha.md", "---\ntitle: Alpha\ntags: [x]\nupdated: 2024-01-01\nstatus: active\ntech_stack: py\n---\nAbout [[Beta]] and needle\n")
    put("wiki/concepts/beta.md", "---\ntitle: Beta\ntags: [y]\nupdated: 2024-01-01\n---\nneedle needle​\n")
    put("raw-sources/x.md", "raw")
    return K.KnowledgeBase(spark, str(tmp_path))


def test_search_by_vectors(spark, vault):
    near = spark.createDataFrame([("wiki/index.md", 0.9), ("wiki/concepts/beta.md", 0.5)], "path string, score double")
    assert [r.path for r in vault.search("needle", mode="hybrid", near=near).collect()] == ["wiki/concepts/beta.md", "wiki/index.md", "wiki/projects/alpha.md"]
    assert [r.path for r in vault.search("needle", 1, "vec", near).collect()] == ["wiki/index.md"]


def test_tools(spark, vault):
    assert [r.path for r in vault.list(depth=2).collect()] == ["wiki/concepts", "wiki/concepts/beta.md", "wiki/index.md", "wiki/projects", "wiki/projects/alpha.md"]
    assert vault.read("index.md").first() == ("# Index", False, 7)
    assert [r.path for r in vault.search("needle").collect()][0] == "wiki/concepts/beta.md"
    assert {r.path for r in vault.search("needle", mode="hybrid").collect()} == {"wiki/concepts/beta.md", "wiki/projects/alpha.md"}
    assert {r.outcome for r in vault.archive("concepts/beta.md").collect()} == {"kept", "broken_links"}
    assert {r.outcome for r in vault.archive("concepts/beta.md", force=True).collect()} == {"kept", "archived"}
    assert {r.outcome for r in vault.archive("index.md", force=True).collect()} == {"kept", "protected"}
    done = vault.upsert_pages(spark.createDataFrame([("wiki/new.md", "create", {"title": "N"}, "b")], "path string, mode string, fm map<string,string>, body string"))
    assert done.where("outcome = 'created'").count() == 1
    assert [tuple(r) for r in vault.view(views.DASHBOARD[1]).collect()] == [("alpha", "2024-01-01", "py")]
    found = {(r.path, r.kind) for r in vault.lint().collect()}
    assert found == {("wiki/concepts/beta.md", "invisible_characters"), ("wiki/projects/alpha.md", "orphan"), ("wiki/concepts/beta.md", "orphan")}


def test_refusals(vault):
    for path, code in [("", "invalid_path"), ("/etc/x", "absolute_path"), ("a/../../x", "path_traversal"), ("a\0", "invalid_path"), ("a;b", "invalid_path"), ("x" * 600, "invalid_path")]:
        with pytest.raises(K.KBError) as e:
            K.checked_path(path)
        assert e.value.code == code
    with pytest.raises(ValueError):
        vault.search("")
    with pytest.raises(ValueError):
        vault.search("x", mode="magic")


def test_report(spark):
    rows = [("a", dt.datetime(2024, 6, 9), "x", ["f"]), ("b", dt.datetime(2024, 6, 3, 1), "x", []), ("c", dt.datetime(2024, 5, 1), "x", [])]
    got = ingest.commit_report(spark.createDataFrame(rows, "sha string, ts timestamp, author string, files array<string>"), F.lit(AT)).collect()
    assert [tuple(r) for r in got] == [("2024-W23", "x", 2, 1)]
    assert spark.range(1).select(ingest.from_template("decision", F.lit(" why "))).first()[0] == "## Context\n\nwhy\n\n## Decision\n\n## Consequences\n"
