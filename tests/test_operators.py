import datetime as dt

from pyspark.sql import functions as F

from quillbase.functions import html
from quillbase.operators import delta, graph, pages, search, store
from quillbase.plans import views

NOW = dt.datetime(2024, 6, 10)


def plan_by_steps(n, size, overlap):
    """The same plan, block after block."""
    if n <= size:
        return [(1, n)]
    out, first = [], 1
    while first <= n:
        last = min(n, first + size - 1)
        if out and last - first + 1 <= max(1, size // 3) and last == n:
            out[-1] = (out[-1][0], n)
        else:
            out.append((max(1, first - overlap) if out else first, last))
        first = last + 1
    return out


def test_chunk_plans(spark):
    df = spark.range(1, 501).select(F.col("id").alias("doc"), F.col("id").alias("pages"))
    for size, overlap in ((15, 1), (4, 2), (1, 0)):
        got = {}
        for r in delta.chunk_plan(df, size=size, overlap=overlap).orderBy("doc", "chunk").collect():
            got.setdefault(r.doc, []).append((r.page_first, r.page_last))
        assert got == {n: plan_by_steps(n, size, overlap) for n in range(1, 501)}
    odd = spark.createDataFrame([("a", 42), ("b", 0), ("c", 1001), ("d", 600), ("e", None)], "doc string, pages int")
    got = delta.chunk_plan(odd).collect()
    assert [(r.page_first, r.page_last) for r in got if r.doc == "a"] == [(1, 15), (15, 30), (30, 42)]
    assert {r.doc for r in got} == {"a", "d"} and max(r.page_last for r in got) == 500


def test_work_list(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    sources = [("raw", "new", "s1", t(1)), ("raw", "same", "s1", t(1)), ("raw", "changed", "s2", t(1)), ("raw", "unsigned", None, t(1)), ("raw", "no_hash", "", t(1)), ("chunk", "newer", None, t(3)), ("chunk", "older", None, t(1))]
    sums = [("same", "s1", t(2)), ("changed", "s1", t(2)), ("unsigned", "x", t(2)), ("no_hash", None, t(2)), ("newer", None, t(2)), ("older", None, t(2))]
    got = delta.work_list(spark.createDataFrame(sources, "kind string, name string, sha string, mtime timestamp"), spark.createDataFrame(sums, "name string, sha string, mtime timestamp")).collect()
    assert {(r.name, r.reason) for r in got} == {("new", "missing"), ("changed", "stale"), ("newer", "stale")}
    assert spark.createDataFrame([('a\nsource_sha256: "' + "ab" * 32 + '"',)], "x string").select(delta.stored_sha(F.col("x"))).first()[0] == "ab" * 32


PAGES = [("wiki/a/one.md", "one", "concept", ["x"], "First", "[[two]] [[two|t]] [[gone]]"), ("wiki/b/two.md", "two", "concept", ["y"], "Second", "[[one]] [[concepts/one]]"), ("wiki/c/three.md", "three", "bug", ["x"], "Third", "no links")]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "path string, name string, type string, tags array<string>, title string, body string")


def test_graph(spark):
    p = frame(spark)
    e = graph.edges(p)
    assert {tuple(r) for r in e.collect()} == {("one", "two"), ("one", "gone"), ("two", "one"), ("two", "concepts/one")}
    assert {r.name for r in graph.orphans(p, e).collect()} == {"three"}
    assert {r.to for r in graph.missing_pages(p, e).collect()} == {"gone", "concepts/one"}
    assert [tuple(r) for r in graph.broken_links(p, spark.createDataFrame([("two",)], "target string")).collect()] == [("wiki/a/one.md", 2)]


def test_links_of_a_large_page_count(spark):
    p = frame(spark, [*PAGES, ("wiki/d/large.md", "large", "x", [], "", "x" * 2_000_001 + " [[two]] [[two|t]]"), ("wiki/d/null.md", "null", "x", [], "", None)])
    got = graph.broken_links(p, spark.createDataFrame([("two",)], "target string")).collect()
    assert {tuple(r) for r in got} == {("wiki/a/one.md", 2), ("wiki/d/large.md", 2)}


def test_diff(spark):
    before = graph.snapshot(frame(spark))
    assert graph.diff(before, before).count() == 0
    changed = [("wiki/z/one.md", "one", "concept", ["x"], "First", "[[gone]] [[two]] other text"), ("wiki/b/two.md", "two", "note", ["y"], "Second", "[[one]] [[concepts/one]]"), ("wiki/d/four.md", "four", None, None, None, None)]
    got = {tuple(r) for r in graph.diff(before, graph.snapshot(frame(spark, changed))).collect()}
    assert got == {("two", "modified"), ("three", "removed"), ("four", "added")}
    e = graph.edge_diff(graph.edges(frame(spark)), graph.edges(frame(spark, changed[1:2])))
    assert {tuple(r) for r in e.collect()} == {("one", "two", "removed"), ("one", "gone", "removed")}


def test_backlinks(spark):
    p = frame(spark, [*PAGES, ("wiki/d/First.md", "First", "x", [], "Other", "")])
    wanted = spark.createDataFrame([("First", "three"), ("two", "one"), ("nobody", "x")], "related string, target string")
    got = {r.path: r.body for r in graph.add_backlinks(p, wanted).collect()}
    assert "- [[three]]" in got["wiki/a/one.md"] and got["wiki/d/First.md"] == "" and got["wiki/b/two.md"] == PAGES[1][5]


def test_listing_and_lint(spark):
    rows = [("wiki/a.md",), ("wiki/b/c.md",), ("wiki/b/d/e.md",), ("wiki/b/d/f/g.md",), ("wiki/.obsidian/x.md",), ("wiki/templates/y.md",), ("wiki/z.txt",), ("raw/q.md",)]
    df = spark.createDataFrame(rows, "path string").withColumn("size", F.lit(1).cast("long")).withColumn("mtime", F.lit(NOW))
    got = pages.listing(df, "wiki", 2)
    assert [(r.path, r.type) for r in got.collect()] == [("wiki/a.md", "file"), ("wiki/b", "dir"), ("wiki/b/c.md", "file"), ("wiki/b/d", "dir")]
    cut = pages.listing(df, "wiki", 5, limit=2).collect()
    assert len(cut) == 2 and all(r.truncated for r in cut)
    bad = spark.createDataFrame([("p`x", "a\nb​c\nd‮"), ("q", "fine")], "path string, body string")
    assert [tuple(r) for r in pages.invisible_lines(bad).collect()] == [("p?x", "2,3", 2)]
    data = spark.createDataFrame([(bytearray("ab漢".encode()),)], "c binary")
    assert data.select(*[v.alias(k) for k, v in pages.read(F.col("c"), 4).items()]).first() == ("ab�", True, 5)


def test_views(spark):
    rows = [("wiki/projects/p.md", NOW - dt.timedelta(days=3), "active", "x", "py"), ("wiki/projects/q.md", NOW, "done", "x", None), ("wiki/concepts/c.md", NOW - dt.timedelta(days=40), None, "y", None), ("wiki/summaries/s.md", NOW, None, "z", None), ("raw/r.md", NOW, None, "z", None), ("wiki/hot.md", NOW, None, "h", None)]
    df = spark.createDataFrame(rows, "path string, mtime timestamp, status string, type string, tech_stack string").withColumn("updated", F.lit("u"))
    run = {v.name: [tuple(r) for r in views.evaluate(df, v, F.lit(NOW)).collect()] for v in views.DASHBOARD}
    assert run["active_projects"] == [("p", "u", "py")] and run["stale"] == [(40, "c")] and run["hot_cache"] == [("hot", "u", 0)]
    assert len(run["recent_activity"]) == 4 and run["bugs"] == []
    spec = {"views": [{"name": "v", "filters": {"or": ['status == "active"', "!file.inFolder(\"wiki\")"]}, "order": ["file.name", "formula.age_days"], "limit": 3}]}
    (v,) = views.parse_views(spec)
    assert [tuple(r) for r in views.evaluate(df, v, F.lit(NOW), None).collect()] == [("r", 0), ("p", 3)]


def test_search(spark):
    p = frame(spark, [("b.md", "b", "", [], "", "# Head B\nAlpha beta alpha"), ("a.md", "a", "", [], "", "alpha beta"), ("c.md", "c", "", [], "", "gamma")])
    got = search.lexical(p, "ALPHA beta beta").collect()
    assert [(r.path, r.score, r.title) for r in got] == [("a.md", 3, ""), ("b.md", 3, "Head B")]
    assert search.lexical(p, "  ").count() == 0 and search.lexical(p, "nothing").count() == 0
    assert [r.path for r in search.bm25(p, "alpha").collect()] == ["a.md", "b.md"]  # half of a is the word
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in search.nearest(v, [2.0, 0.0], 2).collect()] == [(1, 1.0), (2, 0.707107)]
    fused = search.fuse([search.bm25(p, "alpha"), search.lexical(p, "alpha").select("path", "score")]).collect()
    assert {r.path for r in fused} == {"a.md", "b.md"}
    hits = spark.createDataFrame([("kb://wiki/a/b.md", None, "x", None)], "file string, title string, score string, snippet string")
    assert tuple(search.normal_hits(hits).first()) == ("a/b.md", "", None, "")


def test_whole_pages_are_searched(spark):
    p = frame(spark, [("long.md", "long", "", [], "", "x " * 5000 + "# no heading\nlate needle"), ("short.md", "short", "", [], "", "needle late late")])
    got = {r.path: (r.score, r.snippet) for r in search.lexical(p, "needle late").collect()}
    assert {k: v[0] for k, v in got.items()} == {"long.md": 2, "short.md": 2} and "needle" in got["long.md"][1]
    assert [r.path for r in search.lexical(p, "needle", head=8192).collect()] == ["short.md"]


def test_store(spark):
    made = store.notes(spark.createDataFrame([("A title", "token=abc", ["x", " x ", "y"]), ("A title", "other", None)], "title string, body string, tags array<string>"), F.lit(NOW), "host").collect()
    assert sorted(r.name for r in made) == ["20240610-000000-mcp-A-title-2.md", "20240610-000000-mcp-A-title.md"]
    assert any("tags: [x, y]" in r.content and "token=***" in r.content for r in made)
    old = spark.createDataFrame([("wiki/a.md", {"tags": "[a]"}, "old"), ("wiki/b.md", {"t": "1"}, "old"), ("wiki/c.md", {"t": "1"}, "old")], "path string, fm map<string,string>, body string")
    new = spark.createDataFrame([("wiki/a.md", "merge", {"tags": "[b]"}, "new"), ("wiki/b.md", "create", {"t": "2"}, "new"), ("wiki/d.md", "append", {"t": "3"}, "new")], "path string, mode string, fm map<string,string>, body string")
    got = {r.path: r for r in store.upsert(old, new, "2024-06-10").collect()}
    assert {k: r.outcome for k, r in got.items()} == {"wiki/a.md": "merged", "wiki/b.md": "file_exists", "wiki/c.md": "kept", "wiki/d.md": "created"}
    assert got["wiki/a.md"].fm == {"tags": "[a, b]", "updated": "2024-06-10"} and got["wiki/a.md"].body == "new" and got["wiki/b.md"].body == "old"
    assert got["wiki/d.md"].fm["created"] == "2024-06-10"
    gone = store.archive(old, spark.createDataFrame([("wiki/a.md",), ("wiki/b.md",)], "path string"), F.lit(NOW), spark.createDataFrame([("wiki/b.md",)], "path string"))
    assert {r.outcome: r.path for r in gone.collect()} == {"archived": "wiki/.archive/a-2024-06-10T00-00-00-000Z.md", "broken_links": "wiki/b.md", "kept": "wiki/c.md"}


PAGE = """<html><head><title>T &amp; U</title><meta property="og:image" content="x"></head><body><nav><a href="/">home</a></nav><script>bad()</script>
<article><h1>Head</h1><p onclick="x()">One <b>bold</b> <a href="javascript:x">link</a> <a href="/y">good</a>.</p><ul><li>a</li><li>b</li></ul>
<pre><code class="language-py">x = 1 &lt; 2</code></pre><table><tr><th>k</th></tr><tr><td>v|w</td></tr></table><img src="i.png" alt="I"></article></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(PAGE,), ("<p>" + "long text " * 50 + "</p>",), (None,), ("<div>" * 3000 + "deep",)], "h string")
    a, b, none, deep = [r.a for r in df.select(html.article(F.col("h")).alias("a")).collect()]
    assert a.title == "T & U" and a.og_image is None and a.needs_fallback and [i.src for i in a.images] == ["i.png"]
    assert a.markdown == "# Head\n\nOne **bold** link [good](/y).\n\n- a\n- b\n\n```py\nx = 1 < 2\n```\n\n| k |\n| --- |\n| v\\|w |\n\n![I](i.png)"
    assert not b.needs_fallback and none.markdown == "" and "deep" in deep.text
    clean = df.select(html.sanitize(F.col("h")).alias("s")).first().s
    assert "script" not in clean and "onclick" not in clean and "javascript" not in clean and "&lt; 2" in clean
