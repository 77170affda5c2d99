from pyspark.sql import functions as F

from quillbase.functions import urls
from quillbase.sources.files import url_list

CODES = {
    "https://example.com/a": None,
    "http://172.15.0.1/": None,
    "http://0foo.com/": None,
    "ftp://example.com": "url_scheme",
    "javascript:alert(1)": "url_scheme",
    "nonsense": "url_parse",
    "http://u:p@example.com": "url_credentials",
    "http://2130706433/": "url_non_standard_ip",
    "http://0x7f000001/": "url_non_standard_ip",
    "http://0177.0.0.1/": "url_non_standard_ip",
    "http://localhost:80/": "url_localhost",
    "http://a.localhost/": "url_localhost",
    "http://127.1.2.3/": "url_loopback",
    "http://[::1]/": "url_loopback",
    "http://[::ffff:127.0.0.1]/": "url_loopback",
    "http://[::ffff:7f00:1]/": "url_loopback",
    "http://169.254.169.254/x": "url_link_local",
    "http://[fe80::1]/": "url_link_local",
    "http://10.0.0.1/": "url_private_ip",
    "http://192.168.1.1/": "url_private_ip",
    "http://172.31.9.9/": "url_private_ip",
    "http://[fd00::1]/": "url_private_ip",
    "http://[::ffff:0a00:1]/": "url_private_ip",
    None: "url_parse",
}


def test_safety(spark):
    df = spark.createDataFrame([(u,) for u in CODES], "u string")
    assert {r.u: r.c for r in df.select("u", urls.safety_code(F.col("u")).alias("c")).collect()} == CODES


def test_file_names(spark):
    want = {"https://Example.com/a/b.html": "example.com-a-b.md", "https://e.com/": "e.com-root.md", "https://e.com/%E6%BC%A2%20x": "e.com-漢-x.md", "https://e.com/100%": "e.com-100.md"}
    df = spark.createDataFrame([(u,) for u in [*want, "https://e.com/?q=1", "https://e.com/" + "x" * 100]], "u string")
    got = {r.u: r.n for r in df.select("u", urls.file_name(F.col("u")).alias("n")).collect()}
    assert {u: got[u] for u in want} == want
    assert got["https://e.com/?q=1"].startswith("e.com-root-") and len(got["https://e.com/" + "x" * 100]) == 80 + 9 + 3


def test_routes_and_images(spark):
    rows = [("text/html; charset=x", "http://a/b", "html"), ("", "http://a/b.PDF?x", "pdf"), ("application/octet-stream", "http://a/b.pdf", "pdf"), ("application/octet-stream", "http://a/b", "reject"), ("application/x-pdf", "http://a", "pdf"), (None, "http://a", "reject")]
    df = spark.createDataFrame(rows, "t string, u string, w string")
    assert all(r.w == r.r for r in df.select("w", urls.content_route(F.col("t"), F.col("u")).alias("r")).collect())
    rows = [("data:image/png,x", "image/png", 500, "skip data: URI"), ("/a.png", "image/png", 500, None), ("ftp://x/a", "image/png", 500, "skip non-http URL"), ("//c/a.svg", "image/svg+xml", 500, "SVG skipped"), ("a.png", "image/png", 100, "small image"), ("a", "text/plain", 500, "unsupported MIME"), ("http://../x.png", "image/png", 500, "skip unsafe hostname")]
    df = spark.createDataFrame(rows, "s string, t string, n int, w string")
    got = df.select("w", urls.image_problem(F.col("s"), F.lit("https://h/d/p"), F.col("t"), F.col("n"), F.lit(False)).alias("p"), urls.absolute(F.col("s"), F.lit("https://h/d/p")).alias("a")).collect()
    assert all(r.w == r.p for r in got) and [got[1].a, got[3].a, got[4].a] == ["https://h/a.png", "https://c/a.svg", "https://h/d/a.png"]


def test_refresh(spark):
    now = F.lit("2024-06-10 00:00:00").cast("timestamp")
    rows = [("s", None, "2024-06-05T00:00:00Z", True), ("s", None, "2024-01-01T00:00:00Z", False), ("", None, "2024-06-05T00:00:00Z", False), ("s", "never", None, True), ("s", None, "soon", False), ("s", None, "2025-01-01T00:00:00Z", True)]
    df = spark.createDataFrame(rows, "sha string, policy string, at string, w boolean")
    args = F.col("sha"), F.col("policy"), F.col("at"), now
    got = df.select("w", urls.fresh(*args, 30).alias("f"), urls.fresh(*args, 30, strict=True).alias("s"), urls.fresh(*args, None).alias("n")).collect()
    assert [r.f for r in got] == [r.w for r in got] and not got[-1].s and [r.n for r in got] == [True, True, False, True, True, True]


ROBOTS = """# comment
User-agent: KB
User-agent: other
Disallow: /private
Allow: /private/open
Disallow: /same
Allow: /same

User-agent: *
Disallow: /
Disallow:
Allow: /*.html$
"""


def test_robots(spark):
    rules = urls.robots_rules(spark.createDataFrame([("h", ROBOTS), ("empty", ""), ("bare", "User-agent: *\nDisallow: /x")], "host string, txt string"))
    probes = [("h", "kb", "/private/a", False), ("h", "KB", "/private/open/a", True), ("h", "kb", "/same", True), ("h", "kb", "/", True), ("h", "other", "/private", False), ("h", "kbx", "/a", False), ("h", "x", "/a.html", True), ("h", "x", "/a.html?q", False), ("empty", "kb", "/", True), ("none", "kb", "/", True), ("bare", "kb", "/x", False)]
    df = spark.createDataFrame(probes, "host string, ua string, path string, w boolean")
    got = urls.robots_allowed(df, rules).collect()
    assert len(got) == len(probes) and all(r.w == r.allowed for r in got), got
    assert all(r.allowed for r in urls.robots_allowed(df, rules, ignore=True).collect())


def test_url_list(spark):
    txt = "# all\r\nhttps://a/x#frag ; tags= a, b ,; title=T = U; refresh_days=7 # note\nnot a url\nhttps://b; nokey; foo=1; refresh_days=99999\nhttps://c; refresh_days=never; refresh_days=x"
    got = url_list(spark.createDataFrame([("f", txt)], "file string, txt string")).orderBy("line_no").collect()
    assert [(r.line_no, r.url, r.tags, r.title, r.refresh_days) for r in got] == [(2, "https://a/x#frag", ["a", "b"], "T = U", "7"), (3, None, None, None, None), (4, "https://b", None, None, None), (5, "https://c", None, None, "never")]
    assert [len(r.warnings) for r in got] == [0, 1, 3, 1]
