import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillbase.functions import front_matter as fm
from quillbase.functions import text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


SECRETS = {
    "sk-ant-" + "a1B2" * 6: "sk-ant-***",
    "sk-proj-" + "a1B2" * 6: "sk-proj-***",
    "sk-" + "a1B2" * 6: "sk-***",
    "ghp_" + "a1B2" * 6: "ghp_***",
    "github_pat_" + "a1B2" * 6: "github_pat_***",
    "gho_" + "a1B2" * 6: "gho_***",
    "ghu_" + "a1B2" * 6: "ghu_***",
    "AIza" + "a1B2" * 6: "AIza***",
    "AKIA" + "A1B2" * 4: "AKIA***",
    "xoxb-" + "a1B2" * 3: "xox*-***",
    "vercel_" + "a1B2" * 6: "vercel_***",
    "npm_" + "a1B2" * 6: "npm_***",
    "rk_live_" + "a1B2" * 6: "stripe_***",
    "sbp_" + "a1B2" * 6: "sbp_***",
    "PRIVATE_KEY_ID: '" + "ab12" * 10: "private_key_id=***",
    "AccountKey=" + "a1B2" * 6: "AzureKey=***",
    "Bearer abc.def": "Bearer ***",
    "Basic " + "a1B2" * 3: "Authorization ***",
    "https://me:word@host": "https://***:***@host",
    "PASSWORD = 'hunter'": "PASSWORD=***",
    "token　= abc": "token=***",
    "-----BEGIN RSA PRIVATE KEY-----\nab\ncd\n-----END RSA PRIVATE KEY-----": "<PRIVATE KEY REDACTED>",
    "gh­p_​" + "a1B2" * 6: "ghp_***",
}


def test_odd_characters():
    """What the cheap look leaves out can't change: no invisible character, none that NFC changes by itself or after another."""
    for x in map(chr, range(0x110000)):
        if not re.match(text.ODD, x):
            assert not re.match(text.INVISIBLE, x) and all(unicodedata.normalize("NFC", y + x) == y + x for y in ("", "e", "\u00e9", "\u0249"))


def test_masks(spark):
    df = spark.createDataFrame([(k, v) for k, v in SECRETS.items()], "x string, y string")
    got = df.select("x", "y", text.mask(F.col("x")).alias("m"), text.mask(text.mask(F.col("x"))).alias("mm")).collect()
    assert [(r.x, r.m) for r in got] == [(r.x, r.y) for r in got]
    assert all(r.m == r.mm for r in got)
    assert one(spark, text.mask, None) is None and one(spark, text.mask, "é") == "é"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=80), min_size=1, max_size=40))
def test_titles_of_anything(spark, titles):
    df = spark.createDataFrame([(t,) for t in titles], "x string")
    for r in df.select("x", text.session_title(F.col("x")).alias("t"), text.note_slug(F.col("x")).alias("s")).collect():
        assert r.t and len(r.t) <= 50 and not re.search(r'[/\\<>:"|?*\x00-\x1f]', r.t)
        assert r.s and len(r.s) <= 50 and all(c in "_-" or unicodedata.category(c)[0] in "LN" for c in r.s)


def test_names(spark):
    assert one(spark, text.session_title, "  fix the/bug: now.  ") == "fix-the-bug--now"
    assert one(spark, text.session_prefix, "Ab-9zz") == "ab_9" and one(spark, text.session_prefix, None) == "____"
    assert one(spark, text.base_name, "a/b/c.md") == "c" and one(spark, text.parent, "a/b/c.md") == "b"
    assert one(spark, text.flat_name, "sub/a/b.md") == "a-b.md" and one(spark, text.subdir, "x.md") == "root"
    assert one(spark, text.first_heading, "x\n#  Top \n# Two") == "Top"
    assert one(spark, lambda c: text.page_range(F.lit(1), F.lit(15)), "") == "001-015"
    assert one(spark, lambda c: text.cut(c, 3), "abcd") == "abc ... (truncated)"


def test_wikilinks(spark):
    body = "[[Page A]] [[Page B|alias]] [[Page A#sec]] [[ ]] [[x\ny]]"
    assert one(spark, text.wikilinks, body) == ["Page A", "Page B"]
    assert one(spark, text.link_targets, body) == ["Page A", "Page B", "Page A"]


def test_related_links_are_added_once(spark):
    add = lambda t: lambda c: text.append_related(c, F.lit(t))
    first = one(spark, add("B"), "# A\n\ntext")
    assert first == "# A\n\ntext\n\n## 関連ページ\n\n- [[B]]\n"
    assert one(spark, add("B"), first) == first
    second = one(spark, add("C$1"), first + "\n## Next\nmore")
    assert "- [[B]]\n- [[C$1]]\n" in second and second.endswith("\n## Next\nmore")


def test_snippet(spark):
    body = "a " * 100 + "needle\n in  hay " + "b " * 200
    got = one(spark, lambda c: text.snippet(c, "needle"), body)
    assert "needle in hay" in got and len(got) <= 200


DOC = '---\ntitle: "A \\"b\\" c"\ntags: [x, "y, z", \'w\']\nn: 12\nf: -1.5\non: true\nnothing: ~\n# comment\nquoted: \'it\'\'s # x\'\nplain: abc # rest\nurl: http://a#b\nn: 13\nbad line\n---\nBody\n'


def test_front_matter(spark):
    df = spark.createDataFrame([(DOC,)], "x string").select(fm.parse(F.col("x")).alias("m"), fm.body(F.col("x")).alias("b"))
    r = df.select("m", "b", fm.string(F.col("m"), "title").alias("title"), fm.strings(F.col("m"), "tags").alias("tags"), fm.string(F.col("m"), "quoted").alias("q"), fm.string(F.col("m"), "nothing").alias("none"), F.to_json(fm.typed(F.col("m")["n"])).alias("n"), F.to_json(fm.typed(F.col("m")["on"])).alias("on"), F.to_json(fm.typed(F.col("m")["tags"])).alias("t")).first()
    assert r.b == "Body\n" and r.title == 'A "b" c' and r.tags == ["x", "y, z", "w"] and r.q == "it's # x" and r.none is None
    assert r.m["n"] == "13" and r.m["plain"] == "abc" and r.m["url"] == "http://a#b"
    assert (r.n, r.on, r.t) == ("13", "true", '["x","y, z","w"]')
    assert one(spark, fm.body, "no front matter") == "no front matter" and one(spark, fm.parse, " ---\na: b\n---\n") == {}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cc", "Cs", "Zl", "Zp"]), max_size=30), min_size=1, max_size=30))
def test_front_matter_round_trip(spark, values):
    values = [v.strip("﻿᠎") for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    raw = fm.render({"k": fm.scalar(F.col("x"))}, F.lit("b"))
    got = df.select("x", fm.string(fm.parse(raw), "k").alias("y")).collect()
    assert [r.x for r in got] == [r.y if r.y is not None else "" for r in got]


def test_long_front_matter(spark):
    """Values far longer than a stack of expressions could hold, with quotes, escapes and number signs."""
    value = 'a "b" \\ # it\'s, ' * 20_000
    df = spark.createDataFrame([(value,)], "x string")
    raw = fm.render({"k": fm.scalar(F.col("x")), "l": fm.tag_list(F.array("x", "x"))}, F.lit("b"))
    r = df.select(fm.string(fm.parse(raw), "k").alias("k"), fm.strings(fm.parse(raw), "l").alias("l"), fm.string(fm.parse(F.concat(F.lit("---\nk: "), F.repeat(F.lit("ab "), F.lit(20_000)), F.lit("#c\n---\n"))), "k").alias("bare")).first()
    assert r.k == value and r.l == [value, value] and r.bare == "ab " * 19_999 + "ab"


def test_merge(spark):
    df = spark.createDataFrame([({"tags": "[a, b]", "t": "old", "n": "1"}, {"tags": "[b, c]", "t": "new", "n": "null"})], "o map<string,string>, n map<string,string>")
    assert df.select(fm.merge(F.col("o"), F.col("n")).alias("m")).first().m == {"tags": "[a, b, c]", "t": "new", "n": "1"}


def test_path_codes_are_those_of_calls(spark):
    from quillbase import kb
    from quillbase.functions import text as T

    def code(path):
        try:
            kb.checked_path(path)
        except kb.KBError as e:
            return e.code

    paths = ["", "a.md", "a/b c/ü_1.md", "/etc", "..", "../a", "a/..", "a/../..", "a/../../b", "./a//b", "a;b", "a\0b", "a\n", "x" * 512, "x" * 513, "a/b/../../../c/d/e"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.path_code(F.col("p")).alias("c")).collect()
    assert [(r.p, r.c) for r in rows] == [(p, code(p)) for p in paths]
    assert spark.range(1).select(T.path_code(F.lit(None).cast("string"))).first()[0] == "invalid_path"


def test_lint_reports(spark):
    from quillbase.plans import ingest

    rows = [(f"p{i}", "orphan", "") for i in range(5)] + [("q", "missing_link", "t")]
    got = ingest.lint_report(spark.createDataFrame(rows, "path string, kind string, detail string"), 3).orderBy("place").collect()
    assert [(r.kind, r.n) for r in got] == [("orphan", 5), ("missing_link", 1)]
    assert got[0].text == "## Orphan pages (5)\n\n- p0\n- p1\n- p2\n- and 2 more\n" and got[1].text == "## Missing links (1)\n\n- q: t\n"


def test_lint_report_takes_its_findings_once(spark):
    """Counts and first lines are of one stored table: what finds them runs once."""
    from quillbase.plans import ingest

    taken = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            taken.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"p{i}", "orphan", "") for i in range(20)], "path string, kind string, detail string").mapInArrow(seen, "path string, kind string, detail string")
    assert [(r.kind, r.n) for r in ingest.lint_report(rows, 3).collect()] == [("orphan", 20)]
    assert taken.value == 20


def test_front_matter_is_split_once(spark):
    """A file's lines, and a line's value, are computed once, not again for each line that may repeat a key."""
    from quillbase.functions import front_matter

    made = front_matter.parse(F.col("x"))
    assert made._jc.toString().count("split(") == 1
    lines = [f"k{i % 300}: v{i} # c" for i in range(600)]
    got = spark.createDataFrame([("---\n" + "\n".join(lines) + "\n---\nbody",), ("none",)], "x string").select(made.alias("m")).collect()
    assert got[0].m == {f"k{i}": f"v{i + 300}" for i in range(300)} and got[1].m == {}
