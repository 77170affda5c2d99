import io
import json
import subprocess
import zipfile

from pyspark.sql import functions as F

from quillbase.config import KBConfig
from quillbase.sources import archives, files, tail
from quillbase.streaming import sessions


def zipped(entries, **kw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **kw) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


EPUB = {
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/a.opf"/></rootfiles></container>',
    "OEBPS/a.opf": '<package xmlns:dc="x"><metadata><dc:title>Book</dc:title><dc:creator>Who</dc:creator></metadata><manifest><item id="1" href="one.xhtml"/><item id="2" href="none.xhtml"/><item id="3" href="t%20wo.xhtml"/></manifest><spine><itemref idref="1"/><itemref idref="2"/><itemref idref="3"/></spine></package>',
    "OEBPS/one.xhtml": "<html><body><h1>One</h1><p>Text</p></body></html>",
    "OEBPS/t wo.xhtml": "<p>Two</p>",
}
W = 'xmlns:w="http://w"'
DOCX = {
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>',
    "docProps/core.xml": '<c xmlns:dc="d"><dc:title>Doc</dc:title><dc:subject>S</dc:subject></c>',
}


def test_archives(spark):
    doctype = {**EPUB, "OEBPS/a.opf": "<!DOCTYPE x><package/>"}
    rows = [("a.epub", zipped(EPUB)), ("b.docx", zipped(DOCX)), ("c.epub", b"not a zip"), ("d.epub", zipped({"../evil": "x"})), ("e.epub", zipped(doctype)), ("f.epub", zipped({f"n{i}": "" for i in range(30)})), ("g.docx", zipped({**DOCX, "word/embeddings/o.bin": "x"})), ("h.txt", b""), ("i.epub", None), ("j.epub", zipped({"big": "x" * 2000}))]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    got = archives.chapters(df, KBConfig(archive_max_entries=20, archive_max_entry=1000)).collect()
    by = {}
    for r in got:
        by.setdefault(r.path, []).append(r)
    assert [(r.chapter_index, r.chapter_total, r.text, r.title, r.author) for r in by["a.epub"]] == [(1, 3, "# One\n\nText", "Book", "Who"), (3, 3, "Two", "Book", "Who")]
    assert by["b.docx"][0].text == "# Top\n\na\tb" and by["b.docx"][0].subject == "S"
    assert {p: r[0].status for p, r in by.items()} == {"a.epub": "extracted", "b.docx": "extracted", "c.epub": "bad_archive", "d.epub": "zip_slip", "e.epub": "doctype", "f.epub": "too_many_entries", "g.docx": "extracted_with_embeddings", "i.epub": "bad_archive", "j.epub": "entry_too_large"}


def test_pages(spark, tmp_path):
    (tmp_path / "wiki/a").mkdir(parents=True)
    (tmp_path / "wiki/a/x.md").write_text('---\ntitle: X\ntags: [p, q]\ntype: concept\n---\nbody [[y]]\n')
    (tmp_path / "wiki/y.md").write_text("# Why\ntext")
    (tmp_path / "wiki/no.txt").write_text("no")
    got = {r.path: r for r in files.pages(spark, str(tmp_path)).collect()}
    assert set(got) == {"wiki/a/x.md", "wiki/y.md"}
    x, y = got["wiki/a/x.md"], got["wiki/y.md"]
    assert (x.title, x.tags, x.type, x.folder, x.body) == ("X", ["p", "q"], "concept", "a", "body [[y]]\n") and (y.title, y.tags) == ("Why", [])


def test_commits(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=N", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for n in range(3):
        (tmp_path / f"p{n}.md").write_text(f"v{n}")
        git("add", ".")
        git("commit", "-qm", f"change {n}")
    got = files.commits(spark, str(tmp_path), max_commits=2).collect()
    assert len(got) == 2 and {r.subject for r in got} <= {"change 0", "change 1", "change 2"} and all(len(r.files) == 1 for r in got)
    assert {r.path: r.raw for r in files.pages_at(spark, str(tmp_path), got[0].sha).collect()}["p0.md"] == "v0"


def test_hook_events(spark):
    lines = ['{"session_id":"s","hook_event_name":"Stop","tool_input":{"command":"ls"}}', "{bad", '{"hook_event_name":"Stop"}', '{"session_id":"s","hook_event_name":"Other"}']
    assert files.hook_events(spark.createDataFrame([(x,) for x in lines], "value string")).count() == 1


def test_tail(spark, tmp_path):
    say = lambda t: json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": t}, {"type": "tool", "text": None}]}})
    log, out = tmp_path / "in/a.jsonl", str(tmp_path / "out")
    log.parent.mkdir()

    def step():
        q = tail.tail(spark, str(log.parent)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start()
        q.awaitTermination()
        return sorted(r.text for r in files.assistant_text(spark.read.schema("path string, offset long, line string").parquet(out)).collect())

    log.write_text(say("one") + "\n" + say("two")[:10])
    assert step() == ["one"]
    log.write_text(say("one") + "\n" + say("two") + "\nnot json\n")
    assert step() == ["one", "two"]
    log.write_text(say("new") + "\n")  # shorter than before: read from its start
    assert step() == ["new", "one", "two"]


def test_sessions(spark):
    rows = [("s", 1, "SessionEnd", None, None, None, None), ("s", 2, "UserPromptSubmit", " ", None, None, None), ("s", 3, "UserPromptSubmit", "Fix: it", None, None, None), ("s", 4, "PostToolUse", None, "Bash", "ls | grep x", None), ("s", 5, "PostToolUse", None, "Bash", "A=1 make all", None), ("s", 6, "PostToolUse", None, "Edit", None, "f.py"), ("s", 7, "Stop", None, None, None, None), ("s", 8, "PostToolUse", None, "Other", None, None), ("ghost", 1, "Stop", None, None, None, None)]
    df = spark.createDataFrame(rows, "session_id string, seq long, hook_event_name string, prompt string, tool_name string, command string, file_path string")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("seq"))).withColumn("text", F.when(F.col("seq") == 7, "done")).withColumn("stdout", F.lit("x" * 3000)).withColumn("exit_reason", F.lit(None).cast("string"))
    (r,) = sessions.rollup(df).collect()
    assert (r.session_id, r.file, r.prompts, r.turns, r.commands, r.edits, r.ended) == ("s", "20240101-000003-s-Fix--it.md", 1, 1, 1, 1, None)
    blocks = {r.seq: r.b for r in df.select("seq", "session_id", sessions.block(df).alias("b")).where("session_id = 's'").collect()}
    assert blocks[3] == "\n## User\n\nFix: it\n" and blocks[4] is None and blocks[5].startswith("> [!terminal]\n> $ A=1 make all\n> xxx") and "(truncated)" in blocks[5]
    assert blocks[6] == "> [!file]\n> Edit: f.py\n" and blocks[7] == "\n## Assistant\n\ndone\n" and blocks[8] is None
