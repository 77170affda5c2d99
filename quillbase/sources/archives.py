"""EPUB and DOCX archives as rows: checked entries, chapters, metadata. One archive is one row of binaryFile."""

from __future__ import annotations

import io
import posixpath
import re
import unicodedata
import xml.etree.ElementTree as ET
import zipfile
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import KBConfig
from ..functions import html as H

_FORBIDDEN = re.compile(r"<!DOCTYPE\b|<!ENTITY\b", re.I)
_CONTROL = re.compile(r"[\x00-\x1f\x7f\u202a-\u202e\u2066-\u2069]")


class ArchiveError(ValueError):
    """code says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def name_problem(name: str) -> str | None:
    if not name or len(name) > 1024:
        return "bad_length"
    if _CONTROL.search(name):
        return "control_or_bidi"
    if unicodedata.normalize("NFKC", name) != name:
        return "not_nfkc"
    normal = posixpath.normpath(name.replace("\\", "/"))
    if name.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", name) or normal == ".." or normal.startswith("../"):
        return "zip_slip"
    return None


def expand(content: bytes, config: KBConfig) -> dict[str, bytes]:
    """Entries by name; the first one that breaks a limit fails the archive. Archives within are left out."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise ArchiveError("bad_archive") from None
    infos = z.infolist()
    if len(infos) > config.archive_max_entries:
        raise ArchiveError("too_many_entries")
    out, total = {}, 0
    for info in infos:
        if info.is_dir():
            continue
        if problem := name_problem(info.filename):
            raise ArchiveError(problem)
        if info.external_attr >> 28 == 0xA:
            raise ArchiveError("symlink")
        if info.flag_bits & 1:
            raise ArchiveError("encrypted")
        with z.open(info) as source:
            data = source.read(config.archive_max_entry + 1)
        total += len(data)
        if len(data) > config.archive_max_entry:
            raise ArchiveError("entry_too_large")
        if total > config.archive_max_total:
            raise ArchiveError("archive_too_large")
        if not data.startswith(b"PK\x03\x04"):
            out[info.filename] = data
    return out


def xml(data: bytes | None) -> ET.Element:
    if data is None:
        raise ArchiveError("missing_part")
    text = data.decode("utf-8", "replace")
    if _FORBIDDEN.search(text):
        raise ArchiveError("doctype")
    try:
        return ET.fromstring(re.sub(r"^\ufeff?\s*<\?xml[^>]*\?>", "", text))
    except ET.ParseError:
        raise ArchiveError("bad_xml") from None


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _first(root: ET.Element, name: str, limit: int = 200) -> str | None:
    return next(((e.text or "").strip()[:limit] for e in root.iter() if _local(e) == name and (e.text or "").strip()), None)


def epub_chapters(content: bytes, config: KBConfig) -> list[dict]:
    entries = expand(content, config)
    root = next((e.get("full-path") for e in xml(entries.get("META-INF/container.xml")).iter() if _local(e) == "rootfile"), None)
    opf = xml(entries.get(root or ""))
    manifest = {e.get("id"): e.get("href") for e in opf.iter() if _local(e) == "item"}
    spine = [manifest.get(e.get("idref")) for e in opf.iter() if _local(e) == "itemref"]
    title, author = _first(opf, "title"), _first(opf, "creator")
    out = []
    for n, href in enumerate(spine, 1):  # a chapter that is missing leaves a gap in the numbers
        path = unquote(href.split("#")[0]) if href else ""
        data = entries.get(posixpath.normpath(posixpath.join(posixpath.dirname(root), path)), entries.get(path)) if href else None
        if data is not None:
            text = H.markdown(H.clean(H.parse(data.decode("utf-8", "replace"))))
            if text.strip():
                out.append({"chapter_index": n, "chapter_total": len(spine), "chapter_href": href, "title": title, "author": author, "subject": None, "text": text, "status": "extracted"})
    return out


def docx_text(content: bytes, config: KBConfig) -> list[dict]:
    entries = expand(content, config)
    body = xml(entries.get("word/document.xml"))
    core = xml(entries["docProps/core.xml"]) if "docProps/core.xml" in entries else ET.Element("none")
    lines = []
    for p in (e for e in body.iter() if _local(e) == "p"):
        style = next((v for e in p.iter() if _local(e) == "pStyle" for k, v in e.attrib.items() if k.endswith("val")), "")
        text = "".join((e.text or "") if _local(e) == "t" else {"tab": "\t", "br": "\n"}.get(_local(e), "") for e in p.iter())
        level = re.fullmatch(r"Heading([1-6])", style)
        listed = any(_local(e) == "numPr" for e in p.iter())
        if text.strip():
            lines.append("#" * int(level[1]) + " " + text.strip() if level else "- " + text.strip() if listed else text.strip())
    embedded = any(n.startswith("word/embeddings/") for n in entries)
    status = "extracted_with_embeddings" if embedded else "extracted"
    return [{"chapter_index": 1, "chapter_total": 1, "chapter_href": "word/document.xml", "title": _first(core, "title"), "author": _first(core, "creator"), "subject": _first(core, "subject"), "text": "\n\n".join(lines), "status": status}]


_SCHEMA = "path string, source_sha256 string, chapter_index int, chapter_total int, chapter_href string, title string, author string, subject string, text string, status string"


def chapters(files: DataFrame, config: KBConfig | None = None) -> DataFrame:
    """files (path, content) of .epub and .docx as chapters; an archive that fails is one row with its status."""
    config = config or KBConfig()

    from pyspark.sql.pandas.types import to_arrow_type

    fields = T._parse_datatype_string(_SCHEMA).fields
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def run(batches):
        for batch in batches:
            rows = []
            for path, content, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                read = epub_chapters if path.lower().endswith(".epub") else docx_text
                try:
                    found = read(content or b"", config)
                    rows += [{"path": path, "source_sha256": sha, **c} for c in found] or [{"path": path, "source_sha256": sha, "status": "empty"}]
                except ArchiveError as e:
                    rows.append({"path": path, "source_sha256": sha, "status": e.code})
            yield pa.RecordBatch.from_pylist(rows, schema)

    wanted = files.where(F.regexp_like("path", F.lit(r"(?i)\.(epub|docx)$")))
    return wanted.select("path", "content", F.sha2("content", 256).alias("sha")).mapInArrow(run, _SCHEMA)


def reader_of(path):
    """Which reader a file goes to, by its suffix: pdf (also without one), md, epub, docx, or null."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix == "", "pdf").when(suffix.isin("pdf", "md", "epub", "docx"), suffix)
