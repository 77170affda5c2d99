"""HTML: sanitised, its article as Markdown, its images. One pass of the standard library's parser in a pandas UDF."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements removed with all they hold, attributes that can run code, and addresses that must not stay.
DANGEROUS = frozenset("script iframe object embed frame frameset meta base link".split())
ADDRESSES = frozenset("href src action formaction".split())
BAD_SCHEMES = ("javascript:", "data:text/html", "vbscript:", "file:")
#: Shorter articles need another way to be read.
MIN_TEXT = 300
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
_LEAVE_OUT = frozenset("nav header footer aside form style noscript template button select svg".split()) | DANGEROUS
_BLOCKS = frozenset("p div section article main ul ol table blockquote pre figure h1 h2 h3 h4 h5 h6 tr".split())


class Node:
    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs=()):
        self.tag, self.attrs, self.parts = tag, dict(attrs), []

    def text(self) -> str:
        """The text of all that isn't left out, iteratively, since pages nest deeply."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in _LEAVE_OUT:
                todo += reversed(x.parts)
        return "".join(out)

    def all(self):
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo += [y for y in reversed(x.parts) if isinstance(y, Node)]


class _Tree(HTMLParser):
    """Elements in a tree; a closing tag closes what is open within, one without an opening is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, [(k, v or "") for k, v in attrs])
        self.open[-1].parts.append(node)
        if tag not in _EMPTY:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].parts.append(Node(tag, [(k, v or "") for k, v in attrs]))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def clean(root: Node) -> Node:
    """Dangerous elements and attributes removed, in place."""
    for node in root.all():
        node.parts = [x for x in node.parts if isinstance(x, str) or x.tag not in DANGEROUS]
        node.attrs = {k: v for k, v in node.attrs.items() if not k.lower().startswith("on") and not (k.lower() in ADDRESSES and v.strip().lower().startswith(BAD_SCHEMES))}
    return root


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def write(root: Node) -> str:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.tag:
            todo += [escape(y) if isinstance(y, str) else y for y in reversed(x.parts)]
        else:
            attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in x.attrs.items())
            out.append(f"<{x.tag}{attrs}>")
            if x.tag not in _EMPTY:
                escaped = x.tag not in ("style", "script")
                todo.append(f"</{x.tag}>")
                todo += [escape(y) if isinstance(y, str) and escaped else y for y in reversed(x.parts)]
    return "".join(out)


def article_node(root: Node) -> Node:
    """The element most likely to hold the article: paragraphs' text counts, links' text counts against.

    Lengths are added up from the leaves, once for each element.
    """
    nodes = list(root.all())
    size: dict[int, int] = {}
    links: dict[int, int] = {}
    for node in reversed(nodes):  # what is within comes first
        inner = [x for x in node.parts if isinstance(x, Node)]
        size[id(node)] = 0 if node.tag in _LEAVE_OUT else sum(len(x) for x in node.parts if isinstance(x, str)) + sum(size[id(x)] for x in inner)
        links[id(node)] = size[id(node)] * (node.tag == "a") + sum(links[id(x)] for x in inner)
    best, top = root, -1.0
    for node in nodes:
        if node.tag in ("article", "main", "body", "div", "section", "td", ""):
            own = sum(size[id(p)] for p in node.parts if isinstance(p, Node) and p.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "h2", "h3"))
            score = (own - 0.5 * links[id(node)]) * (1.5 if node.tag in ("article", "main") else 1.0)
            if score > top:
                best, top = node, score
    return best


def _inline(node, depth: int = 0) -> str:
    """Text with marks; below a depth that no honest page has, text alone."""
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    if node.tag in _LEAVE_OUT:
        return ""
    if depth > 150:
        return re.sub(r"\s+", " ", node.text())
    if node.tag == "br":
        return "  \n"
    if node.tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})" if node.attrs.get("src") else ""
    inner = "".join([_inline(x, depth + 1) for x in node.parts])
    if node.tag in ("em", "i") and inner.strip():
        return f"*{inner.strip()}*"
    if node.tag in ("strong", "b") and inner.strip():
        return f"**{inner.strip()}**"
    if node.tag == "code" and inner.strip():
        return f"`{inner.strip()}`"
    if node.tag == "a" and node.attrs.get("href") and inner.strip():
        return f"[{inner.strip()}]({node.attrs['href']})"
    return inner


def _table(node: Node) -> str:
    rows = [[_inline(c).strip().replace("|", "\\|") for c in r.parts if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.all() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def markdown(node: Node, depth: int = 0) -> str:
    """ATX headings, fenced code, hyphen bullets, asterisks, tables; blocks a blank line apart."""
    blocks: list[str] = []
    run: list[str] = []

    def flush():
        text = "".join(run).strip()
        if text:
            blocks.append(text)
        run.clear()

    for x in node.parts:
        if isinstance(x, str) or x.tag not in _BLOCKS and x.tag not in ("hr", "body", "html"):
            if isinstance(x, Node) and depth < 100 and any(y.tag in _BLOCKS for y in x.all()) and x.tag not in _LEAVE_OUT:
                flush()
                blocks.append(markdown(x, depth + 1))
            else:
                run.append(_inline(x))
            continue
        flush()
        if x.tag[:1] == "h" and x.tag[1:].isdigit():
            text = _inline(x).strip()
            if text:
                blocks.append("#" * int(x.tag[1]) + " " + text)
        elif x.tag == "pre":
            code = next((y for y in x.all() if y.tag == "code"), x)
            language = re.search(r"language-([\w+-]+)", code.attrs.get("class", ""))
            blocks.append(f"```{language[1] if language else ''}\n{code.text().strip(chr(10))}\n```")
        elif x.tag in ("ul", "ol"):
            items = [y for y in x.parts if isinstance(y, Node) and y.tag == "li"]
            marks = [f"{i}. " if x.tag == "ol" else "- " for i in range(1, len(items) + 1)]
            blocks.append("\n".join(m + markdown(y, depth + 1).replace("\n\n", "\n").replace("\n", "\n" + " " * len(m)) if depth < 100 else m + y.text().strip() for m, y in zip(marks, items, strict=True)))
        elif x.tag == "blockquote":
            blocks.append("\n".join("> " + y if y else ">" for y in markdown(x, depth + 1).split("\n")) if depth < 100 else x.text())
        elif x.tag == "table":
            blocks.append(_table(x))
        elif x.tag == "hr":
            blocks.append("---")
        else:
            blocks.append(markdown(x, depth + 1) if depth < 100 else x.text().strip())
    flush()
    return "\n\n".join(b for b in blocks if b.strip())


def _article(html: str | None) -> dict:
    root = clean(parse(html))
    body = next((n for n in root.all() if n.tag == "body"), root)
    title = next((n for n in root.all() if n.tag == "title"), None)
    heading = next((n for n in body.all() if n.tag == "h1"), None)
    node = article_node(body)
    text = re.sub(r"\s+", " ", node.text()).strip()
    byline = next((n.text().strip() for n in body.all() if "byline" in n.attrs.get("class", "") or n.attrs.get("rel") == "author"), None)
    images = [{"src": n.attrs["src"], "alt": n.attrs.get("alt", "")} for n in node.all() if n.tag == "img" and n.attrs.get("src")]
    name = re.sub(r"\s+", " ", (title or heading or Node("")).text()).strip()
    # the sanitiser takes meta elements away first, so what they could say is always absent
    return {"title": name, "markdown": markdown(node), "text": text, "byline": byline, "site_name": None, "published_time": None, "og_image": None, "needs_fallback": len(text) < MIN_TEXT, "images": images}


_FIELDS = ("title", "markdown", "text", "byline", "site_name", "published_time", "og_image")
_ARTICLE = T.StructType([T.StructField(f, T.StringType()) for f in _FIELDS]).add("needs_fallback", T.BooleanType()).add("images", T.ArrayType(T.StructType().add("src", T.StringType()).add("alt", T.StringType())))


def _articles(fields: list[str]):
    def articles(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_article(x) for x in html], columns=fields)

    return articles


def _sanitized(html: pd.Series) -> pd.Series:
    def one(x):
        root = clean(parse(x))
        body = next((n for n in root.all() if n.tag == "body"), None)
        inner = Node("")
        inner.parts = (body or root).parts
        return write(inner)

    return html.map(one)


def article(html: Column, *fields: str) -> Column:
    """A struct of the article: title, markdown, text, byline, needs_fallback, images; only the fields named, if any are."""
    kept = T.StructType([f for f in _ARTICLE if not fields or f.name in fields])
    return F.pandas_udf(_articles(kept.names), kept)(html)


def sanitize(html: Column) -> Column:
    return F.pandas_udf(_sanitized, T.StringType())(html)


def anchors(html: Column) -> Column:
    """The href of each anchor, as written between double quotes."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), 1)


def rewrite_images(text: Column, places: Column) -> Column:
    """Markdown with image addresses that are keys of a map replaced by its values; titles stay."""
    return F.aggregate(F.map_entries(places), text, lambda t, e: F.replace(F.replace(t, F.concat(F.lit("]("), e["key"], F.lit(")")), F.concat(F.lit("]("), e["value"], F.lit(")"))), F.concat(F.lit("]("), e["key"], F.lit(' "')), F.concat(F.lit("]("), e["value"], F.lit(' "'))))
