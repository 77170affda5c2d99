"""Text expressions: masking, names and titles, links, snippets. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import nfc, nfkc

# What counts as white space, as invisible, and the masking rules, in their order.
SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
INVISIBLE = r"[\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"
_S = f"[{SPACES}]"
MASKS = [
    (r"sk-ant-[A-Za-z0-9\-_]{20,}", "sk-ant-***"),
    (r"sk-proj-[A-Za-z0-9\-_]{20,}", "sk-proj-***"),
    (r"sk-[A-Za-z0-9]{20,}", "sk-***"),
    (r"ghp_[A-Za-z0-9]{20,}", "ghp_***"),
    (r"github_pat_[A-Za-z0-9_]{20,}", "github_pat_***"),
    (r"gho_[A-Za-z0-9]{20,}", "gho_***"),
    (r"ghu_[A-Za-z0-9]{20,}", "ghu_***"),
    (r"AIza[A-Za-z0-9\-_]{20,}", "AIza***"),
    (r"AKIA[A-Z0-9]{16}", "AKIA***"),
    (r"xox[baprs]-[A-Za-z0-9\-]{10,}", "xox*-***"),
    (r"vercel_[A-Za-z0-9\-_]{20,}", "vercel_***"),
    (r"npm_[A-Za-z0-9]{20,}", "npm_***"),
    (r"[spr]k_(?:live|test)_[A-Za-z0-9]{20,}", "stripe_***"),
    (r"sbp_[A-Za-z0-9]{20,}", "sbp_***"),
    (rf"(?i)private_key_id[\"']?{_S}*[:=]{_S}*[\"']?[a-f0-9]{{40}}", "private_key_id=***"),
    (rf"(?:SharedAccessKey|AccountKey){_S}*={_S}*[A-Za-z0-9+/=]{{20,}}", "AzureKey=***"),
    (rf"Bearer{_S}+[A-Za-z0-9\-._~+/=]+", "Bearer ***"),
    (rf"(?:Basic|Digest){_S}+[A-Za-z0-9+/=]{{10,}}", "Authorization ***"),
    (r"://[^:]+:[^@]+@", "://***:***@"),
    (rf"(?i)(password|passwd|secret|token|api[_\-]?key){_S}*[:=]{_S}*[\"']?([^{SPACES}\"'&]+)[\"']?", "$1=***"),
    (r"(?s)-----BEGIN [A-Z ]+PRIVATE KEY-----.+?-----END [A-Z ]+PRIVATE KEY-----", "<PRIVATE KEY REDACTED>"),
]
# Every match of a rule holds one of these, as written or (the last) in either case.
HEADS = ("sk-", "ghp_", "github_pat_", "gho_", "ghu_", "AIza", "AKIA", "xox", "vercel_", "npm_", "k_live_", "k_test_", "sbp_", "AccessKey", "AccountKey", "Bearer", "Basic", "Digest", "://", "PRIVATE KEY")
HEADS_ANY_CASE = r"(?i)p(?:rivate_key_id|assw(?:or)?d)|secret|token|api[_\-]?key"
# All that visible() or nfc() could change; far cheaper to look for than the characters that are invisible.
ODD = r"[^\x00-\u00ac\u00ae-\u02ff]"
RELATED = "関連ページ"


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode's included (trim() takes spaces only)."""
    return F.regexp_replace(text, rf"^[{SPACES}]+|[{SPACES}]+$", "")


def visible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def mask(text: Column) -> Column:
    """Secrets masked: invisible characters go, NFC, then the rules in order over the whole text.

    Texts without any rule's head skip the rules; finding the heads is far cheaper than running them.
    """
    plain = F.coalesce(nfc(F.when(F.regexp_like(text, F.lit(ODD)), visible(text))), text)
    # bound once: within a condition of the caller, Spark computes an expression again wherever it is named
    return F.transform(F.array(plain), _masked)[0]


def _masked(plain: Column) -> Column:
    suspect = F.regexp_like(plain, F.lit(HEADS_ANY_CASE))
    for head in reversed(HEADS):
        suspect = F.contains(plain, F.lit(head)) | suspect
    out = plain
    for pattern, put in MASKS:
        out = F.regexp_replace(out, pattern, put)
    return F.when(suspect, out).otherwise(plain)


def sanitize_source_type(text: Column) -> Column:
    return strip(nfc(visible(F.regexp_replace(text, r"[\x00-\x1f\x7f`$;&|]", ""))))


def session_title(text: Column, limit: int = 50) -> Column:
    """A prompt as part of a file name; `untitled` if nothing is left."""
    out = F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")
    out = nfc(F.regexp_replace(F.regexp_replace(out, r"[/\\]", "-"), r'[<>:"|?*]', "-"))
    out = F.regexp_replace(strip(F.regexp_replace(out, rf"[{SPACES}]+", " ")), " ", "-")
    ends = r"^[-.]+|[-.]+$"
    out = F.regexp_replace(out, ends, "")
    out = F.when(F.length(out) > limit, F.regexp_replace(F.left(out, F.lit(limit)), ends, "")).otherwise(out)
    return F.when(F.length(out) > 0, out).otherwise("untitled")


def session_prefix(session_id: Column) -> Column:
    head = F.regexp_replace(F.lower(F.left(F.coalesce(session_id, F.lit("")), F.lit(4))), r"[^a-z0-9]", "_")
    return F.when(F.length(head) > 0, head).otherwise("____")


def session_file(at: Column, session_id: Column, title: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), session_prefix(session_id), F.lit("-"), title, F.lit(".md"))


def note_slug(title: Column, limit: int = 50) -> Column:
    out = F.regexp_replace(nfkc(title), r"[^\p{L}\p{N}_-]+", "-")
    out = F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-+|-+$", "")
    out = F.left(out, F.lit(limit))
    return F.when(F.length(out) > 0, out).otherwise("untitled")


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.md$", "")


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(?:.*/)?([^/]+)/[^/]*$", 1)).otherwise("")


def path_code(path: Column, limit: int = 512) -> Column:
    """Why a path isn't one below its root: invalid_path, absolute_path or path_traversal; null if it is."""
    steps = F.transform(F.split(path, "/"), lambda x: F.when(x == "..", -1).when(x.isin(".", ""), 0).otherwise(1))
    deep = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.least(s["low"], s["at"] + x).alias("low")), lambda s: s["low"])
    bad = path.isNull() | (path == "") | (F.length(path) > limit) | F.contains(path, F.lit("\0"))
    unsafe = ~F.regexp_like(path, F.lit(r"^[\p{L}\p{N}/._ -]+\z"))
    return F.when(bad, "invalid_path").when(F.startswith(path, F.lit("/")), "absolute_path").when(unsafe, "invalid_path").when(deep < 0, "path_traversal")


def subdir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.split(path, "/", 2)[0]).otherwise("root")


def flat_name(path: Column) -> Column:
    """The path below its first folder, slashes as hyphens."""
    rest = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "^[^/]*/", "")).otherwise(path)
    return F.translate(rest, "/", "-")


def first_heading(text: Column) -> Column:
    return strip(F.regexp_extract(text, rf"(?m)^#[{SPACES}]+(.+)$", 1))


def tokens(query: str) -> list[str]:
    """A query's words, lower-cased; repeated words count each time."""
    return query.lower().split()


def hit_count(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    out = F.lit(0)
    for w in words:
        out = out + F.contains(low, F.lit(w)).cast("int")
    return out


def snippet(text: Column, first: str, before: int = 60, size: int = 200) -> Column:
    """`size` characters from a little before the first occurrence of a word, white space collapsed."""
    start = F.greatest(F.lit(1), F.instr(F.lower(text), first) - before)
    return strip(F.regexp_replace(F.substring(text, start, F.lit(size)), rf"[{SPACES}]+", " "))


def link_targets(text: Column) -> Column:
    """Every [[target]], without alias and section, repeats included."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]\n]+)\]\]"), 1)
    return F.filter(F.transform(found, lambda x: strip(F.regexp_extract(x, r"^([^|#]*)", 1))), lambda x: x != "")


def wikilinks(text: Column) -> Column:
    """Distinct targets in the order of their first occurrence."""
    return F.array_distinct(link_targets(text))


def append_related(text: Column, target: Column) -> Column:
    """text with a link to target under the heading for related pages, unless it links there already."""
    line = F.concat(F.lit("- [["), target, F.lit("]]"))
    heading = rf"(?m)^##[{SPACES}]+{RELATED}[{SPACES}]*$"
    section = rf"(?s)(##[{SPACES}]+{RELATED}[{SPACES}]*\n)(.*?)(?=\n##[{SPACES}]|\n*$)"
    before, at = F.regexp_extract(text, section, 1), F.regexp_instr(text, F.lit(section))
    body = F.regexp_replace(F.regexp_extract(text, section, 2), "\n+$", "")
    whole = F.length(F.regexp_extract(text, section, 0))
    put = F.concat(before, F.when(body != "", F.concat(body, F.lit("\n"))).otherwise(""), line, F.lit("\n"))
    in_section = F.concat(F.substring(text, F.lit(1), at - 1), put, F.substring(text, at + whole, F.length(text)))
    at_end = F.concat(text, F.when(F.endswith(text, F.lit("\n")), "").otherwise("\n"), F.lit(f"\n## {RELATED}\n\n"), line, F.lit("\n"))
    return F.when((target == "") | F.array_contains(wikilinks(text), target), text).when(F.regexp_like(text, F.lit(heading)), in_section).otherwise(at_end)


def quote_callout(text: Column) -> Column:
    return F.concat(F.lit("> "), F.regexp_replace(text, "\n", "\n> "))


def cut(text: Column, limit: int, marker: str = " ... (truncated)") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def safe_for_prompt(text: Column) -> Column:
    return F.translate(text, "`\n\r\\$", "?????")


def safe_for_error(text: Column) -> Column:
    clean = F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")
    return F.when(F.length(clean) > 100, F.concat(F.left(clean, F.lit(100)), F.lit("…"))).otherwise(clean)


def archive_stamp(at: Column) -> Column:
    return F.translate(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ":.", "--")


def page_range(first: Column, last: Column) -> Column:
    return F.format_string("%03d-%03d", first, last)


def json_quoted(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def yaml_single(text: Column) -> Column:
    """As it is if plain, else between single quotes with those inside doubled."""
    plain = F.regexp_like(text, F.lit(r"^[A-Za-z0-9_./][A-Za-z0-9_./ -]*$")) & ~F.endswith(text, F.lit(" "))
    return F.when(plain, text).otherwise(F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(text, "'", "''"), r"[\r\n]+", " "), F.lit("'")))


def dated_append(body: Column, day: Column, text: Column) -> Column:
    """A new section headed by a day, after the body's end."""
    return F.concat(F.regexp_replace(body, rf"[{SPACES}]+$", ""), F.lit("\n\n## "), day, F.lit("\n\n"), strip(text), F.lit("\n"))


def metadata_fence(**fields: Column) -> Column:
    """Untrusted metadata as a marked block; absent fields leave no line."""
    lines = [F.when(F.length(v) > 0, F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()]
    return F.concat(F.lit("```metadata (untrusted)\n"), F.concat_ws("\n", *lines), F.lit("\n```\n"))


def context(hot: Column, index: Column, hot_chars: int = 4000, index_chars: int = 10_000, hot_only: bool = False) -> Column:
    """What a session starts with: the hot cache, masked, then the index as it is."""
    short = mask(cut(hot, hot_chars))
    return short if hot_only else F.concat_ws("\n\n", F.when(F.length(short) > 0, short), F.when(F.length(index) > 0, cut(index, index_chars)))
