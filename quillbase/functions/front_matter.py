"""Flat YAML front matter: a map of raw values, typed values on demand, merge and rendering. Built-ins only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, json_quoted, strip

_BLOCK = r"^---\r?\n([\s\S]*?)\r?\n---\r?\n?"


def block(text: Column) -> Column:
    """The lines between the markers; empty without front matter at the very start."""
    return F.regexp_extract(text, _BLOCK, 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, _BLOCK, "")


def _value(line: Column) -> Column:
    # bound once, since the line can be long
    return F.transform(F.array(strip(F.regexp_replace(line, "^[^:]*:", ""))), _bare)[0]


def _bare(value: Column) -> Column:
    # a comment begins at " #" unless that is inside quotes; found piece by piece, since a loop over alternatives
    # within one expression runs out of stack on long values
    hidden = F.when(F.startswith(value, F.lit('"')) | F.startswith(value, F.lit("[")), F.regexp_replace(value, r"\\.", "__")).otherwise(value)
    last = F.try_element_at(F.regexp_extract_all(hidden, F.lit(r""""[^"]*"?|'[^']*'?| #.*$|[^"' ]+|."""), 0), F.lit(-1))
    bare = F.when(F.startswith(last, F.lit(" #")), strip(F.left(value, F.length(value) - F.length(last)))).otherwise(value)
    return F.when(F.contains(value, F.lit(" #")), bare).otherwise(value)


def parse(text: Column) -> Column:
    """map<string, string> of raw values; of repeated keys the last one counts."""
    lines = F.transform(F.split(block(text), r"\r?\n"), lambda x: F.regexp_replace(x, rf"[{SPACES}]+$", ""))
    lines = F.filter(lines, lambda x: (x != "") & ~F.regexp_like(x, F.lit(rf"^[{SPACES}]*#")) & F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.regexp_extract(x, "^([^:]*):", 1)).alias("key"), _value(x).alias("value")))
    pairs = F.filter(pairs, lambda p: p["key"] != "")
    # the last place of each key; pairs are bound by a transform, since an expression named twice is computed twice, and within a lambda for each element
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.greatest(F.size(ps), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(F.array(pairs), last)[0])


def unquoted(value: Column) -> Column:
    double = F.regexp_like(value, F.lit(r'(?s)^".*"$')) & (F.length(value) >= 2)
    single = F.regexp_like(value, F.lit(r"(?s)^'.*'$")) & (F.length(value) >= 2)
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    from_json = F.get_json_object(F.concat(F.lit('{"x":'), value, F.lit("}")), "$.x")
    return F.when(double, F.coalesce(from_json, inner)).when(single, F.regexp_replace(inner, "''", "'")).otherwise(value)


def string(fields: Column, key: str) -> Column:
    """A field as text; null if absent, empty, null or ~."""
    raw = fields[key]
    return F.when(~raw.isin("", "null", "~"), unquoted(raw))


def strings(fields: Column, key: str) -> Column:
    """A field like [a, "b, c"] as an array; a plain value is an array of one."""
    raw = fields[key]
    inner = strip(F.regexp_extract(raw, r"(?s)^\[(.*)\]$", 1))
    # escapes are put aside while the items are found
    aside = F.replace(F.replace(inner, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    back = lambda x: F.replace(F.replace(x, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    parts = F.regexp_extract_all(aside, F.lit(r"""\s*("[^"]*"|'[^']*'|[^,]+)\s*"""), 1)
    listed = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(parts, lambda x: unquoted(strip(back(x)))))
    return F.when(F.regexp_like(raw, F.lit(r"(?s)^\[.*\]$")), listed).otherwise(F.when(string(fields, key).isNotNull(), F.array(string(fields, key))))


def kind(value: Column) -> Column:
    """The type that a raw value stands for."""
    like = lambda p: F.regexp_like(value, F.lit(p))
    return F.when(value.isin("", "null", "~"), "null").when(value.isin("true", "false"), "bool").when(like(r"^-?\d+$"), "int").when(like(r"^-?\d+\.\d+$"), "float").when(like(r"(?s)^\[.*\]$"), "list").otherwise("string")


def typed(value: Column) -> Column:
    """A raw value as a variant of the type that it stands for."""
    quoted = json_quoted(unquoted(value))
    k = kind(value)
    number = F.regexp_replace(value, r"^(-?)0+(?=\d)", "$1")
    text = F.when(k == "null", F.lit("null")).when(k == "bool", value).when(k.isin("int", "float"), number).when(k == "list", F.to_json(strings(F.create_map(F.lit("x"), value), "x"))).otherwise(quoted)
    return F.try_parse_json(text)


def merge_lists(old: Column, new: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))))


def merge(old: Column, new: Column) -> Column:
    """Raw maps merged: a new value wins unless it is null-like, two lists become their union."""
    empty = F.create_map().cast("map<string,string>")
    both = F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, a, b: _merged(a, b))
    return both


def _merged(a: Column, b: Column) -> Column:
    lists = F.regexp_like(a, F.lit(r"(?s)^\[.*\]$")) & F.regexp_like(b, F.lit(r"(?s)^\[.*\]$"))
    one = lambda v: strings(F.create_map(F.lit("x"), v), "x")
    union = F.concat(F.lit("["), F.array_join(F.transform(merge_lists(one(a), one(b)), list_item), ", "), F.lit("]"))
    return F.when(lists, union).when(b.isNotNull() & ~b.isin("", "null", "~"), b).otherwise(F.coalesce(a, b))


def list_item(x: Column) -> Column:
    return F.when(F.regexp_like(x, F.lit(rf"""[,\[\]"'#:]|^[{SPACES}]|[{SPACES}]$|^$""")), json_quoted(x)).otherwise(x)


def scalar(x: Column) -> Column:
    """A string as a value that reads back as the same string."""
    risky = F.regexp_like(x, F.lit(rf"""^$|^[{SPACES}\[\]{{}}"'#&*!|>%@`-]|: |\s#|[{SPACES}]$|:$|[\n\r]""")) | (kind(x) != "string")
    return F.when(risky, json_quoted(x)).otherwise(x)


def render(fields: dict[str, Column], text: Column) -> Column:
    """Front matter of raw values (null ones left out) before a body."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.regexp_replace(text, "^\n", ""))


def tag_list(tags: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(tags, list_item), ", "), F.lit("]"))
