"""Declarative dashboard views: filters, a formula, columns, grouping and limits, as one plan each.

A view file lists, in its order, the columns to show; it leaves sorting to the viewer, so ours sort by age (where they
show it) and then by name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.pages import in_folder, page_names, with_age

_FOLDER = re.compile(r'^file\.inFolder\("([^"]*)"\)$')
_COMPARE = re.compile(r'^([\w.]+)\s*(==|!=|>=|<=|>|<)\s*(?:"([^"]*)"|(-?\d+))$')
_COLUMNS = {"file.name": "name", "file.ext": "ext", "file.path": "path", "file.mtime": "mtime", "formula.age_days": "age_days"}


def column_of(name: str) -> str:
    return _COLUMNS.get(name, name.removeprefix("note.").removeprefix("formula."))


def condition(spec) -> Column:
    """A filter: an expression, or {and|or|not: [filters]}."""
    if spec is None:
        return F.lit(True)
    if isinstance(spec, dict):
        out = None
        for kind, inner in spec.items():
            parts = [condition(x) for x in (inner if isinstance(inner, list) else [inner])]
            both = parts[0]
            for p in parts[1:]:
                both = both | p if kind == "or" else both & p
            both = ~both if kind == "not" else both
            out = both if out is None else out & both
        return F.lit(True) if out is None else out
    text = spec.strip()
    if text.startswith("!"):
        return ~condition(text[1:])
    if m := _FOLDER.match(text):
        return in_folder(m[1])
    if m := _COMPARE.match(text):
        left, right = F.col(column_of(m[1])), F.lit(m[3]) if m[3] is not None else F.lit(int(m[4]))
        return {"==": left.eqNullSafe(right), "!=": ~left.eqNullSafe(right), ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[m[2]]
    raise ValueError(f"not a filter of a view: {spec}")


@dataclass(frozen=True)
class View:
    name: str
    columns: tuple[str, ...]
    filters: object = None
    limit: int | None = None
    group: str | None = None


#: The nine views of the dashboard, and what all of them leave out.
EVERYWHERE = {"and": ['file.inFolder("wiki")', 'file.ext == "md"', '!file.inFolder("wiki/summaries")']}
DASHBOARD = (
    View("hot_cache", ("name", "updated", "age_days"), 'file.name == "hot"', 5),
    View("active_projects", ("name", "updated", "tech_stack"), {"and": ['file.inFolder("wiki/projects")', 'status == "active"']}),
    View("recent_activity", ("age_days", "name", "type", "status"), None, 20, "type"),
    View("concepts", ("name", "updated", "age_days"), 'file.inFolder("wiki/concepts")'),
    View("decisions", ("age_days", "name"), 'file.inFolder("wiki/decisions")'),
    View("analyses", ("age_days", "name"), 'file.inFolder("wiki/analyses")'),
    View("patterns", ("age_days", "name"), 'file.inFolder("wiki/patterns")'),
    View("bugs", ("age_days", "name"), 'file.inFolder("wiki/bugs")'),
    View("stale", ("age_days", "name"), "formula.age_days > 30", 15),
)


def evaluate(pages: DataFrame, view: View, now: Column, everywhere=EVERYWHERE) -> DataFrame:
    """pages: path, mtime and the properties that the view names."""
    src = page_names(with_age(pages, now)).withColumn("ext", F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = src.where(condition(everywhere)).where(condition(view.filters))
    order = (["age_days"] if "age_days" in view.columns else []) + ["name", "path"]
    if view.limit is not None:
        rows = rows.orderBy(*order).limit(view.limit)
    order = [view.group, *order] if view.group else order
    return rows.orderBy(*order).select(*view.columns)


def parse_views(spec: dict) -> tuple[View, ...]:
    """Views of a dashboard file, as read by a YAML parser."""
    out = []
    for v in spec.get("views", []):
        group = v.get("groupBy") or {}
        out.append(View(v["name"], tuple(column_of(c) for c in v.get("order", ["file.name"])), v.get("filters"), v.get("limit"), column_of(group["property"]) if group else None))
    return tuple(out)
