"""Settings that change results; passed explicitly, never read from the environment inside a task."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class KBConfig:
    refresh_days: int | None = 30  # None: never
    html_max_bytes: int = 5 << 20
    pdf_max_bytes: int = 50 << 20
    image_max_bytes: int = 20 << 20
    image_min_bytes: int = 200
    chunk_pages: int = 15
    chunk_overlap: int = 1
    soft_max_pages: int = 500
    hard_max_pages: int = 1000
    archive_max_entries: int = 5000
    archive_max_total: int = 200_000_000
    archive_max_entry: int = 50_000_000
    read_max_bytes: int = 262_144
    list_max_entries: int = 1000
    list_max_depth: int = 5
    search_head_bytes: int = 8192
    search_max_hits: int = 50
    reference_max_bytes: int = 2_000_000
    stdout_chars: int = 2000
    hot_chars: int = 4000
    index_chars: int = 10_000
    ignore_robots: bool = False
    #: True truncates before masking and counts a future fetch time as fresh, as the reference behaviour has it.
    lenient: bool = True


def unsafe_settings(config: KBConfig, allow_loopback: bool = False) -> list[str]:
    """Names of the alerts that settings meant for tests raise elsewhere."""
    return [name for name, on in (("ignore-robots", config.ignore_robots), ("allow-loopback", allow_loopback)) if on]


def truthy(value: str | None) -> bool:
    return (value or "").strip().lower() in ("1", "true", "yes", "on")


def positive_int(value: str | None, fallback: int) -> int:
    text = (value or "").strip()
    return int(text) if text.isdigit() and int(text) > 0 else fallback


def check_refresh_days(value) -> int | str:
    """An integer from 1 to 3650 or 'never'."""
    if value == "never":
        return value
    if isinstance(value, int) and not isinstance(value, bool) and 1 <= value <= 3650:
        return value
    raise ValueError("refresh_days: an integer from 1 to 3650, or 'never'")


def check_search(query: str, limit: int = 10, mode: str = "hybrid") -> tuple[str, int, str]:
    if not isinstance(query, str) or not 1 <= len(query) <= 500:
        raise ValueError("query: 1 to 500 characters")
    if mode not in ("lex", "vec", "hybrid"):
        raise ValueError("mode: lex, vec or hybrid")
    return query, max(1, min(50, int(limit))), mode


#: Queries over fixed tables use this instead of the clock.
AS_OF = dt.datetime(2024, 12, 31)
