"""Operator 4, benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of any character beyond ASCII. Each item gives
its windows of WINDOW words, or all its words where it has fewer; the windows, as numbers of words, are the patterns of one
automaton. Its states are arrays: sorted edges (state, word), failure links, and links to the next pattern that ends in
a state; a state is some 16 bytes. A document, normalised alike, is scanned once, whole: all texts of a batch side by side in
strips, each with the words before it that a pattern can span. A match is a range of words, which maps back to characters
of the original text.

The automaton is built in each Python worker from the benchmark's texts, which are broadcast while they have at most MAX_SHARD_BYTES (some
13 million states). A larger benchmark is dealt into shards of that size by item: one scan each, with only that
shard in memory, and the hits so far carried along in a stored table.

Null texts have no words, and neither have empty ones. Very long texts are scanned whole, a strip at a time. Benchmark rows without words are ignored; those without an id
mark words but aren't listed or counted as items. Items with equal windows are all reported; repeated items count once.
Rows are never merged, whatever their ids. Without benchmark rows no document is contaminated. Columns not asked for
are dropped; one asked for with the name of a result gives way to it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, stored, table

WINDOW = 10
MAX_SHARD_BYTES = 8 << 20
STRIP = 64
BATCH_WORDS = 400_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


class Automaton:
    """Aho-Corasick over numbers of words; state 0 is the root, state k + 1 is where edge k leads.

    edges: state << 32 | word, sorted; fail: the state of the longest proper suffix; out: the state itself or the nearest along the
    failure links in which a pattern ends (0: none); length: of the pattern that ends in a state.
    """

    def __init__(self, items: Iterable[tuple[str | None, str | None]], size: int = WINDOW):
        self.size = size
        self.number: dict[bytes, int] = {}
        texts, owners = [], []
        for item, text in items:
            words = words_of(text)
            if words:
                texts.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64))
                owners.append(item)
        self.ids = sorted({i for i in owners if i is not None})
        place = {i: k for k, i in enumerate(self.ids)}
        n = [max(1, len(t) - size + 1) for t in texts]
        owner = np.repeat(np.array([place.get(i, -1) for i in owners], np.int64), n)
        length = np.repeat([min(size, len(t)) for t in texts], n).astype(np.int64)
        padded = np.concatenate([np.append(t, np.zeros(size, np.int64)) for t in texts]) if texts else np.zeros(size, np.int64)
        first = np.concatenate(([0], np.cumsum([len(t) + size for t in texts])))[:-1].astype(np.int64)
        start = np.repeat(first, n) + (np.arange(sum(n)) - np.repeat(np.cumsum(n) - n, n))
        self._build(padded, start, length)
        # the items of each pattern, by its last state
        listed = np.unique(np.stack((self._ends, owner))[:, owner >= 0], axis=1)
        self.owned, self.owner = listed

    def _build(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        state = np.zeros(len(start), np.int64)
        edges, ends, base = [], np.zeros(len(start), np.int64), 1
        levels = [base]
        for depth in range(self.size):
            live = np.flatnonzero(length > depth)
            if not len(live):
                break
            found, at = np.unique(state[live] << 32 | words[start[live] + depth], return_inverse=True)
            edges.append(found)
            state[live] = base + at
            base += len(found)
            levels.append(base)
        ends[:] = state
        self._ends = ends
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.length = np.zeros(base, np.int8)
        self.length[ends] = length
        # edges of the root by word, and bits that most absent edges miss
        self.root = np.zeros(len(self.number) + 1, np.int32)
        if edges:
            self.root[edges[0]] = np.arange(1, len(edges[0]) + 1)
        self.power = min(26, max(10, int(len(self.edges)).bit_length() + 3))
        self.seen = np.zeros(1 << self.power, bool)
        self.seen[self._spot(self.edges)] = True
        self.fail = np.zeros(base, np.int32)
        self.out = np.zeros(base, np.int32)
        for low, high in zip(levels[:-1], levels[1:], strict=True):
            own = np.arange(low, high)
            edge = self.edges[own - 1]
            parent, word = edge >> 32, edge & 0xFFFFFFFF
            if low > 1:
                self.fail[own] = self._step(self.fail[parent].astype(np.int64), word)
            self.out[own] = np.where(self.length[own] > 0, own, self.out[self.fail[own]])

    def _spot(self, edges: np.ndarray) -> np.ndarray:
        return (edges.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.power)

    def _step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after a word (0: one that no pattern has), failure links followed as far as needed."""
        after = self.root[word].astype(np.int64)  # unless a longer history goes on
        left = np.flatnonzero((state > 0) & (word > 0))
        s, w = state[left], word[left]
        while len(left):
            key = s << 32 | w
            maybe = np.flatnonzero(self.seen[self._spot(key)])
            at = np.minimum(np.searchsorted(self.edges, key[maybe]), len(self.edges) - 1)
            hit = self.edges[at] == key[maybe]
            after[left[maybe[hit]]] = at[hit] + 1
            s = self.fail[s].astype(np.int64)
            on = s > 0
            on[maybe[hit]] = False
            left, s, w = left[on], s[on], w[on]
        return after

    def matches(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last word, state) of each place where a pattern ends, in numbered words; 0 parts texts."""
        before = self.size - 1
        n = -(-len(words) // STRIP)
        padded = np.zeros(before + n * STRIP, np.int64)
        padded[before : before + len(words)] = words
        strips = np.lib.stride_tricks.sliding_window_view(padded, before + STRIP)[::STRIP]
        state = np.zeros(n, np.int64)
        places, states = [], []
        for t in range(before + STRIP):
            state = self._step(state, strips[:, t])
            if t >= before:
                out = self.out[state]
                hit = np.flatnonzero(out)
                places.append(hit * STRIP + t - before)
                states.append(out[hit])
        place = np.concatenate(places)
        order = np.argsort(place, kind="stable")
        return place[order], np.concatenate(states)[order]

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text (words, merged ranges of hit words, items)."""
        made, at = [], 0
        while at < len(texts):
            numbers, sizes = [], []
            while at < len(texts) and (not sizes or sum(sizes) < BATCH_WORDS):
                found = list(map(self.number.get, words_of(texts[at])))
                numbers.append(np.array([0 if x is None else x for x in found] + [0], np.int64))
                sizes.append(len(found))
                at += 1
            made += self._ranges(numbers, sizes)
        return made

    def _ranges(self, numbers: list[np.ndarray], sizes: list[int]):
        rows: list[tuple[int, list[tuple[int, int]], set[str]]] = [(n, [], set()) for n in sizes]
        starts = np.cumsum([len(x) for x in numbers]) - [len(x) for x in numbers]
        place, state = self.matches(np.concatenate(numbers)) if len(self.edges) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        text = np.searchsorted(starts, place, "right") - 1
        for k, last, s in zip(text.tolist(), (place - starts[text]).tolist(), state.tolist(), strict=True):
            _, ranges, items = rows[k]
            low, high = last + 1 - int(self.length[s]), last + 1  # of the patterns that end here, out is the longest
            while ranges and ranges[-1][1] >= low:
                low = min(low, ranges.pop()[0])
            ranges.append((low, high))
            while s:
                items.update(self.items_of(s))
                s = int(self.out[self.fail[s]])
        return rows

    def items_of(self, state: int) -> list[str]:
        a, b = np.searchsorted(self.owned, [state, state + 1])
        return [self.ids[k] for k in self.owner[a:b]]


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of characters of the original text."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: The automaton of the last broadcast, for the next tasks of the same worker.
_BUILT: dict[str, Automaton] = {}


def with_hits(df: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = WINDOW, id_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row n_words, n_hit, items (sorted ids) and spans (start, end of hit characters, merged)."""
    spark = df.sparkSession
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    shards = max(1, -(-total // MAX_SHARD_BYTES))
    names = ("n_words", "n_hit", "items", "spans")
    kept = [c for c in keep if c not in names]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text__"))
    n = len(kept)
    span = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    base = T.StructType([rows.schema[c] for c in kept])
    open_schema = T.StructType([*base.fields, rows.schema["__text__"]]).add("items", T.ArrayType(T.StringType())).add("ranges", span)
    last_schema = T.StructType(base.fields[:]).add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("spans", span)
    from pyspark.sql.pandas.types import to_arrow_type

    types = {f.name: to_arrow_type(f.dataType) for f in (*open_schema.fields, *last_schema.fields)}

    def run_with(sent, last):
        def run(batches):
            automaton = _BUILT.get(sent.value[0])
            if automaton is None:
                _BUILT.clear()
                automaton = _BUILT[sent.value[0]] = Automaton(sent.value[1], size)
            for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
                texts = batch.column(n).to_pylist()
                found = automaton.scan(texts)
                before = list(zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True)) if batch.num_columns > n + 1 else [([], [])] * len(found)
                listed = [sorted(items | set(old)) for (_, _, items), (old, _) in zip(found, before, strict=True)]
                ranges = [merged(r + [(x["start"], x["end"]) for x in old]) for (_, r, _), (_, old) in zip(found, before, strict=True)]
                places = [char_spans(t or "", r) for t, r in zip(texts, ranges, strict=True)] if last else ranges
                spans = [[{"start": a, "end": b} for a, b in r] for r in places]
                if last:
                    made = {"n_words": [f[0] for f in found], "n_hit": [sum(b - a for a, b in r) for r in ranges], "items": listed, "spans": spans}
                else:
                    made = {"__text__": texts, "items": listed, "ranges": spans}
                cols = [batch.column(i) for i in range(n)] + [pa.array(v, types[c]) for c, v in made.items()]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *made])

        return run

    before = None
    for k in range(shards):
        shard = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k)
        # about MAX_SHARD_BYTES of texts
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.i, r.t) for r in shard.collect()]))
        if k == shards - 1:
            return rows.mapInArrow(run_with(sent, True), last_schema)
        rows = stored(rows.mapInArrow(run_with(sent, False), open_schema), "decontaminate")
        sent.unpersist()
        if before is not None:
            drop_stored(before)
        before = rows


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same in SQL: documents' windows of each length joined with the items' windows.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, i, dw.n, item FROM dw JOIN bw USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
