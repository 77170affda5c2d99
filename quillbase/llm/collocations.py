"""Operator 13, phrase collocations: prefix-free parsing, then counts inside the distinct chunks.

Pieces of texts are parsed into chunks: a chunk begins with a piece and at each word whose hash triggers it (and after LONGEST
words without a trigger), and goes on over MAX_WORDS - 1 words of the next chunk, so that every phrase lies whole in the chunk
in which its first word is. The distinct chunks of a language form a dictionary with the frequency of each in the parse. Phrases
are counted inside the distinct chunks, times that frequency, and only where they begin before the overlap (column own):
so each occurrence counts once, and what many documents share is read once.

A phrase is frequent only if its parts are, so lengths follow one another. Words are counted as they are. From each length a
bitmap by hash goes to the tasks, which count, by 64-bit codes, only phrases whose parts are marked. Bitmaps are of a
fixed largest size, and equal codes or bits let too much through, never too little: the phrases that are left are counted
as text, exactly. Scores divide decimals of 38 digits, exact for corpora of up to 10**17 words.

Null texts and texts without words have no phrases; a null lang is `und`. Texts are whole, a very long one is parsed in windows
that end with a piece. Rows that repeat count as often as they are there; other columns are never read. An empty table
gives an empty result. Phrases with equal figures rank by their bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Fixed by the task.
MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: One word in so many begins a chunk; a chunk owns at most so many words.
TRIGGER, LONGEST = 16, 256
#: Texts are read together up to so many bytes; codes and phrases are summed up to so many in a task.
WINDOW, MOST_CODES, MOST_PHRASES = 2 << 20, 4 << 20, 400_000
#: The largest bitmap has 2 to the power of so many bits.
MAX_BITS = 28
MAX_BROADCAST = 100_000

_ROOT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(29)


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(n, _ROOT), np.full(n, np.uint64(pow(int(_ROOT), -1, 1 << 64)))
            for s in steps:
                s[0] = 1
            self.up, self.down = map(np.multiply.accumulate, steps)
        return self.up, self.down


_powers = _Powers()


def _words(data: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end (bytes that aren't apart), and a hash of each."""
    edge = np.diff(np.concatenate(([False], ~apart, [False])).view(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers.upto(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    return begin, end, _mixed((total[end] - total[begin]) * down[begin])


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    langs = batch.column("lang")
    for lang in pc.unique(langs).to_pylist():
        yield lang, batch.filter(pc.equal(langs, lang))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last one ends."""
    wide = column.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return np.frombuffer(wide.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def parse(data: np.ndarray, max_words: int = MAX_WORDS) -> Counter:
    """The chunks of a window of texts, each as (words that it owns, bytes), with their frequencies."""
    low = _LOWER[data]
    kind = _KIND[low]
    begin, end, code = _words(low, kind > 0)
    n = len(begin)
    if not n:
        return Counter()
    piece = np.cumsum(kind == 2, dtype=np.int32)[begin]
    new = np.concatenate(([True], piece[1:] != piece[:-1]))
    start = np.flatnonzero(new | (code % np.uint64(TRIGGER) == 0))
    owned = np.diff(np.append(start, n))
    parts = -(-owned // LONGEST)
    if parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + nth * LONGEST
        owned = np.diff(np.append(start, n))
    borders = np.append(np.flatnonzero(new), n)
    last = np.minimum(start + owned + max_words - 1, borders[np.searchsorted(borders, start, "right")]) - 1
    keep = kind == 0
    keep[end[end < len(keep)]] = True  # one space after each word
    text = np.where(kind > 0, np.uint8(32), low)[keep].tobytes()
    at = np.cumsum(keep) - keep
    chunks = [text[a:b] for a, b in zip(at[begin[start]].tolist(), (at[begin[last]] + end[last] - begin[last]).tolist(), strict=True)]
    return Counter(zip(owned.tolist(), chunks, strict=True))


def _windows(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of about WINDOW bytes that end with a break, as the whole does."""
    at = 0
    while at < len(data):
        end = at + WINDOW
        if end < len(data):
            back = np.flatnonzero(_KIND[data[at:end]] == 2)
            while not len(back):
                end += WINDOW
                back = np.flatnonzero(_KIND[data[at:end]] == 2)
            end = at + int(back[-1]) + 1
        yield data[at:end]
        at = end


def dictionary(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS) -> DataFrame:
    """The distinct chunks: lang, chunk, own (words in which its phrases begin), times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, rows in _by_lang(batch):
                found: Counter = Counter()
                for window in _windows(_bytes(rows.column("text"))[0]):
                    found.update(parse(window, max_words))
                chunks = pa.array([c for _, c in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), chunks, pa.array([o for o, _ in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["lang", "chunk", "own", "times"])

    # a break after each text: the next one's words don't follow on
    text = F.concat(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit("\n"))
    src = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    parsed = src.mapInArrow(run, "lang string, chunk string, own int, times long")
    return parsed.groupBy("lang", "chunk", "own").agg(F.sum("times").alias("times"))


class Grams:
    """The words of a window of chunks of one language, and codes of the phrases that begin with each."""

    def __init__(self, lang: str, data: np.ndarray, own: np.ndarray, times: np.ndarray):
        self.data = data
        self.begin, self.end, code = _words(data, (data == 32) | (data == 10))
        chunk = np.cumsum(data == 10)[self.begin]
        place = np.arange(len(chunk)) - np.searchsorted(chunk, chunk)
        self.owned, self.times, self.chunk = place < own[chunk], times[chunk], chunk
        salt = np.uint64(int.from_bytes(lang.encode()[:8], "little") + 31 * sum(lang.encode()) + len(lang))
        self.code = [_mixed(code + _mixed(np.array([salt], np.uint64))[0])]

    def codes(self, n: int) -> np.ndarray:
        """A code for each phrase of n words, by the place of its first word."""
        while len(self.code) < n:
            k = len(self.code)
            self.code.append(_mixed(self.code[-1][:-1] * _ROOT + self.code[0][k:] + np.uint64(k)))
        return self.code[n - 1]

    def inside(self, n: int) -> np.ndarray:
        """Whether a phrase of n words begins at a word and stays in its chunk."""
        m = max(0, len(self.chunk) - n + 1)
        return self.owned[:m] & (self.chunk[:m] == self.chunk[n - 1 :][:m])

    def texts(self, at: np.ndarray, n: int) -> list[bytes]:
        whole = self.data.tobytes()
        return [whole[a:b] for a, b in zip(self.begin[at].tolist(), self.end[at + n - 1].tolist(), strict=True)]


class Marks:
    """Bitmaps by hash of the frequent phrases of each length so far."""

    def __init__(self, maps: dict[int, np.ndarray]):
        self.maps = maps

    def has(self, n: int, codes: np.ndarray) -> np.ndarray:
        bits = self.maps[n]
        at = codes >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def candidates(self, grams: Grams, n: int, known: int) -> np.ndarray:
        """Places of phrases of n words all of whose parts of `known` words are marked."""
        ok = grams.inside(n)
        if len(ok):
            marked = self.has(known, grams.codes(known))
            for k in range(n - known + 1):
                ok &= marked[k : k + len(ok)]
        return np.flatnonzero(ok)


def _each(chunks: DataFrame, work: Callable[[Iterator[tuple[str, Grams]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def windows() -> Iterator[tuple[str, Grams]]:
            for batch in batches:
                for lang, rows in _by_lang(batch):
                    data, offsets = _bytes(rows.column("chunk"))
                    own, times = (rows.column(c).to_numpy() for c in ("own", "times"))
                    at = 0
                    while at < len(own):
                        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WINDOW, "right")) - 1)
                        yield lang, Grams(lang, data[offsets[at] : offsets[to]], own[at:to], times[at:to])
                        at = to

        yield from work(windows())

    return chunks.select("lang", F.concat("chunk", F.lit("\n")).alias("chunk"), "own", "times").mapInArrow(run, schema)


def _counted(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, found in counts.items():
        phrases = pa.array(list(found), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), phrases, pa.array(list(found.values()), pa.int64())], names=["lang", "phrase", "f"])
    counts.clear()


def _phrases(chunks: DataFrame, places: Callable[[Grams], Iterator[tuple[int, np.ndarray]]], least: int) -> DataFrame:
    """Exact counts (lang, phrase, f), of least or more, of the phrases at the places (of so many words each)."""

    def work(windows):
        counts: dict[str, Counter] = {}
        for lang, grams in windows:
            own = counts.setdefault(lang, Counter())
            for n, at in places(grams):
                times = grams.times[at]
                own.update(grams.texts(at[times == 1], n))
                many = at[times > 1]
                for phrase, t in zip(grams.texts(many, n), grams.times[many].tolist(), strict=True):
                    own[phrase] += t
            if sum(map(len, counts.values())) > MOST_PHRASES:
                yield from _counted(counts)
        yield from _counted(counts)

    return _each(chunks, work, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _codes(chunks: DataFrame, places: Callable[[Grams], Iterator[tuple[int, np.ndarray]]], least: int) -> DataFrame:
    """Codes of phrases whose counts, with those of equal codes, are least or more."""

    def summed(codes: list, times: list) -> pa.RecordBatch:
        found, which = np.unique(np.concatenate(codes), return_inverse=True)
        # counts of a task stay far below 2**53
        total = np.bincount(which, np.concatenate(times), len(found)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total)], names=["code", "f"])

    def work(windows):
        codes, times, size = [], [], 0
        for _, grams in windows:
            for n, at in places(grams):
                codes.append(grams.codes(n)[at])
                times.append(grams.times[at])
                size += len(at)
            if size > MOST_CODES:
                yield summed(codes, times)
                codes, times, size = [], [], 0
        if codes:
            yield summed(codes, times)

    return _each(chunks, work, "code long, f long").groupBy("code").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("code")


def _bitmap(codes: DataFrame) -> np.ndarray:
    """A bitmap of codes, of 64 bits a code up to the largest; it comes to the driver in words of 64 bits, at most 2**22 of them."""
    codes = stored(codes, "frequent")
    bits = max(16, min(MAX_BITS, (64 * codes.count()).bit_length()))
    at = F.shiftrightunsigned("code", 64 - bits)
    words = codes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(code, {64 - bits}) & 63 AS INT)))").alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, phrase, f) of all phrases of up to max_words words that occur least or more times, and all words of each lang (lang, n)."""
    sc = df.sparkSession.sparkContext
    chunks = stored(dictionary(df, text_col, lang_col, max_words), "chunks")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    words = stored(_phrases(chunks, lambda g: iter([(1, np.flatnonzero(g.inside(1)))]), least), "words")
    as_chunks = words.select("lang", F.col("phrase").alias("chunk"), F.lit(1).alias("own"), "f").withColumnRenamed("f", "times")
    maps = {1: _bitmap(_codes(as_chunks, lambda g: iter([(1, np.flatnonzero(g.inside(1)))]), least))}
    made = [words]
    known = 1
    while known < max_words:
        # once phrases are rare, two lengths are counted in one reading
        lengths = range(known + 1, min(max_words, known + (2 if known > 2 else 1)) + 1)
        marks = sc.broadcast(maps)

        def tried(g, lengths=lengths, known=known, marks=marks):
            return ((n, Marks(marks.value).candidates(g, n, known)) for n in lengths)

        bits = _bitmap(_codes(chunks, tried, least))
        maps = maps | {n: bits for n in lengths}
        known = lengths[-1]
    marks = sc.broadcast(maps)

    def kept(g):
        return ((n, Marks(marks.value).candidates(g, n, n)) for n in range(2, max_words + 1))

    made.append(stored(_phrases(chunks, kept, least), "phrases"))
    return made[0].unionByName(made[1]), totals


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP, salts: int = 64
) -> DataFrame:
    """For each lang its first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = frequent_phrases(df, text_col, lang_col, max_words, least)
    few = totals.count() <= MAX_BROADCAST
    phrases = counts.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1).withColumnRenamed("f", "a")
    part = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    sides = lambda key, f: counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(f))
    cuts = cuts.join(sides("first", "l"), ["lang", "first"]).join(sides("rest", "r"), ["lang", "rest"]).join(F.broadcast(totals) if few else totals, "lang")
    wide = lambda c, digits=18: F.col(c).cast(f"decimal({digits},0)")
    above, below = (wide("a") * 1000).cast("decimal(20,0)") * wide("n"), wide("l", 19) * wide("r", 19)
    cuts = cuts.withColumn("_above", above.cast("decimal(38,0)")).withColumn("_below", below.cast("decimal(38,0)")).withColumn("score", F.expr("_above div _below"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # of longer phrases, those of one word more say it all: counts only fall with length
    longer = phrases.where(F.size("words") > 2).select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("words") - 1), part(F.lit(2), F.size("words") - 1))).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = scored.join(covered, ["lang", "phrase"], "left").where(F.coalesce("longest", F.lit(0)) * 100 < F.col("a") * 100)
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("salt", F.abs(F.hash("phrase")) % salts)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of each lang, then over those that are left
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM w WHERE len(w) > 0) WHERE len(w) >= k)),
n AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, phrase, k, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY lang, phrase, k HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
t AS (SELECT lang, phrase, f AS a, cut, array_to_string(w[1 : cut], ' ') AS x, array_to_string(w[cut + 1 :], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT t.*, l.f AS l, r.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM t JOIN f l ON l.lang = t.lang AND l.phrase = x JOIN f r ON r.lang = t.lang AND r.phrase = y JOIN n ON n.lang = t.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, array_to_string(w[i : i + j - 1], ' ') AS phrase, max(f) AS f FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c)) GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase AND 100 * o.f >= 100 * b.a)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
