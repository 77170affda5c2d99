"""Operator 10, toxicity behind disguises: a noisy channel is decoded, then the restored text is scored.

Channel: letters may be written as look-alike signs, repeated, or spaced out. A token that shows any of it becomes
a lattice (signs give their letters, a run of one letter gives one or two, separators give nothing or a word
boundary), and the Viterbi path under a character model of order ORDER restores it. Other tokens are only
lower-cased and freed of punctuation at their ends.

Learning uses all labelled rows outside the held-out fold; tokens are counted and features chosen by Spark. The bounds of the
model: the character model knows the MAX_GRAMS most frequent character n-grams of words under MAX_WORD letters, and
the MAX_CANDIDATES surest features under MAX_FEATURE characters are looked at. Everything else covers every row and whole texts,
however long; a token of any length is one lattice, walked once. From them come the character model and a short
list of features (tokens, and beginnings of tokens, since words are inflected): again and again the one that most
surely marks the toxic rows not yet explained, until none is sure (MIN_Z, MIN_PRECISION). Choosing one at a time keeps
out words that merely share documents with such tokens, as in groups of copies. A text's score is the logistic of the
sum of its features' log odds and of the log odds of texts without any.

A null or empty text has no tokens and the score of such a text. Null labels and null ids aren't learned from; an
id with several labels counts as toxic if one says so. Without labels, or without toxic ones, the score is 0. Rows are
never merged; columns not asked for are dropped, and one asked for with the name of a result gives way to it. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, fold, per_document, stored, table

MIN_Z = 6.0
MIN_TOXIC = 10
MIN_PRECISION = 0.9
PREFIXES = (4, 5, 6)
ORDER = 4
MAX_CACHED = 300_000
#: Bounds of the fit.
MAX_GRAMS, MAX_WORD, MAX_CANDIDATES, MAX_FEATURE = 200_000, 30, 5000, 64
#: A task hands on its counts when it holds so many.
MAX_HELD = 1_000_000
#: Bitmaps of labels, of 32,768 numbers and two times 4 KB each, up to which they are broadcast.
MAX_BITMAPS = 2048
#: The letters that a sign can stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "\u20ac": "e", "\xa3": "l"}
SEPARATORS = frozenset(" .-_*~'`\u200b\xad")
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
_ODD = re.compile(r"[^\W\d_][\d@$!|+(\u20ac\xa3.*_~'`\u200b\xad-]+[^\W\d_]|(\w)\1\1|^[\d@$!|+(\u20ac\xa3]+[^\W\d_]{2}|[^\W\d_]{2}[\d@$|+(\u20ac\xa3]+$")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
_LETTER = re.compile(r"[^\W\d_]")
#: What simple() looks for: ends that plain() takes off, and what _ODD can match in letters with such ends.
_ASCII_ENDS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
_FIRST, _LAST = frozenset("0123456789@$!|+("), frozenset("0123456789@$|+(")
_THRICE = re.compile(r"(\w)\1\1")


def plain(token: str) -> str:
    return _ENDS.sub("", token.lower())


def features(word: str) -> list[str]:
    """The word and its beginnings (marked by a hyphen after them, which no plain word ends in)."""
    return [word, *[word[:n] + "-" for n in PREFIXES if len(word) >= n]]


def simple(token: str) -> str | None:
    """plain(token) of an ASCII token that shows no disguise and is letters but for its ends; None if that isn't quickly seen."""
    if not token.isascii():
        return None
    low = token.lower()
    word = low if low.isalpha() else low.strip(_ASCII_ENDS)
    return None if not word.isalpha() or token[0] in _FIRST or token[-1] in _LAST or _THRICE.search(low) else word


class _Cached(dict):
    """What make() says of a token, kept for short ones."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: str):
        found = self.make(token)
        if len(token) < 64:
            if len(self) > MAX_CACHED:
                self.clear()
            self[token] = found
        return found


class Channel:
    """Restores disguised tokens; counts: of the character n-grams of words, a space at each end."""

    def __init__(self, counts: dict[str, int]):
        self.sums: list[Counter] = [Counter() for _ in range(ORDER)]
        for gram, n in counts.items():
            for k in range(ORDER):
                self.sums[k][gram[-1 - k :]] += n
        self.total = max(1, sum(self.sums[0].values()))
        self.before: list[Counter] = [Counter() for _ in range(ORDER)]
        for k in range(1, ORDER):
            for gram, n in self.sums[k].items():
                self.before[k][gram[:-1]] += n
        self.known: dict[tuple[str, str], float] = {}

    def cost(self, context: str, letter: str) -> float:
        """Minus the logarithm of a letter's probability after up to ORDER - 1 characters, orders interpolated."""
        found = self.known.get((context, letter))
        if found is None:
            p = (self.sums[0][letter] + 0.1) / (self.total + 100)
            for k in range(1, ORDER):
                history = context[-k:]
                if len(history) < k:
                    break
                n = self.before[k][history]
                p = (self.sums[k][history + letter] + 2 * p) / (n + 2)
            found = self.known[context, letter] = -math.log(p)
        return found

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        steps: list[list[tuple[str, float]]] = []
        at = 0
        while at < len(token):
            c, end = token[at], at
            while end < len(token) and token[end] == c:
                end += 1
            if c in SIGNS:
                one = [(x, 0.2) for x in SIGNS[c]]
                steps.append(one if end == at + 1 else one + [(x + x, 0.4) for x in SIGNS[c]])
            elif c.isspace():
                steps.append([("", 0.0), (" ", 0.5)])
            elif c in SEPARATORS or not c.isalpha():
                steps.append([("", 0.0)])
            else:
                steps.append([(c, 0.0)] if end == at + 1 else [(c, 0.4), (c + c, 0.0 if end == at + 2 else 0.8)])
            at = end
        return steps

    def restore(self, token: str) -> str:
        """The most likely letters of a lower-cased token."""
        paths: dict[str, tuple[float, tuple]] = {" ": (0.0, ())}
        for step in [*self.lattice(token), [(" ", 0.0)]]:
            after: dict[str, tuple[float, tuple]] = {}
            for context, (cost, back) in paths.items():
                for letters, extra in step:
                    c, total = context, cost + extra
                    for letter in letters:
                        total += self.cost(c, letter)
                        c = (c + letter)[1 - ORDER :]
                    if c not in after or total < after[c][0]:
                        after[c] = (total, (back, letters) if letters else back)
            paths = after
        back = min(paths.values(), key=lambda x: x[0])[1]
        out = []
        while back:
            back, letters = back
            out.append(letters)
        return "".join(reversed(out)).strip()


def tokens_of(text: str, channel: Channel) -> set[str]:
    """The distinct restored tokens of a text."""
    found = set()
    for token in set(text.split()):
        found |= _restored(token, channel)
    for run in _SPACED.findall(text):
        found.update(channel.restore(run.lower()).split())
    return found


def _restored(token: str, channel: Channel) -> set[str]:
    word = plain(token)
    if not word or not _ODD.search(token) and not _ODD.search(word):
        return {word}
    return {word, *channel.restore(token.lower()).split()} if _LETTER.search(word) else {word}


def _learn(batches):
    """(kind, key, toxic, clean): rows of either kind (0), features (1), character n-grams (2)."""
    rows, words, times = [0, 0], (Counter(), Counter()), Counter()
    made = _Cached(lambda token: tuple(features(plain(token))))
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = (text or "").split()
            rows[not toxic] += 1
            words[not toxic].update(set().union(*map(made.__getitem__, set(tokens))))
            times.update(tokens)
        if len(words[0]) + len(words[1]) + len(times) > MAX_HELD:
            yield _counted(rows, words, times, made)
            rows, words, times = [0, 0], (Counter(), Counter()), Counter()
    yield _counted(rows, words, times, made)


def _grams(words: dict[str, int]) -> dict[str, int]:
    """How often the n-grams (ORDER is two pairs of characters) of words occur, a space before and after each."""
    found: dict[str, int] = defaultdict(int)
    names = list(words)
    for at in range(0, len(names), 100_000):
        part = names[at : at + 100_000]
        codes = np.frombuffer("".join([f"   {w} " for w in part]).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in part])
        times = np.repeat(np.array([words[w] for w in part], np.float64), lengths + 1)
        ends = np.cumsum(lengths + ORDER)
        starts = np.ones(len(codes), bool)
        for k in range(1, ORDER):
            starts[ends - k] = False
        starts = np.flatnonzero(starts)
        pairs, pair = np.unique(codes[:-1] * 0x110000 + codes[1:], return_inverse=True)
        grams, gram = np.unique(pair[starts] * len(pairs) + pair[starts + 2], return_inverse=True)
        shown = [chr(x // 0x110000) + chr(x % 0x110000) for x in pairs.tolist()]
        for x, n in zip(grams.tolist(), np.bincount(gram, times).tolist(), strict=True):
            found[shown[x // len(pairs)] + shown[x % len(pairs)]] += int(n)
    return found


def _counted(rows: list[int], words: tuple[Counter, Counter], times: Counter, made: _Cached) -> pa.RecordBatch:
    """times: of tokens as they are."""
    whole: dict[str, int] = defaultdict(int)
    for token, n in times.items():
        word = made[token][0]
        if word.isalpha() and len(word) < MAX_WORD:
            whole[word] += n
    grams = _grams(whole)
    keys = list(words[0].keys() | words[1].keys())
    cols = ([0] + [1] * len(keys) + [2] * len(grams), ["", *keys, *grams], [rows[0], *map(words[0].__getitem__, keys), *grams.values()], [rows[1], *map(words[1].__getitem__, keys), *[0] * len(grams)])
    arrays = [pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "key", "toxic", "clean"])


def _labelled(docs: DataFrame, usable: DataFrame) -> DataFrame:
    """(text, toxic) of the docs (id, text) with a label (id, toxic).

    Where labels are by whole numbers that lie densely, they are broadcast as two bits for each number, and no text is shuffled; else texts meet
    them by a join.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    if {docs.schema["id"].dataType.simpleString(), usable.schema["id"].dataType.simpleString()} <= whole:
        place = F.bitmap_bit_position("id")
        bits = usable.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(place).alias("known"), F.bitmap_construct_agg(F.when(F.col("toxic") == 1, place)).alias("bad"))
        bits = stored(bits, "toxicity-labels")
        if bits.count() <= MAX_BITMAPS:
            bit = lambda c: F.expr(f"shiftright(cast(conv(hex(substring({c}, cast(place div 8 as int) + 1, 1)), 16, 10) as int), cast(place % 8 as int)) & 1")
            met = docs.join(F.broadcast(bits), F.bitmap_bucket_number("id") == F.col("bucket")).withColumn("place", place)
            return met.where(bit("known") == 1).select("text", bit("bad").alias("toxic"))
    return docs.join(usable.groupBy("id").agg(F.max("toxic").alias("toxic")), "id").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> dict:
    """The model: counts of character n-grams, the log odds of chosen tokens, and those of no token."""
    usable = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(fold("id", folds) != 0)
    rows = _labelled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), usable)
    counts = stored(rows.mapInArrow(_learn, "kind int, key string, toxic long, clean long").groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity")
    found = counts.where("kind = 0").first()
    toxic, clean = (found.toxic, found.clean) if found else (0, 0)
    grams = {r.key: r.toxic for r in counts.where("kind = 2 and toxic > 1").orderBy(F.desc("toxic"), "key").limit(MAX_GRAMS).collect()}
    if not toxic:
        return {"grams": grams, "odds": {}, "none": None}
    share = toxic / (toxic + clean)
    expected = (F.col("toxic") + F.col("clean")) * share
    sure = counts.where((F.col("kind") == 1) & (F.length("key") < MAX_FEATURE)).where(F.col("toxic") >= MIN_TOXIC).where((F.col("toxic") - expected) >= MIN_Z * F.sqrt(expected)).where(F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean")))
    # the surest come first
    candidates = {r.key: (r.toxic, r.clean) for r in sure.orderBy(F.desc((F.col("toxic") - expected) / F.sqrt(expected)), "key").limit(MAX_CANDIDATES).collect()}
    drop_stored(counts)
    names, n, odds = sorted(candidates), [clean, toxic], {}
    sent = rows.sparkSession.sparkContext.broadcast(names)

    def held(batches):
        place = {w: i for i, w in enumerate(sent.value)}
        heads, none = {f[:4] for f in place}, ()

        def find(token):
            word = plain(token)
            return tuple(place[f] for f in features(word) if f in place) if word[:4] in heads else none

        found = _Cached(find)
        for batch in batches:
            lists = [sorted(set().union(*map(found.__getitem__, set((text or "").split())))) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), batch.column(1)], names=["held", "toxic"])

    # rows with equal features are one; a round's counts of the rows not yet explained are two numbers for each candidate at most
    sets = rows.mapInArrow(held, "held array<int>, toxic int").where(F.size("held") > 0).groupBy("held", "toxic").agg(F.count(F.lit(1)).alias("times"))
    sets = stored(sets, "toxicity") if names else None
    length, taken = np.array([len(x) for x in names]), []
    while names:
        left = sets.where(~F.arrays_overlap("held", F.lit(taken).cast("array<int>"))) if taken else sets
        by = np.zeros((2, len(names)))
        for r in left.select(F.explode("held").alias("at"), "toxic", "times").groupBy("at", "toxic").agg(F.sum("times").alias("times")).collect():
            by[r.toxic, r["at"]] = r.times
        expected = by.sum(axis=0) * n[1] / max(1, sum(n))
        z = np.where(by[1] >= MIN_TOXIC, (by[1] - expected) / np.sqrt(np.maximum(expected, 1e-9)), 0)
        best = int(np.lexsort((length, z))[-1])
        if z[best] < MIN_Z:
            break
        t, c = candidates[names[best]]
        odds[names[best]] = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        n = [n[0] - int(by[0, best]), n[1] - int(by[1, best])]
        taken.append(best)
    if names:
        drop_stored(sets)
    # words as common and as sure as the chosen ones, which explain no rows of their own only because these come together
    common = 0.5 * float(np.median([candidates[f][0] for f in odds])) if odds else 0
    for word, (t, c) in candidates.items():
        if not word.endswith("-") and t >= common and t >= 0.98 * (t + c):
            odds.setdefault(word, math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)))
    return {"grams": grams, "odds": odds, "none": math.log((n[1] + 0.5) / (n[0] + 0.5))}


class _Weights(_Cached):
    """Which chosen tokens a raw token restores to."""

    def __init__(self, channel: Channel, odds: dict[str, float]):
        # a word has no chosen feature unless one begins as it does: the shortest beginning has four letters
        heads, none = {f[:4] for f in odds}, frozenset()

        def find(token: str) -> frozenset:
            word = simple(token)
            if word is not None and word[:4] not in heads:
                return none
            words = (word,) if word is not None else _restored(token, channel)
            return frozenset(f for w in words if w[:4] in heads for f in features(w) if f in odds)

        super().__init__(find)


def with_toxicity(df: DataFrame, model: dict, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row score (0 to 1) and predicted (1 if the score is at least 0.5)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        odds, none = sent.value["odds"], sent.value["none"]
        channel = Channel(sent.value["grams"])
        weights = _Weights(channel, odds)
        empty = frozenset()

        def call(texts):
            scores = []
            for text in texts:
                text = text or ""
                found = empty.union(*map(weights.__getitem__, set(text.split())))
                for run in _SPACED.findall(text):
                    found |= {f for w in channel.restore(run.lower()).split() for f in features(w) if f in odds}
                x = -math.inf if none is None else none + sum(sorted(odds[w] for w in found))
                scores.append(1 / (1 + math.exp(-max(-50.0, min(50.0, x)))) if x > -math.inf else 0.0)
            return [scores, [int(s >= 0.5) for s in scores]]

        return call

    return per_document(df, make, "score double, predicted int", text_col, keep)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return with_toxicity(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
