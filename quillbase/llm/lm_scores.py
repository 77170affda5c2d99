"""Operator 3, language-model scores: a weighted backoff automaton over smoothed n-grams of words.

Tokens are the words of a text (A-Z lower-cased, split at ASCII white space) and one end. The unigram model gives
(c + 0.1) / (N + 0.1 (V + 1)). Histories of one and two tokens that training rows hold at least LEAST times have all the
tokens that ever follow them there, so every n-gram of count two or more is in the model, however large the corpus:
P(w | h) = (c(hw) + k P(w | shorter h)) / (c(h) + k), which adds up to one over w after each history; k is of PRIORS, by
the history's length.

States are those histories; a seen token's arc weighs log10 P(w | h), the failure arc log10 k / (c(h) + k), and it
leads to the next shorter history, at last to the root. The whole automaton is never in one place. Texts become
blocks of word numbers (a table bucketed by block), and a block gets the arcs and failure arcs of its own n-grams:

1. each block counts its words and pairs by hashed code and sends codes and counts, dealt into buckets by code; a bucket
   adds them up and answers each block with the corpus's counts of the block's codes, in the block's order;
2. the same for the triples whose history is a state and whose last pair occurs;
3. with both answers, one traversal of each text from left to right carries the state and adds up the weights.

A code occurs once in a block's message, so that no n-gram, however frequent, makes a bucket large; a bucket holds the
codes of about BUCKET_BYTES of text. Codes have CODE_BITS bits within their bucket (fewer in over 2 ** 16 buckets): at some
four million codes a bucket, one n-gram in 70 million shares a code.

Null texts are empty (one token, the end). A null id counts as an empty text for the fold. Rows are numbered when
they are dealt into blocks and never merged, so repeated ids and rows stay apart. A very long text is cut into pieces
of PIECE_TOKENS, each with the two tokens before it, whose sums are added. Without training rows every count is zero;
an empty table gives an empty result. Columns other than id and text are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, fold, stored, table

LEAST = 2
#: By held-out likelihood on the given tables.
PRIORS = (300.0, 50.0)
ADD = 0.1
BLOCK_TOKENS = 1_000_000
PIECE_TOKENS = 200_000
MAX_WORDS = 400_000
BUCKET_BYTES = 24 << 20
CODE_BITS = 48
TEXTS = 500  # taken from a batch at a time
START, END = b"\n", b""  # neither can be a word


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# ---- blocks of texts as numbers


def pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_BLOCK = "block long, rows array<long>, ids array<{kind}>, held array<boolean>, context array<int>, lengths array<int>, n int, tokens binary, n_words int, codes binary, trained long, texts long"


def _blocks(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (id, text, held_out): one row for each block of texts, as _BLOCK has it.

    tokens: the words' numbers within the block, each piece with `context` tokens before it that don't count (START, or
    the two before a piece that goes on); codes: the hash of each word.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        row, block = part << 40, part << 32
        vocabulary = _Ids({START: 0, END: 1})
        pieces: list[np.ndarray] = []
        about: list[tuple] = []  # row, id, held, context, length
        size = 0

        def made():
            tokens = np.concatenate(pieces)
            codes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)
            rows, ids, held, context, lengths = zip(*about, strict=True)
            lists = [pa.array([list(v)], pa.list_(t)) for v, t in ((rows, pa.int64()), (ids, kind), (held, pa.bool_()), (context, pa.int32()), (lengths, pa.int32()))]
            cols = [pa.array([block]), *lists, pa.array([len(tokens)], pa.int32()), pa.array([pack(tokens)], pa.binary()), pa.array([len(codes)], pa.int32()), pa.array([pack(codes)], pa.binary())]
            free = [(n - c, c == 1) for c, n, h in zip(context, lengths, held, strict=True) if not h]
            cols += [pa.array([sum(x)], pa.int64()) for x in (zip(*free, strict=True) if free else [[]] * 2)]
            return pa.RecordBatch.from_arrays(cols, names=["block", "rows", "ids", "held", "context", "lengths", "n", "tokens", "n_words", "codes", "trained", "texts"])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                few = batch.slice(at, TEXTS)
                for key, text, held in zip(*(c.to_pylist() for c in few.columns), strict=True):
                    words = words_of(text)
                    for a in range(0, max(1, len(words)), PIECE_TOKENS):
                        if size >= BLOCK_TOKENS or len(vocabulary) >= MAX_WORDS:
                            yield made()
                            vocabulary, pieces, about, size = _Ids({START: 0, END: 1}), [], [], 0
                            block += 1
                        before = [vocabulary[w] for w in words[a - 2 : a]] if a else [0]
                        seq = before + [vocabulary[w] for w in words[a : a + PIECE_TOKENS]]
                        if a + PIECE_TOKENS >= len(words):
                            seq.append(1)
                        pieces.append(np.array(seq, np.int32))
                        about.append((row, key, held, len(before), len(seq)))
                        size += len(seq)
                    row += 1
        if pieces:
            yield made()

    return run


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The code of a history's code a and a word's code b."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def _place(n: int, mask: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, sorted, and for each of n tokens the place of its code; -1 where the mask is false."""
    found, inverse = np.unique(of[mask], return_inverse=True)
    at = np.full(n, -1, np.int32)
    at[mask] = inverse
    return found, at


class Block:
    """The n-grams of a block. Distinct codes are sorted by bucket: answers come in that order.

    at2: for each token, the place of the pair that ends in it among the distinct ones; -1 for none.
    """

    def __init__(self, row: dict, buckets: int):
        self.number, self.buckets = row["block"], buckets
        self.shift = np.uint64(min(CODE_BITS, 64 - buckets.bit_length()))
        self.rows, self.ids, self.held = row["rows"], row["ids"], row["held"]
        self.lengths = np.array(row["lengths"], np.int64)
        self.stops = np.cumsum(self.lengths)
        self.context = np.array(row["context"], np.int64)
        self.tokens = unpack(row["tokens"], row["n"], np.int32)
        words = unpack(row["codes"], row["n_words"], np.uint64)
        self.place = np.arange(row["n"], dtype=np.int32) - np.repeat(self.stops - self.lengths, self.lengths).astype(np.int32)
        self.counted = self.place >= np.repeat(self.context, self.lengths)
        free = ~np.repeat(np.array(self.held, bool), self.lengths)
        self.train = self.counted & free
        self.first = (self.tokens == 0) & free
        self.code1 = words[self.tokens]
        self.code2 = np.zeros_like(self.code1)
        self.code2[1:] = _mix(self.code1[:-1], self.code1[1:])
        own = self.own(words)
        self.order = np.argsort(own)  # of words by code
        self.words = own[self.order]
        self.pairs, self.at2 = _place(row["n"], self.place >= 1, self.own(self.code2))

    def own(self, codes: np.ndarray) -> np.ndarray:
        """The bucket of each code, above its bits within the bucket."""
        bucket = (codes >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        return bucket << self.shift | codes & (np.uint64(1) << self.shift) - np.uint64(1)

    def asked(self) -> pa.RecordBatch:
        """How often training texts have each word and pair; START counts once for each text."""
        one = np.bincount(self.tokens[self.train | self.first], minlength=len(self.order))[self.order]
        two = np.bincount(self.at2[self.train & (self.at2 >= 0)], minlength=len(self.pairs))
        return _message(self, [self.words, self.pairs], [one, two])

    def told(self, answers: pa.Table) -> None:
        """Takes the counts of words (by number) and pairs, and finds the triples that are still to be asked for."""
        by_code, self.count2 = _answers(answers, 1, 2)
        self.count1 = np.empty_like(by_code)
        self.count1[self.order] = by_code
        i = np.flatnonzero(self.counted & (self.place >= 2))
        ask = np.zeros(len(self.tokens), bool)
        ask[i[(self.count2[self.at2[i - 1]] >= LEAST) & (self.count2[self.at2[i]] > 0)]] = True
        code3 = np.zeros_like(self.code1)
        code3[2:] = _mix(self.code2[1:-1], self.code1[2:])
        self.triples, self.at3 = _place(len(self.tokens), ask, self.own(code3))

    def asked_triples(self) -> pa.RecordBatch:
        return _message(self, [self.triples], [np.bincount(self.at3[self.train & (self.at3 >= 0)], minlength=len(self.triples))])

    def told_triples(self, answers: pa.Table) -> None:
        i = np.flatnonzero(self.at3 >= 0)
        self.count3 = np.zeros(len(self.tokens))
        self.count3[i] = _answers(answers, 2, 1)[0][self.at3[i]]


class Automaton:
    """The part of the backoff automaton that a block's texts can reach, its arcs laid out by token.

    A state is a history of 2, 1 or 0 words (its level). arcs[level][i]: the weight of token i's arc from the state of the
    `level` tokens before it, NaN where that state has none; fails[level][i]: the weight of that state's failure arc;
    after[i]: the level of the state that the arc of token i leads to.
    """

    def __init__(self, block: Block, scale: float):
        t, n = block.tokens, len(block.tokens)
        count1 = block.count1[t]
        self.known = count1 > 0
        one = (count1 + ADD) / scale
        two, three = np.full(n, np.nan), np.full(n, np.nan)
        fail1, fail2 = np.zeros(n), np.zeros(n)
        i = np.flatnonzero((block.at2 >= 0) & (np.concatenate(([0], count1[:-1])) >= LEAST))
        c, history = block.count2[block.at2[i]], count1[i - 1]
        prior = PRIORS[0]
        fail1[i] = np.log10(prior / (history + prior))
        p = one.copy()
        p[i] = (c + prior * one[i]) / (history + prior)
        two[i[c > 0]] = np.log10(p[i[c > 0]])
        pair = np.where(block.at2 >= 0, block.count2[block.at2], 0)
        i = np.flatnonzero(block.counted & (block.place >= 2) & (np.concatenate(([0], pair[:-1])) >= LEAST))
        c, history = block.count3[i], pair[i - 1]
        prior = PRIORS[1]
        fail2[i] = np.log10(prior / (history + prior))
        three[i[c > 0]] = np.log10((c + prior * p[i]) / (history + prior))[c > 0]
        self.arcs = [np.log10(one), two, three]
        self.fails = [None, fail1, fail2]
        self.after = np.where(pair >= LEAST, 2, count1 >= LEAST).astype(np.int8)

    def traverse(self, context: int, start: int, stop: int) -> float:
        """log10 of the probability of the tokens after the first `context` of start..stop, from left to right."""
        root, arcs1, arcs2 = (a[start:stop].tolist() for a in self.arcs)
        fails1, fails2 = (f[start:stop].tolist() for f in self.fails[1:])
        after = self.after[start:stop].tolist()
        level, total = after[context - 1], 0.0
        for i in range(context, stop - start):
            if level == 2:
                arc = arcs2[i]
                if arc == arc:  # not NaN
                    total += arc
                    level = after[i]
                    continue
                total += fails2[i]
                level = 1
            if level:
                arc = arcs1[i]
                if arc == arc:
                    total += arc
                    level = after[i]
                    continue
                total += fails1[i]
            total += root[i]
            level = after[i]
        return total


# ---- messages between blocks and buckets

_ASK = "bucket int, place int, block long, n int, codes binary, numbers binary"
_ANSWER = "trip int, place int, bucket int, block long, n int, numbers binary, distinct long"


def _message(block: Block, codes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """For each bucket and place (of words, pairs) the sorted codes, as differences, and their counts."""
    rows = []
    for place, (c, v) in enumerate(zip(codes, counts, strict=True)):
        into = c >> block.shift
        edges = np.searchsorted(into, np.arange(block.buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[b], edges[b + 1]
            inner = c[lo:hi] - (np.uint64(b) << block.shift)
            rows.append((b, place, block.number, hi - lo, pack(np.diff(inner, prepend=np.uint64(0))), pack(v[lo:hi])))
    cols = zip(*rows, strict=True) if rows else [[]] * 6
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, kinds, strict=True)], names=["bucket", "place", "block", "n", "codes", "numbers"])


def _summed(asked: DataFrame, trip: int) -> DataFrame:
    """To each message the sums, over all messages, of the counts of its codes; distinct: once a bucket, the codes with a count."""

    def run(table: pa.Table) -> pa.Table:
        blocks, sizes = table.column("block"), table.column("n").to_pylist()
        codes = np.concatenate([np.cumsum(unpack(x.as_py(), n, np.uint64), dtype=np.uint64) for x, n in zip(table.column("codes"), sizes, strict=True)])
        numbers = np.concatenate([unpack(x.as_py(), n, np.int64) for x, n in zip(table.column("numbers"), sizes, strict=True)])
        found, at = np.unique(codes, return_inverse=True)
        sums = np.bincount(at, numbers, len(found)).astype(np.int64)  # exact below 2 ** 53
        stops = np.cumsum(sizes)
        made = [pack(sums[at[b - n : b]]) for n, b in zip(sizes, stops.tolist(), strict=True)]
        distinct = [int((sums > 0).sum())] + [0] * (len(sizes) - 1)
        cols = [pa.array([trip] * len(sizes), pa.int32()), table.column("place"), table.column("bucket"), blocks, table.column("n"), pa.array(made, pa.binary()), pa.array(distinct, pa.int64())]
        return pa.Table.from_arrays(cols, names=["trip", "place", "bucket", "block", "n", "numbers", "distinct"])

    return asked.groupBy("bucket", "place").applyInArrow(run, _ANSWER)


def _answers(table: pa.Table, trip: int, places: int) -> list[np.ndarray]:
    """The numbers for all codes of each place; a place without codes has none."""
    got: list[list[tuple]] = [[] for _ in range(places)]
    for r in table.select(["trip", "place", "bucket", "n", "numbers"]).to_pylist():
        if r["trip"] == trip:
            got[r["place"]].append((r["bucket"], unpack(r["numbers"], r["n"], np.int64)))
    return [np.concatenate([np.zeros(0, np.int64), *(x for _, x in sorted(rows, key=lambda y: y[0]))]) for rows in got]


def with_lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """For each row id_col, held_out, n_tokens, n_known, train_tokens, base_score and score; fold 0 is held out."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), (fold(id_col, folds) == 0).alias("held_out"))
    kind, id_type = src.schema["id"].dataType.simpleString(), to_arrow_type(src.schema["id"].dataType)
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = spark.sparkContext.defaultParallelism + size // BUCKET_BYTES
    blocks = bucketed(src.mapInArrow(_blocks(id_type), _BLOCK.format(kind=kind)), "block", 2 * buckets, "lm_blocks")
    by_block = blocks.groupBy("block")

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield Block(row, buckets).asked()

    counts = stored(_summed(blocks.mapInArrow(count, _ASK), 1), "lm-counts")
    n, texts = blocks.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    # START is one of the distinct words where there is a training text
    distinct = (counts.where("place = 0").agg(F.sum("distinct")).first()[0] or 0) - (texts > 0)
    scale = n + ADD * (distinct + 1)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for row in left.to_pylist():
            block = Block(row, buckets)
            block.told(right)
            made.append(block.asked_triples())
        return pa.Table.from_batches(made)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(7)]
        for row in left.to_pylist():
            block = Block(row, buckets)
            block.told(right)
            block.told_triples(right)
            automaton = Automaton(block, scale)
            starts = block.stops - block.lengths
            base = np.concatenate(([0.0], np.cumsum(np.where(block.counted, automaton.arcs[0], 0.0))))
            known = np.concatenate(([0], np.cumsum(block.counted & automaton.known)))
            cols[0] += block.rows
            cols[1] += block.ids
            cols[2] += block.held
            cols[3] += (block.lengths - block.context).tolist()
            cols[4] += (known[block.stops] - known[starts]).tolist()
            cols[5] += (base[block.stops] - base[starts]).tolist()
            cols[6] += [automaton.traverse(c, a, b) for c, a, b in zip(block.context.tolist(), starts.tolist(), block.stops.tolist(), strict=True)]
        kinds = (pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["row", "id", "held_out", "n_tokens", "n_known", "base", "score"])

    triples = _summed(by_block.cogroup(counts.groupBy("block")).applyInArrow(ask, _ASK), 2)
    answers = counts.unionByName(triples).groupBy("block")
    pieces = by_block.cogroup(answers).applyInArrow(score, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    rows = pieces.groupBy("row").agg(F.first("id").alias("id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return rows.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_lm_scores(table(spark, sf_dir, "documents"))
