"""Operator 11, alignment of two tokenizers: lockstep vectorised merging.

A is a byte-level BPE, B a piece model with byte fallback; both encode a space and the text. The tokens of a batch of
documents lie end to end on one axis of bytes, as two sorted arrays of ends. One vector of pointers into A and one into B
hold the state of all documents of the batch: each step compares the ends under all pointers at once, moves those that are
behind (both, where they meet), and emits the places that met as cuts, each with its link of an A and a B token; documents
that have come to their end leave the vectors. A long document stands in them as several stretches of bytes, each with
pointers of its own, so that a step never moves one document only.

A's tokens come from its ranks by the public library, B's from its library unit by unit (spaces with the characters up to the
next space) through a table that belongs to a task and is emptied at a fixed size; no piece of B crosses from a unit to the
next, which is checked when the model is read. A text whose normalised form isn't itself, or whose tokens don't give
back its bytes, has no tokens.

Counts of id pairs are summed within documents, then over all of them. They return to the documents by a broadcast of the pairs
where these are at most MAX_BROADCAST_PAIRS (some 50 MB), and by a join that shuffles documents' pairs beyond.

Null and empty texts have no tokens: zeros and an empty digest. Very long texts are whole. Rows that repeat, and ids that
repeat or are null, are kept as they are; other columns are dropped, and a kept one with the name of a result gives way
to it. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_document, stored, table

MAX_UNITS = 300_000
#: Texts are merged together up to so many bytes; documents are split into stretches of so many.
BATCH_BYTES, STRETCH = 2 << 20, 2048
MAX_BROADCAST_PAIRS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes are their own characters, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a byte-level BPE; its merges must be in the order of their ids, as ranks are."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of = byte_alphabet()
    vocab = {t: i for t, i in model["vocab"].items() if all(c in of for c in t)}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):  # noqa: B905
        raise ValueError(f"{path}: merges aren't in the order of ids")
    left_out = set(vocab.values()) - set(merged)
    return {bytes(of[c] for c in t): i for t, i in vocab.items() if i not in left_out or len(t) == 1}


class Merged(NamedTuple):
    """A batch: ids of A and B of all its texts, where each text's begin, and the tokens that end at each cut."""

    a: np.ndarray
    b: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    ends: np.ndarray  # the byte after each token of A


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2

        ranks = read_ranks(a_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.a_bytes[i] = piece
        self.encode_a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", n) for n in names):
            raise ValueError(f"{b_path}: a piece goes on after a space")
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto()).normalizer_spec
        #: Whether B's normal form of every text is the text itself.
        self.identity = spec.name == "identity" and not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces
        #: Packed ids of B's units; None for those that don't give back their own bytes.
        self.units: dict[str, bytes | None] = {}
        self.split = re.compile(" +[^ ]*").findall
        lengths = lambda table: np.array(list(map(len, table)), np.int64)
        self.a_len, self.b_len = lengths(self.a_bytes), lengths(self.b_bytes)
        self.a_names, self.b_names = _decimals(len(self.a_bytes)), _decimals(len(self.b_bytes))

    def encode(self, texts: Sequence[str | None]) -> list[tuple[list[int], bytes]]:
        """A's ids and B's packed ids of each text; both empty for a text without tokens."""
        if len(self.units) > MAX_UNITS:
            self.units.clear()
        split = [self.split(" " + t) if t else [] for t in texts]
        self._learn({u for units in split for u in units} - self.units.keys())
        return [self._encode(t, units) if t else ([], b"") for t, units in zip(texts, split, strict=True)]

    def _learn(self, units: set[str]) -> None:
        new = list(units)
        # the library adds the first space itself, but not to nothing
        for unit, ids in zip(new, self.model.encode([u[1:] for u in new]), strict=True):
            ids = ids or [self.model.piece_to_id("▁")]
            self.units[unit] = array("i", ids).tobytes() if b"".join(map(self.b_bytes.__getitem__, ids)) == unit.encode() else None

    def _encode(self, text: str, units: list[str]) -> tuple[list[int], bytes]:
        full = " " + text
        found = list(map(self.units.__getitem__, units))
        # units stand for the text only if its normal form is the text itself
        if None in found or not (self.identity or self.model.normalize(text) == full.replace(" ", "▁")):
            return [], b""
        a = self.encode_a(full)
        return (a, b"".join(found)) if b"".join(map(self.a_bytes.__getitem__, a)) == full.encode() else ([], b"")

    def merge(self, texts: Sequence[str | None]) -> Merged:
        coded = self.encode(texts)
        starts = lambda counts: np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
        a_starts, b_starts = starts([len(a) for a, _ in coded]), starts([len(b) // 4 for _, b in coded])
        a = np.fromiter(chain.from_iterable(ids for ids, _ in coded), np.int64, a_starts[-1])
        b = np.frombuffer(b"".join(b for _, b in coded), "<i4").astype(np.int64)
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        borders = np.concatenate(([0], a_ends))[a_starts]
        if len(a) == 0:
            none = np.zeros(0, np.int64)
            return Merged(a, b, a_starts, b_starts, none, none, a_ends)
        borders = np.unique(np.concatenate((borders, np.arange(0, a_ends[-1], STRETCH))))
        return Merged(a, b, a_starts, b_starts, *lockstep(a_ends, b_ends, borders), a_ends)

    def group_texts(self, m: Merged) -> list[bytes]:
        """For each text `a1,a2|b1;a3|b2,b3`: its groups, one after the other."""
        width = max(self.a_names.shape[1], self.b_names.shape[1]) + 1
        out = np.zeros((len(m.a) + len(m.b), width), np.uint8)

        def group(cut: np.ndarray, n: int) -> np.ndarray:
            """The number of each token's group."""
            begun = np.zeros(n + 1, np.int64)
            begun[cut + 1] = 1
            return np.cumsum(begun)[:n]

        b_before = np.concatenate(([0], m.cut_b + 1))
        at_a = np.arange(len(m.a)) + b_before[group(m.cut_a, len(m.a))]
        at_b = np.arange(len(m.b)) + (m.cut_a + 1)[group(m.cut_b, len(m.b))]
        for at, names, ids, cut, mark in ((at_a, self.a_names, m.a, m.cut_a, b"|"), (at_b, self.b_names, m.b, m.cut_b, b";")):
            out[at, : names.shape[1]] = names[ids]
            out[at, -1] = ord(",")
            out[at[cut], -1] = mark[0]
        begin = m.a_starts + m.b_starts
        out[begin[1:][begin[1:] > begin[:-1]] - 1, -1] = 0  # nothing follows a text's last token
        return [out[s:e].tobytes().translate(None, b"\0") for s, e in zip(begin, begin[1:])]  # noqa: B905


def _decimals(n: int) -> np.ndarray:
    width = len(str(n))
    return np.array([str(i) for i in range(n)], f"S{width}").view(np.uint8).reshape(n, width)


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of A and of B that end together, in order; each stretch between two borders has its own pointers.

    A token belongs to the stretch in which it ends; a stretch without a border that both sides share ends where one side does.
    """
    i, j = np.searchsorted(a_ends, borders, "right"), np.searchsorted(b_ends, borders, "right")
    stop_i, stop_j = np.append(i[1:], len(a_ends)), np.append(j[1:], len(b_ends))
    cut_a, cut_b = [], []
    live = (i < stop_i) & (j < stop_j)
    while True:
        if not live.all():
            i, j, stop_i, stop_j = i[live], j[live], stop_i[live], stop_j[live]
        if not len(i):
            break
        a, b = a_ends[i], b_ends[j]
        met = a == b
        cut_a.append(i[met])
        cut_b.append(j[met])
        i = i + (a <= b)
        j = j + (b <= a)
        live = (i < stop_i) & (j < stop_j)
    join = lambda parts: np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return join(cut_a), join(cut_b)


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    """One for a worker, however many tasks it runs."""
    return Aligner(a_path, b_path)


def _batches(texts: list[str | None]):
    """The texts in runs of at most BATCH_BYTES characters, or of one."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > at and size + n > BATCH_BYTES:
            yield texts[at:k]
            at, size = k, 0
        size += n
    if at < len(texts):
        yield texts[at:]


def with_alignment(df: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each row a_ids, b_ids, and groups: in order, the numbers of A's and B's tokens and of bytes up to each group's end."""

    def call(texts):
        out: list[list] = [[], [], []]
        al = _aligner(a_path, b_path)
        for batch in _batches(texts):
            m = al.merge(batch)
            first = np.searchsorted(m.cut_a, m.a_starts)
            base = np.concatenate(([0], m.ends))
            for d in range(len(batch)):
                a0, b0, cuts = m.a_starts[d], m.b_starts[d], slice(first[d], first[d + 1])
                out[0].append(m.a[a0 : m.a_starts[d + 1]].astype(np.int32))
                out[1].append(m.b[b0 : m.b_starts[d + 1]].astype(np.int32))
                ends = m.ends[m.cut_a[cuts]] - base[a0]
                out[2].append([{"a": x, "b": y, "bytes": z} for x, y, z in zip((m.cut_a[cuts] + 1 - a0).tolist(), (m.cut_b[cuts] + 1 - b0).tolist(), ends.tolist(), strict=True)])
        return out

    return per_document(df, lambda: call, "a_ids array<int>, b_ids array<int>, groups array<struct<a:int,b:int,bytes:long>>", text_col, keep)


def _linked(df: DataFrame, a_path: str, b_path: str, text_col: str, keep: Sequence[str]) -> DataFrame:
    """For each row the figures of its alignment, and its distinct links as codes (A's id times B's size plus B's id) with their counts."""

    def call(texts):
        out: list[list] = [[] for _ in range(7)]
        al = _aligner(a_path, b_path)
        for batch in _batches(texts):
            m = al.merge(batch)
            first = np.searchsorted(m.cut_a, m.a_starts)
            of = np.repeat(np.arange(len(batch)), np.diff(first))
            code = m.a[m.cut_a] * len(al.b_bytes) + m.b[m.cut_b]
            key = np.sort(of << 40 | code)
            new = np.flatnonzero(np.diff(key, prepend=-1))
            times = np.diff(np.append(new, len(key)))
            code = key[new] & (1 << 40) - 1
            own = np.searchsorted(key[new] >> 40, np.arange(len(batch) + 1))
            groups = np.diff(first).tolist()
            made = [np.diff(m.a_starts).tolist(), np.diff(m.b_starts).tolist(), groups, groups]
            made.append([hashlib.sha256(x).hexdigest() if x else "" for x in al.group_texts(m)])
            for v in (code, times):
                made.append([v[s:e] for s, e in zip(own, own[1:])])  # noqa: B905
            for whole, part in zip(out, made, strict=True):
                whole += part
        return out

    names = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _pairs array<long>, _times array<long>"
    return per_document(df, lambda: call, names, text_col, keep, per_call=1024)


def with_link_counts(
    df: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), max_broadcast: int = MAX_BROADCAST_PAIRS
) -> DataFrame:
    """For each row n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    # the number of a row is stored with it: ids can repeat
    docs = stored(_linked(df, a_path, b_path, text_col, keep).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    links = docs.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("of")).select("_row", F.col("of._pairs").alias("pair"), F.col("of._times").alias("n"))
    pairs = stored(links.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    best = pairs.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("count").alias("most"))
    # one number says both: the count, below zero where another pair of the same B id has more
    marked = pairs.withColumn("b", F.col("pair") % b_size).join(best, "b").select("pair", F.when(F.col("count") == F.col("most"), F.col("count")).otherwise(-F.col("count")).alias("mark"))
    few = pairs.count() <= max_broadcast
    joined = links.join(F.broadcast(marked) if few else marked, "pair")
    sums = joined.groupBy("_row").agg(F.sum(F.when(F.col("mark") > 0, F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.abs("mark") * F.col("n")).alias("count_sum"))
    figures = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    kept = [c for c in keep if c not in figures]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.join(sums, "_row", "left").select(*[F.col(f"`{c}`") for c in kept], *[zero(c) if c in ("n_best", "count_sum") else F.col(c) for c in figures])


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return with_link_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
