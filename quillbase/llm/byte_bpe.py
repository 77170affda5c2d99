"""Operator 8, byte-level BPE: vectorised pre-tokenisation and cached pair merging.

Pre-tokenisation follows the public pattern (contractions, letters, numbers, other characters, each with one
space before them, and white space) without a regular expression. Each code point has a class from a table; classes
and their neighbours give each character a symbol, and a symbol is a function between four states: closed (the next
character begins a slice), open (its class may go on), after a space, and within a contraction. Functions are packed
in a byte, composition is a table of 256 x 256, and an associative scan over blocks composes them, so that
all states, hence all boundaries, of a batch of texts come from a few array operations.

A slice is looked up in a table of ids, and merged pair by pair (lowest rank first) when new; the table belongs to
a task and is emptied at a fixed size. The slices' offsets, in tokens and in bytes, are kept with the ids, and decoding goes by
them: all slices, or only those of a range of bytes.

A null text is empty: no ids, the digest of no bytes. A very long text is one batch of its own, a very long slice is merged with
a heap. Rows are kept as they are, whatever their ids; columns not asked for are dropped, and one asked for with the name
of a result gives way to it. An empty table gives an empty result. The file of ranks is a parameter, read in each task.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import per_document, table
from .token_counts import load_ranks

MAX_SLICES = 500_000
#: Texts are pre-tokenised together up to so many characters.
BATCH_CHARS = 1 << 20
ROW = 64
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Code points that are white space, and the endings after an apostrophe.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = "stmd", ("re", "ve", "ll")

CLOSED, OPEN, AFTER_SPACE, SHORTENED = range(4)
# symbols: a character of a run that goes on or begins, an apostrophe with a short form (likewise), the inner and
# last letter of a short form (likewise), inner white space (likewise), the last white space (a space or not), a start
SAME, OTHER_CLASS, Q_SAME, Q_NEW, IN_SAME, IN_NEW, END_SAME, END_NEW, W_SAME, W_NEW, LAST_SPACE, LAST_WHITE, FIRST = range(13)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed functions of the symbols, whether a boundary stands before them in each state, and composition."""
    after = np.zeros((13, 4), np.uint8)
    cut = np.zeros((13, 4), bool)
    for state in range(4):
        for same in (True, False):
            run = OPEN, state == CLOSED or state == OPEN and not same
            after[SAME if same else OTHER_CLASS, state], cut[SAME if same else OTHER_CLASS, state] = run
            q = run if state == AFTER_SPACE or state == OPEN and same else (SHORTENED, True)
            after[Q_SAME if same else Q_NEW, state], cut[Q_SAME if same else Q_NEW, state] = q
            inner = (SHORTENED, False) if state == SHORTENED else run
            after[IN_SAME if same else IN_NEW, state], cut[IN_SAME if same else IN_NEW, state] = inner
            last = (CLOSED, False) if state == SHORTENED else run
            after[END_SAME if same else END_NEW, state], cut[END_SAME if same else END_NEW, state] = last
            after[W_SAME if same else W_NEW, state], cut[W_SAME if same else W_NEW, state] = OPEN, not (same and state == OPEN)
        after[LAST_SPACE, state], cut[LAST_SPACE, state] = AFTER_SPACE, True
        after[LAST_WHITE, state], cut[LAST_WHITE, state] = CLOSED, True
    packed = sum(after[:, s].astype(np.uint8) << np.uint8(2 * s) for s in range(4)).astype(np.uint8)
    f = np.arange(256)
    get = lambda g, s: g >> 2 * s & 3
    first, second = f[:, None], f[None, :]
    composed = sum(get(second, get(first, s)) << 2 * s for s in range(4)).astype(np.uint8)
    return packed, cut, composed


def class_table() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for i in range(sys.maxunicode + 1):
        kind = kinds.get(unicodedata.category(chr(i))[0])
        if kind is not None:
            table[i] = kind
    table[WHITE] = SPACE
    return table


class PreTokenizer:
    def __init__(self) -> None:
        self.classes = class_table()
        self.packed, self.cut, self.composed = _tables()

    def states(self, symbols: np.ndarray) -> np.ndarray:
        """The state before each symbol, by an associative scan from the closed state."""
        n = len(symbols)
        rows = -(-n // ROW)
        f = np.full(rows * ROW, 0b11100100, np.uint8)  # the identity fills the last row
        f[:n] = self.packed[symbols]
        f = np.ascontiguousarray(f.reshape(rows, ROW).T)
        compose = self.composed.ravel()
        for j in range(1, ROW):
            f[j] = compose[f[j - 1].astype(np.uint16) << 8 | f[j]]
        block, step = f[-1].copy(), 1
        while step < rows:
            block[step:] = compose[block[:-step].astype(np.uint16) << 8 | block[step:]]
            step *= 2
        into = np.zeros(rows, np.uint8)
        into[1:] = block[:-1] & 3
        out = np.empty((ROW, rows), np.uint8)
        out[0] = into
        out[1:] = f[:-1] >> (2 * into) & 3
        return out.T.ravel()[:n]

    def boundaries(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the slices of texts begin; codes: their code points, joined; starts: where each text begins."""
        n = len(codes)
        kind = self.classes[codes]
        first = np.zeros(n + 1, bool)
        first[starts] = True
        first[n] = True
        same = np.zeros(n, bool)
        same[1:] = kind[1:] == kind[:-1]
        same[first[:-1]] = False
        white = kind == SPACE
        inner = white.copy()  # white space that more white space or the end of its text follows
        inner[:-1] &= white[1:] | first[1:-1]
        last = white & ~inner
        symbols = np.where(same, np.uint8(SAME), np.uint8(OTHER_CLASS))
        symbols[inner] = np.where(same[inner], W_SAME, W_NEW)
        symbols[last] = np.where(codes[last] == 32, LAST_SPACE, LAST_WHITE)
        quotes = np.flatnonzero(codes == 39)
        if len(quotes):
            end = np.append(starts, n)[np.searchsorted(starts, quotes, "right")]
            at1, at2 = np.minimum(quotes + 1, n - 1), np.minimum(quotes + 2, n - 1)
            one = np.isin(codes[at1], [ord(c) for c in SHORT]) & (quotes + 1 < end)
            two = np.zeros(len(quotes), bool)
            for a, b in LONG:
                two |= (codes[at1] == ord(a)) & (codes[at2] == ord(b))
            two &= quotes + 2 < end
            q = quotes[one | two]
            symbols[q] = np.where(same[q], Q_SAME, Q_NEW)
            q = np.concatenate((quotes[one] + 1, quotes[two] + 2))
            symbols[q] = np.where(same[q], END_SAME, END_NEW)
            q = quotes[two] + 1
            symbols[q] = np.where(same[q], IN_SAME, IN_NEW)
        cut = self.cut[symbols, self.states(symbols)]
        cut[first[:-1]] = True
        return np.flatnonzero(cut)


def merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Ids after merging the pair of lowest rank, the leftmost of equals, as long as there is one."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 200:
        return _merge_long(ranks, piece)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    none = 1 << 40
    scores = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while scores:
        low = min(scores)
        if low == none:
            break
        i = scores.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = get(parts[i] + parts[i + 1], none)
        if i:
            scores[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """merge() with a heap, for slices so long that shifting lists would be quadratic."""
    import heapq

    n = len(piece)
    after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if stop[i] else n
        if not stop[i] or j >= n or stop[j] != end:
            continue
        stop[i], stop[j] = end, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            new = stop[after[i]]
            if (r := ranks.get(piece[i:new])) is not None:
                heapq.heappush(heap, (r, i, new))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : end])) is not None:
            heapq.heappush(heap, (r, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = after[i]
    return out


class _Slices(dict):
    """Packed ids of each slice."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        found = np.array(merge(self.ranks, piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = found
        return found


class Encoded(NamedTuple):
    """Ids as little-endian 32-bit integers, and where each slice begins in tokens and in bytes (and where the last one ends)."""

    ids: bytes
    tokens: np.ndarray
    starts: np.ndarray


class Codec:
    def __init__(self, ranks: dict[bytes, int]):
        self.slices = _Slices(ranks)
        self.split = PreTokenizer()
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece

    def encode(self, texts: list[str]) -> list[Encoded]:
        out: list[Encoded] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
                size += len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[str]) -> list[Encoded]:
        if len(self.slices) > MAX_SLICES:
            self.slices.clear()
        joined = "".join(texts)
        if not joined:
            return [Encoded(b"", np.zeros(1, np.int64), np.zeros(1, np.int64))] * len(texts)
        lengths = np.array([len(t) for t in texts])
        begin = np.concatenate(([0], np.cumsum(lengths)))
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cuts = self.split.boundaries(codes, begin[:-1][lengths > 0])
        per_text = np.searchsorted(cuts, begin).tolist()
        ends = cuts.tolist()
        ends.append(len(joined))
        pieces = [joined[a:b] for a, b in zip(ends, ends[1:])]  # noqa: B905
        ids = list(map(self.slices.__getitem__, pieces))
        width = np.uint8(1) + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        bytes_before = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))[ends]
        tokens_before = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)))
        return [Encoded(b"".join(ids[a:b]), tokens_before[a : b + 1] - tokens_before[a], bytes_before[a : b + 1] - bytes_before[a]) for a, b in zip(per_text, per_text[1:])]  # noqa: B905

    def decode(self, encoded: Encoded, first: int = 0, stop: int | None = None) -> bytes:
        """The bytes from first to stop, of the slices that hold them; slices that aren't as long as their offsets say are an error."""
        starts = encoded.starts
        stop = int(starts[-1]) if stop is None else min(stop, int(starts[-1]))
        if first >= stop:
            return b""
        a, b = int(np.searchsorted(starts, first, "right")) - 1, int(np.searchsorted(starts, stop))
        ids = np.frombuffer(encoded.ids, "<u4")[encoded.tokens[a] : encoded.tokens[b]]
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        if len(data) != starts[b] - starts[a]:
            raise ValueError("the ids don't fit the offsets of their slices")
        return data[first - int(starts[a]) : stop - int(starts[a])]

    def token_offsets(self, encoded: Encoded) -> np.ndarray:
        """The byte at which each token begins: within its slice by the tokens' lengths, the slice by its offset."""
        lengths = np.array([len(self.bytes[i]) for i in np.frombuffer(encoded.ids, "<u4").tolist()], np.int64)
        running = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(encoded.tokens) - 1), np.diff(encoded.tokens))
        return encoded.starts[of] + running - running[encoded.tokens[of]] if len(of) else running


def with_token_ids(df: DataFrame, ranks_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row token_ids."""

    def make():
        codec = Codec(load_ranks(ranks_path))
        return lambda texts: [[np.frombuffer(x.ids, "<i4") for x in codec.encode([t or "" for t in texts])]]

    return per_document(df, make, "token_ids array<int>", text_col, keep)


def with_token_digests(df: DataFrame, ranks_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """For each row n_tokens, ids_sha256, decoded_sha256, and token_ids if asked for; decoding goes by the ids and the slices' offsets."""

    def make():
        codec = Codec(load_ranks(ranks_path))

        def call(texts):
            coded = codec.encode([t or "" for t in texts])
            digests = [hashlib.sha256(x.ids).hexdigest() for x in coded]
            decoded = [hashlib.sha256(codec.decode(x)).hexdigest() for x in coded]
            return [[len(x.ids) // 4 for x in coded], digests, decoded] + ([[np.frombuffer(x.ids, "<i4") for x in coded]] if ids else [])

        return call

    return per_document(df, make, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids, text_col, keep)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return with_token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
