"""Operator 2, near-duplicates by SimHash and a hierarchical index in Gray order.

Fingerprints: 64 bits over the 3-word shingles of the whole text, as with_fingerprints() says.

Links: two fingerprints link if at most 3 bits differ. Equal fingerprints are first merged, so copies never meet
as pairs. The index is one per group of a partitioning: with the bits in four blocks, two fingerprints that link agree
in one block, so each is dealt to four groups by the leading bits of its blocks, as many bits as leave some
thousands of members in a group. A group over MAX_GROUP is dealt out again by four blocks of the bits still free, and so
on; every group that one task holds is bounded and no pair is lost.

A group's index: members sorted by Gray rank, with the bits that all members of the group share last, so that neighbours
share long bit patterns. A node of an upper level holds the bits on which its NODE children agree. The search starts at pairs
of top nodes, adds up the differences of their agreed bits, prunes all pairs below two nodes with more than 3, and descends
into the others. A group returns a spanning forest of its links, not all pairs.

A wider reach, for a given Jaccard similarity of five-word shingles (similar_groups): sketches are of distinct shingles, the
fingerprint's bits are cut into PARTS, each with its own groups and index, in which its bits lead and pairs differ in at most 3
of them. Of pairs with a similarity of 0.8 (0.85), 94 (98) in 100 have such a part, if bits differ at random. Pairs found so
that the longer sketch takes for nearly similar make the forests, closest pairs first, and only pairs whose texts have the
similarity exactly become links. Before texts are compared, pairs go whose sets of shingles can't have it: the sets differ in at
least as many shingles as in parities of the numbers of shingles on each of PARITIES places. Groups with a refuted pair are searched again, among
the members that have candidates, without the pairs refuted so far and with four times as many forests as before, between the clusters that verified links have left; this ends when a round refutes nothing, so
every candidate is verified, or its texts are linked otherwise. Texts of one sketch are held against the first of them; those
that have the similarity stand in the index by it, the others by themselves. Members of a large group whose part is
used up, or whose bits don't tell most of them apart, go to groups of all pairs of chunks.

Components: large-star and small-star steps over the links, each written to the shared folder.

A null or empty text has no words, hence fingerprint zero. Very long texts are whole: their shingles are hashed and
counted 4096 at a time. A null id takes part in linking but is never a component id; a component of null ids alone
has a null component id. Repeated rows are kept. An empty table gives an empty result. Columns other than the id
(and those asked for) are dropped, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, per_document, stored, table

BITS = 64
DISTANCE = 3
BLOCKS = DISTANCE + 1
SHINGLE = 3
SEED = 42
MAX_GROUP = 16384
NODE = 2
#: The top level has at most so many nodes, all pairs of which are looked at.
TOP = 16
#: Pairs of nodes that are descended into at once.
STEP = 1 << 16
#: As many bits tell groups apart as leave at most this part of MAX_GROUP members in one, about; and with a wider reach.
AIM, WIDE_AIM = 0.6, 0.25
#: Of similar_groups: words of a shingle, 64-bit words of a sketch, parts of the indexed fingerprint.
SIMILAR_SHINGLE, SKETCH, PARTS = 5, 4, 3
#: Candidates differ in at most so many bits of the fingerprint (unlike ones in 32, about), and their sketches may look this much less similar.
WIDEST, SLACK = 20, 0.12
#: Places of a set's parities, and pairs that are held against each other by them at once.
PARITIES, AT_ONCE = 2048, 1 << 15


# ---- fingerprints


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    data = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    n = max(1, len(split) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[len(split) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def _majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """Words of 64 bits; a bit is 1 if it is set in over half the hashes; words after the first are of hashes mixed from them."""
    n = len(hashes)
    salts = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(BITS * words, np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096, None]
        if words > 1:
            part = np.concatenate((part, _mixed(part + salts[1:])), axis=1)
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


def sketch(text: str | None, shingle: int = SHINGLE, words: int = 1, distinct: bool = False) -> np.ndarray:
    """The majority bits of a text's shingles, or of the distinct ones."""
    hashes = _hashes(text, shingle)
    return _majority(np.unique(hashes) if distinct else hashes, words)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Words of 64 bits: whether an odd number of the hashes falls on each of PARITIES places."""
    odd = np.bincount((_mixed(hashes) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def can_reach(odd_a: np.ndarray, odd_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these parities and sizes can have that Jaccard similarity; never false where they have it.

    An element of one set alone turns one parity, so sets differ in no fewer elements than their parities do.
    """
    apart = np.bitwise_count(odd_a ^ odd_b).sum(axis=1, dtype=np.int64)
    apart = np.maximum(apart, np.abs(size_a - size_b))
    total = size_a + size_b
    return apart * (1 + similarity) <= total * (1 - similarity) + 1e-6 * (total + 1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the XXH64 hashes of the shingles."""
    return int(sketch(text, shingle)[0])


def with_fingerprints(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """Column fp, the fingerprint as a signed long. Text: A-Z lower-cased, words between ASCII white space."""

    def call(texts):
        return [np.array([sketch(t, shingle)[0] for t in texts], np.uint64).view(np.int64)]

    return per_document(df, lambda: call, "fp long", text_col, keep)


def with_sketches(df: DataFrame, text_col: str, keep: tuple[str, ...], shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """Columns fp and bits, a sketch of the distinct shingles and its first word, digest, 128 bits of the words of the text, and size and odd, the number and parities of the shingles."""

    def call(texts):
        sets = [np.unique(_hashes(t, shingle)) for t in texts]
        made = np.array([_majority(x, SKETCH) for x in sets], np.uint64).reshape(-1, SKETCH)
        digests = [xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts]
        return [np.ascontiguousarray(made[:, 0]).view(np.int64), [x.tobytes() for x in made], digests, [len(x) for x in sets], [parities(x).tobytes() for x in sets]]

    return per_document(df, lambda: call, "fp long, bits binary, digest binary, size long, odd binary", text_col, keep)


# ---- the index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _nodes(same: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper nodes of each NODE consecutive nodes: the bits on which all agree, and their values."""
    at = np.arange(0, len(same), NODE)
    ones = np.bitwise_and.reduceat(pattern, at)
    zeros = np.bitwise_and.reduceat(~pattern, at)
    agreed = np.bitwise_and.reduceat(same, at) & (ones | zeros)
    return agreed, ones & agreed


class GrayIndex:
    """Nodes over codes in Gray order; visited and pruned count pairs of nodes."""

    def __init__(self, codes: np.ndarray):
        self.levels = [(np.full(len(codes), ~np.uint64(0)), codes)]
        while len(self.levels[-1][0]) > TOP:
            self.levels.append(_nodes(*self.levels[-1]))
        self.visited = self.pruned = 0

    def near_pairs(self, distance: int = DISTANCE, head: int = BITS, within: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs i < j of codes that differ in at most `distance` bits, and `within` of their first `head` bits; some at a time."""
        first = np.uint64((1 << BITS) - (1 << (BITS - head)))
        inner_a, inner_b = (x.ravel() for x in np.meshgrid(np.arange(NODE), np.arange(NODE), indexing="ij"))

        def below(level, a, b):
            same, pattern = self.levels[level]
            apart = (pattern[a] ^ pattern[b]) & same[a] & same[b]
            near = np.bitwise_count(apart) <= distance
            if head < BITS:
                near &= np.bitwise_count(apart & first) <= within
            self.visited += len(a)
            a, b = a[near], b[near]
            if not level:
                yield a, b
                return
            self.pruned += len(near) - len(a)
            n = len(self.levels[level - 1][0])
            for at in range(0, len(a), STEP):
                x = (a[at : at + STEP, None] * NODE + inner_a).ravel()
                y = (b[at : at + STEP, None] * NODE + inner_b).ravel()
                fits = (x <= y if level > 1 else x < y) & (x < n) & (y < n)
                yield from below(level - 1, x[fits], y[fits])

        top = len(self.levels) - 1
        yield from below(top, *np.triu_indices(len(self.levels[top][0]), int(top == 0)))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the clusters of pairs (a, b) in label; the pairs that joined two."""
    used: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        high, first = np.unique(np.maximum(x, y), return_index=True)  # each cluster joins one with a smaller label
        label[high] = np.minimum(x, y)[first]
        used.append((a[first], b[first]))
        while (deeper := label[label] != label).any():
            label[deeper] = label[label[deeper]]
    return tuple(np.concatenate(x) for x in zip(*used, strict=True)) if used else (a, b)


def _pair_codes(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(a, b) * n + np.maximum(a, b)


def forest(
    codes: np.ndarray,
    bits: np.ndarray | None = None,
    most: int = 0,
    distance: int = DISTANCE,
    head: int = BITS,
    label: np.ndarray | None = None,
    without: np.ndarray | None = None,
    times: int = 1,
    possible=None,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that link: a spanning forest of the links between codes, or between clusters of them (label).

    bits: a sketch for each code, of which linked ones differ in at most `most` bits; closer pairs come first.
    without: pairs not to use, as _pair_codes(), sorted. times: so many forests, each of the links that those before it leave.
    possible: of at most AT_ONCE pairs of places, which to use.
    """
    order = np.argsort(gray_rank(codes), kind="stable")
    index = GrayIndex(codes[order])
    label = np.arange(len(codes)) if label is None else label
    labels = [label.copy() for _ in range(times)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    limits = [0] if bits is None else [most // 3, 2 * most // 3, most]
    for below, limit in zip([-1, *limits], limits):  # noqa: B905
        for a, b in index.near_pairs(distance, head):
            a, b = order[a], order[b]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if bits is not None:
                differing = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int32)
                near = (differing <= limit) & (differing > below)
                a, b = a[near], b[near]
            if without is not None and len(without):
                code = _pair_codes(a, b, len(codes))
                new = without[np.minimum(np.searchsorted(without, code), len(without) - 1)] != code
                a, b = a[new], b[new]
            if possible is not None and len(a):
                fits = np.concatenate([possible(a[at : at + AT_ONCE], b[at : at + AT_ONCE]) for at in range(0, len(a), AT_ONCE)])
                a, b = a[fits], b[fits]
            for own in labels:
                if not len(a):
                    break
                used = _joined(own, a, b)
                found.append(used)
                if times > 1 and len(used[0]):
                    rest = ~np.isin(_pair_codes(a, b, len(codes)), _pair_codes(*used, len(codes)))
                    a, b = a[rest], b[rest]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (label[:0], label[:0])


# ---- groups


def _part_bits(parts: int) -> list[range]:
    cuts = [round(k * BITS / parts) for k in range(parts + 1)]
    return [range(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _blocks(free: list[int], bits: int = BITS) -> list[int]:
    """Masks of up to `bits` leading bits of each of the BLOCKS blocks of some free bits."""
    cuts = [round(k * len(free) / BLOCKS) for k in range(BLOCKS + 1)]
    return [sum(1 << i for i in free[max(a, b - bits) : b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


_KEYS = ["part", "mask", "value", "low", "high"]


def dealt(codes: DataFrame, n: int, parts: int = 1, aim: float = AIM) -> DataFrame:
    """n codes (node, fp and other columns) in groups by _KEYS, none of over MAX_GROUP members; stored."""
    spark = codes.sparkSession
    free = _part_bits(parts)
    lead = max(0, math.ceil(math.log2(max(1, n / (aim * MAX_GROUP)))))
    groups = sorted({(part, mask) for part in range(parts) for mask in _blocks(list(free[part]), lead)})
    held = codes.columns
    whole = [F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high")]
    rows = codes.select(*held, F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(_signed(m)).alias("mask")) for p, m in groups])).alias("g"))
    rows = rows.select(*held, "g.part", "g.mask", F.lit(n).cast("long").alias("above"))
    found = None
    while True:
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        # tight: of the group that was dealt out, most members are still together
        tight = F.count(F.lit(1)) > F.max("above") * 0.6
        sizes = rows.groupBy("part", "mask", "value").agg(F.count(F.lit(1)).alias("n"), tight.alias("tight")).where(F.col("n") > MAX_GROUP)
        hot = stored(sizes, "simhash-groups")
        if hot.isEmpty():
            hot = None
        cold = (rows if hot is None else rows.join(hot, ["part", "mask", "value"], "left_anti")).select(*held, "part", "mask", "value", *whole)
        found = cold if found is None else found.unionByName(cold)
        if hot is None:
            return stored(found, "simhash-dealt")
        deeper = {(p, m): [m | x for x in _blocks(f)] for p, m in groups if len(f := [i for i in free[p] if not m >> i & 1]) >= 3 * BLOCKS}
        spent = [(p, _signed(m)) for p, m in groups if (p, m) not in deeper]
        full = spark.createDataFrame(spent, "part int, mask long").withColumn("spent", F.lit(True))
        hot = hot.join(F.broadcast(full), ["part", "mask"], "left").withColumn("spent", F.coalesce("spent", F.lit(False)) | F.col("tight"))
        if not hot.where("spent").isEmpty():
            # few bits of the part are left, or they don't tell members apart: all pairs of chunks of such a group
            pieces = rows.join(hot.where("spent"), ["part", "mask", "value"]).withColumn("k", F.ceil(F.col("n") * 2 / MAX_GROUP))
            own = F.pmod(F.xxhash64("node"), F.col("k"))
            pairs = pieces.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).where("other <> own")
            found = found.unionByName(pairs.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).select(*held, *_KEYS))
        if not deeper or hot.where("not spent").isEmpty():
            return stored(found, "simhash-dealt")
        new = spark.createDataFrame([(p, _signed(m), [_signed(x) for x in masks]) for (p, m), masks in deeper.items()], "part int, mask long, masks array<long>")
        # at most parts * BLOCKS ** levels masks exist
        rows = rows.join(hot.where("not spent").select("part", "mask", "value", "n"), ["part", "mask", "value"]).join(F.broadcast(new), ["part", "mask"])
        rows = rows.select(*held, "part", F.explode("masks").alias("mask"), F.col("n").alias("above"))
        groups = sorted({(p, x) for (p, _), masks in deeper.items() for x in masks})


def _codes_of(key, table: pa.Table, free: list[range]) -> tuple[np.ndarray, int]:
    """The fingerprints of a group, turned so that the bits that tell them apart lead, and how many of those are of its part."""
    fps = table.column("fp").to_numpy().view(np.uint64)
    part = free[key[0].as_py()]
    stop = part.stop
    if len(part) == BITS and (mask := key[1].as_py() % (1 << BITS)):
        stop = (mask & -mask).bit_length() - 1  # the bits below those that the group shares
    turn = np.uint64((BITS - stop) % BITS)
    return (fps << turn | fps >> (np.uint64(BITS) - turn) if turn else fps), len(part)


_LINKS = "u long, v long"


def _pairs(*columns: np.ndarray, names: list[str] = ["u", "v"]) -> pa.Table:  # noqa: B006
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def links(codes: DataFrame, n: int, parts: int = 1) -> DataFrame:
    """Edges (u, v) of spanning forests, from n distinct codes (node, fp): their components are those of all links."""
    free = _part_bits(parts)

    def link(key, table):
        fps, head = _codes_of(key, table, free)
        nodes = table.column("node").to_numpy()
        a, b = forest(fps, distance=DISTANCE, head=head)
        return _pairs(nodes[a], nodes[b])

    return dealt(codes.select("node", "fp"), n, parts).groupBy(*_KEYS).applyInArrow(link, _LINKS)


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binary values of one length as rows of 64-bit words."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1)


def verified_links(codes: DataFrame, n: int, parts: int, most: int, verify, sets=None, similarity: float = 0.0) -> DataFrame:
    """Edges (u, v) from n codes (node, fp, bits) whose sketches differ in at most `most` bits and that verify(edges) leaves.

    Their components are those of all such edges between members of one group. sets(nodes): node, size and odd of
    some nodes, by which the searches after the first leave out pairs that can't have the similarity.
    """
    free = _part_bits(parts)
    bounded = sets is not None

    def linkers(times: int):
        def link(key, table, wrong):
            names = [*_KEYS, "u", "v"]
            fps, head = _codes_of(key, table, free)
            nodes = table.column("node").to_numpy()
            bits = _words(table.column("bits"))
            label, without, possible = None, np.zeros(0, np.int64), None
            if wrong is not None:
                # a cluster's label is the place of its first member
                _, first, which = np.unique(table.column("root").to_numpy(), return_index=True, return_inverse=True)
                label = first[which]
                order = np.argsort(nodes)
                u, v = (order[np.searchsorted(nodes[order], wrong.column(c).to_numpy())] for c in "uv")
                without = np.sort(_pair_codes(u, v, len(nodes)))
                if bounded:
                    odd, sizes = _words(table.column("odd")), table.column("size").to_numpy()
                    possible = lambda a, b: can_reach(odd[a], odd[b], sizes[a], sizes[b], similarity)
            a, b = forest(fps, bits, most, WIDEST, head, label, without, times, possible)
            u, v = nodes[a], nodes[b]
            return _pairs(*[np.full(len(u), k.as_py(), np.int64) for k in key], u, v, names=names)

        return (lambda key, table: link(key, table, None)), link

    rows = dealt(codes.select("node", "fp", "bits"), n, parts, WIDE_AIM)
    found = refuted = roots = None
    forests = 1
    while True:
        first, again = linkers(forests)
        schema = ", ".join(f"{c} long" for c in [*_KEYS, "u", "v"])
        if refuted is None:
            tried = rows.groupBy(*_KEYS).applyInArrow(first, schema)
        else:
            left = rows.join(refuted.select(*_KEYS).distinct(), _KEYS, "left_semi").join(roots.withColumnRenamed("node", "_of"), F.col("node") == F.col("_of"), "left")
            left = left.withColumn("root", F.coalesce("root", "node")).drop("_of")
            keyed = [F.col(c).cast(rows.schema[c].dataType).alias(c) for c in _KEYS]
            tried = left.groupBy(*_KEYS).cogroup(refuted.select(*keyed, "u", "v").groupBy(*_KEYS)).applyInArrow(again, schema)
        tried = stored(tried, "simhash-tried")
        if found is not None and tried.isEmpty():
            return found
        pairs = tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        true = stored(verify(pairs), "simhash-edges")
        found = true if found is None else found.unionByName(true)
        wrong = tried.join(true.select(F.col("u").alias("x"), F.col("v").alias("y")), (F.least("u", "v") == F.col("x")) & (F.greatest("u", "v") == F.col("y")), "left_anti")
        wrong = stored(wrong, "simhash-refuted")
        if wrong.isEmpty():
            return found
        if refuted is None:
            # a forest reaches every member that has a candidate in its group; the others needn't be searched again
            ends = tried.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in _KEYS], F.explode(F.array("u", "v")).alias("node")).distinct()
            rows = rows.join(wrong.select(*_KEYS).distinct(), _KEYS, "left_semi").join(ends, [*_KEYS, "node"], "left_semi")
            if bounded:
                rows = rows.join(sets(ends.select("node").distinct()), "node")
            rows = stored(rows, "simhash-dealt")
        refuted = wrong if refuted is None else wrong.unionByName(refuted.join(wrong.select(*_KEYS).distinct(), _KEYS, "left_semi"))
        if roots is None or not true.isEmpty():
            roots = components(found)
        forests *= 4


# ---- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v): root is the smallest node of its component.

    Large-star and small-star steps until nothing changes; each is one aggregate and one join that can split hot keys.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "components")
    before = None
    while True:
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == before or not sums[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(sums)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = stored(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = stored(small.unionByName(least.select("u", F.col("low").alias("v"))).distinct(), "components")
        drop_stored(edges)
        drop_stored(large)
        edges = after


def _named(docs: DataFrame, codes: DataFrame, edges: DataFrame, on: str, id_col: str, keep: tuple[str, ...]) -> DataFrame:
    """One row for each row of docs: id_col, keep, fp, root (never null) and component_id, from codes (on, node, first) and edges between nodes."""
    joined = components(edges).withColumnRenamed("node", "linked")
    roots = codes.join(joined, codes["node"] == joined["linked"], "left").select(on, "first", F.coalesce("root", "node").alias("root"))
    named = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    by_code = roots.join(named, "root").select(F.col(on).alias("__on__"), "root", "component_id")
    return docs.join(by_code, F.col(on) == F.col("__on__")).select(F.col(f"`{id_col}`"), *keep, "fp", "root", "component_id")


def with_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: id_col, the columns keep, fp, root (the component, never null) and component_id."""
    docs = stored(with_fingerprints(df, text_col, (id_col, *keep)), "simhash")
    codes = stored(docs.groupBy("fp").agg(F.min(F.col(f"`{id_col}`")).alias("first")).withColumn("node", F.col("fp")), "simhash-codes")
    return _named(docs, codes, links(codes, codes.count()), "fp", id_col, keep)


def differing(similarity: float, bits: int = SKETCH * BITS) -> int:
    """How many of a sketch's bits are expected to differ at a Jaccard similarity of equally large sets."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def shingles(text: str | None, shingle: int = SIMILAR_SHINGLE) -> set[bytes]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def _possible(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges whose sets (node, size, odd) can have that Jaccard similarity."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                size_u, size_v = (part.column(c).to_numpy() for c in ("size_u", "size_v"))
                fits = can_reach(_words(part.column("odd_u")), _words(part.column("odd_v")), size_u, size_v, similarity)
                yield part.select(["u", "v"]).filter(pa.array(fits, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("odd").alias(f"odd_{c}")) for c in "uv")
    return edges.join(left, "u").join(right, "v").mapInArrow(run, "u long, v long")


def _similar(edges: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The edges whose texts (node, __whole__) have that Jaccard similarity."""

    def run(batches):
        for batch in batches:
            fits = []
            for k in range(batch.num_rows):
                a, b = (shingles(batch.column(c)[k].as_py(), shingle) for c in (2, 3))
                shared = len(a & b)
                fits.append(not a and not b or shared >= similarity * (len(a) + len(b) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(fits, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(c), F.col("__whole__").alias(f"text_{c}")) for c in "uv")
    return edges.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), similarity: float = 0.8, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """As with_groups, by the Jaccard similarity of the texts' sets of five-word shingles; texts of equal words are equal."""
    whole = with_sketches(df.withColumn("__whole__", F.col(f"`{text_col}`").cast("string")), "__whole__", (id_col, "__whole__", *keep), shingle)
    whole = stored(whole, "simhash-texts")
    docs = stored(whole.drop("__whole__", "size", "odd"), "simhash")
    codes = docs.groupBy("digest").agg(F.min(F.col(f"`{id_col}`")).alias("first"), F.first("fp").alias("fp"), F.first("bits").alias("bits"))
    codes = stored(codes.withColumn("node", F.monotonically_increasing_id()), "simhash-codes")

    def of_nodes(ends: DataFrame, *columns: str) -> DataFrame:
        """node and these columns of a text of each end (node, digest)."""
        rows = whole.select("digest", *columns).join(ends.select("digest"), "digest", "left_semi")
        return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in columns]).join(ends, "digest").select("node", *columns)

    def with_digests(nodes: DataFrame) -> DataFrame:
        # stored, so that Spark knows before it shuffles texts whether they are few
        return stored(nodes.join(codes.select("node", "digest"), "node"), "simhash-ends")

    def ends_of(edges: DataFrame) -> DataFrame:
        return with_digests(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct())

    def sets(nodes: DataFrame) -> DataFrame:
        return of_nodes(with_digests(nodes), "size", "odd")

    def verify(edges: DataFrame) -> DataFrame:
        edges = stored(edges, "simhash-pairs")
        edges = stored(_possible(edges, of_nodes(ends_of(edges), "size", "odd"), similarity), "simhash-pairs")
        return _similar(edges, of_nodes(ends_of(edges), "__whole__"), similarity, shingle)

    # the first text of each sketch stands for those that are similar to it
    firsts = codes.groupBy("bits").agg(F.min("node").alias("v"))
    near = stored(verify(codes.join(firsts, "bits").where("node <> v").select(F.col("node").alias("u"), "v")), "simhash-edges")
    alone = stored(codes.join(near.select(F.col("u").alias("node")), "node", "left_anti"), "simhash-codes")
    edges = stored(near.unionByName(verified_links(alone, alone.count(), PARTS, differing(similarity - SLACK), verify, sets, similarity)), "simhash-edges")
    drop_stored(whole)
    return _named(docs, codes, edges, "digest", id_col, keep)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col, fingerprint (16 hex digits), component_id."""
    return with_groups(df, id_col, text_col).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
