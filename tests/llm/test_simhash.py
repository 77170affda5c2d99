import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillbase.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(codes):
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    codes = sorted(codes)
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


@pytest.fixture(scope="module")
def codes():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    near = [int(c) ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5))}) for c in centres for _ in range(12)]
    dense = [int(centres[0]) ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 64, (150, 2))]
    return sorted({int(c) for c in centres} | set(near) | set(dense) | {0})


def test_fingerprints():
    for text in ("One two THREE four five", "a", "a b", "", None, "x y z " * 50, "Émile ÉMILE émile é"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_pairs_are_all_pairs(codes):
    array = np.array(codes, np.uint64)
    array = array[np.argsort(simhash.gray_rank(array))]
    index = simhash.GrayIndex(array)
    got = {(int(array[i]), int(array[j])) for a, b in index.near_pairs() for i, j in zip(a, b, strict=True)}
    got = {(min(p), max(p)) for p in got}
    assert got == {(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 3}
    assert index.pruned > 0


def test_the_index_prunes_on_the_tables(spark):
    """On real fingerprints whole nodes are pruned, and what is left are all pairs."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    array = np.array(sorted({simhash.fingerprint(t) for t in texts}), np.uint64)
    array = array[np.argsort(simhash.gray_rank(array))]
    index = simhash.GrayIndex(array)
    got = {(int(i), int(j)) for a, b in index.near_pairs() for i, j in zip(a, b, strict=True)}
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 3
    assert got == {(int(i), int(j)) for i, j in np.argwhere(np.triu(near, 1))}
    assert index.pruned > 0 and index.visited < 0.2 * len(array) ** 2 / 2
    within = {(int(i), int(j)) for a, b in simhash.GrayIndex(array).near_pairs(11, 21) for i, j in zip(a, b, strict=True)}
    head = np.bitwise_count((array[:, None] ^ array[None, :]) >> np.uint64(43)) <= 3
    assert within == {(int(i), int(j)) for i, j in np.argwhere(np.triu(head & (np.bitwise_count(array[:, None] ^ array[None, :]) <= 11), 1))}


def test_the_index_visits_few_pairs(spark):
    """On the larger table's fingerprints, which are one group, under a tenth of all pairs of nodes are looked at."""
    rows = simhash.with_fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("fp").distinct().collect()
    array = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    assert len(array) <= simhash.AIM * simhash.MAX_GROUP
    index = simhash.GrayIndex(array[np.argsort(simhash.gray_rank(array))])
    found = sum(len(a) for a, _ in index.near_pairs())
    assert found and index.visited < 0.1 * len(array) * (len(array) - 1) / 2


def grouped(codes, got):
    mine = {}
    for c in codes:
        mine.setdefault(got.get(c, c), set()).add(c)
    return sorted(map(sorted, mine.values()))


@pytest.mark.parametrize("most", [8192, 64])
def test_components(spark, codes, most, monkeypatch):
    """Also where groups are dealt out again and again."""
    monkeypatch.setattr(simhash, "MAX_GROUP", most)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    df = spark.createDataFrame(signed, "fp long").withColumn("node", F.col("fp"))
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(df, len(codes))).collect()}
    assert grouped(codes, got) == grouped(codes, brute_components(codes))


@pytest.mark.parametrize("most", [8192, 16])
def test_parts(spark, codes, most, monkeypatch):
    """Three parts find all pairs of up to 11 bits, also through chunks of groups whose part is used up."""
    monkeypatch.setattr(simhash, "MAX_GROUP", most)
    monkeypatch.setattr(simhash, "WIDEST", 11)
    rng = np.random.default_rng(8)
    wide = sorted({c ^ sum({1 << int(b) for b in rng.integers(0, 21, 4)}) for c in codes[:90] for _ in range(3)})
    rows = [(k, c - (1 << 64) if c >> 63 else c, c.to_bytes(8, "little")) for k, c in enumerate(wide)]
    df = spark.createDataFrame(rows, "node long, fp long, bits binary")
    got = {r.node: r.root for r in simhash.components(simhash.verified_links(df, len(rows), 3, 11, lambda edges: edges)).collect()}
    root = list(range(len(wide)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(wide):
        for j in range(i):
            if (a ^ wide[j]).bit_count() <= 11:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    nodes = list(range(len(wide)))
    assert grouped(nodes, got) == grouped(nodes, {k: find(k) for k in nodes})


def test_long_chain(spark):
    edges = spark.range(40).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    got = simhash.components(edges).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(1, 41)}


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = got.collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].fingerprint == "0" * 16 and by[2][0].component_id == 2 == by[5][0].component_id
    same = [r for r in rows if r.fingerprint == by[1][0].fingerprint]
    assert {r.doc_id for r in same} == {1, None, 6} and {r.component_id for r in same} == {1}
    assert simhash.near_duplicates(none).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: plain_fingerprint(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    roots = brute_components(set(docs.values()))
    least = {}
    for i, c in docs.items():
        least[roots[c]] = min(i, least.get(roots[c], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, sf).collect()}
    assert got == {i: (f"{c:016x}", least[roots[c]]) for i, c in docs.items()}


def test_similar_groups_against_jaccard(spark):
    """Groups hold together by pairs of a similarity of 0.8, and at least nine in ten such pairs are in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: simhash.shingles(r.text) for r in docs.collect()}
    got = {r.doc_id: r.root for r in simhash.similar_groups(docs).collect()}
    assert got.keys() == sets.keys()
    near = lambda a, b: a == b or bool(a and b) and 10 * len(a & b) >= 8 * len(a | b)
    ids = sorted(sets, key=lambda i: len(sets[i]))
    pairs = []
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(sets[j]) * 0.8 > len(sets[i]):
                break
            if near(sets[i], sets[j]):
                pairs.append((i, j))
    unequal = [(i, j) for i, j in pairs if sets[i] != sets[j]]
    assert all(got[i] == got[j] for i, j in pairs if sets[i] == sets[j])
    assert sum(got[i] == got[j] for i, j in unequal) >= 0.9 * len(unequal) > 0
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        root[find(i)] = find(j)
    named = {}
    assert all(named.setdefault(got[i], find(i)) == find(i) for i in ids)


def test_unlike_texts_of_one_sketch_stay_apart(spark):
    """A phrase repeated so often that it outweighs all else, in texts that have nothing else in common."""
    tail = lambda k: " ".join(f"w{k}x{i}" for i in range(500))
    df = spark.createDataFrame([(k, "read more here " * 400 + tail(k)) for k in range(3)] + [(7, "READ  more here " * 400 + tail(1))], "doc_id long, text string")
    assert len({simhash.sketch(r.text, 5, 4).tobytes() for r in df.collect()}) < 4
    got = {r.doc_id: r.root for r in simhash.similar_groups(df).collect()}
    assert len({got[0], got[1], got[2]}) == 3 and got[1] == got[7]


@pytest.mark.parametrize("most", [16384, 16])
def test_refuted_pairs_hide_no_link(spark, most, monkeypatch):
    """Every pair is a candidate, few are true, and the components are those of the true ones."""
    monkeypatch.setattr(simhash, "MAX_GROUP", most)
    rng = np.random.default_rng(3)
    n = 20
    true = {(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (12, 2)).tolist() if a != b}
    listed = spark.createDataFrame(sorted(true), "u long, v long")
    df = spark.createDataFrame([(k, 5, bytes(32)) for k in range(n)], "node long, fp long, bits binary")
    got = {r.node: r.root for r in simhash.components(simhash.verified_links(df, n, 1, 0, lambda edges: edges.join(listed, ["u", "v"], "left_semi"))).collect()}
    root = list(range(n))
    for _ in range(n):
        for a, b in true:
            root[a] = root[b] = min(root[a], root[b])
    assert grouped(range(n), got) == grouped(range(n), dict(enumerate(root)))


@pytest.mark.parametrize("n", [1, 5, 9, 200, 6000])
def test_parities_refuse_no_similar_sets(n):
    """Sets at the bound always pass, also with more elements than places; small ones far from it don't."""
    rng = np.random.default_rng(n)
    passed = {}
    for apart in {0, n // 9, n // 5, n // 2}:
        for trial in range(20):
            pool = rng.integers(0, 1 << 63, n + apart, np.uint64)
            a, b = pool[:n], pool[apart if trial % 2 else 0 :]
            shared, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            odd = [simhash.parities(x)[None] for x in (a, b)]
            fits = simhash.can_reach(*odd, np.array([len(a)]), np.array([len(b)]), 0.8)[0]
            assert fits or shared < 0.8 * union
            passed.setdefault(5 * shared >= 4 * union, []).append(fits)
    assert all(passed[True]) and (n != 200 or not any(passed[False]))


def test_many_variants_of_one_text(spark):
    """Chains of edits of one text, most pairs nearly but not quite similar: the groups are those of all similar pairs."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(12):
        words = list(base)
        for i in rng.choice(150, 5, replace=False):
            words[i] = f"c{k}x{i}"
        for step in range(5):
            words[int(rng.integers(150))] = f"s{k}x{step}"
            texts.append(" ".join(words))
    sets = [simhash.shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                root[find(i)] = find(j)
    got = {r.doc_id: r.root for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    ids = range(len(texts))
    assert 1 < len({find(i) for i in ids}) < len(texts)
    assert grouped(ids, got) == grouped(ids, {i: find(i) for i in ids})


def test_similar_odd_rows(odd, none):
    rows = simhash.similar_groups(odd, keep=("n",)).collect()
    assert len(rows) == odd.count()
    roots = {}
    for r in rows:
        roots.setdefault(r.root, []).append(r.doc_id)
    assert sorted(sorted(map(str, x)) for x in roots.values() if len(x) > 1) == [["1", "6", "None"], ["2", "2", "3", "5", "None"]]
    assert simhash.similar_groups(none).count() == 0
