import random

import pytest
from pyspark.sql import functions as F

from quillbase.operators import index as I
from quillbase.operators import search
from quillbase.operators.versions import Conflict, Versions

WORDS = [f"w{i}" for i in range(60)] + ["café", "x1"]


def made(spark, rows):
    return spark.createDataFrame(rows, "path string, body string")


def texts(seed, n):
    rng = random.Random(seed)
    return {f"p{i:03}": " ".join(rng.choice(WORDS[: rng.choice([5, 20, 62])]) for _ in range(rng.randint(0, 40))) for i in range(n)}


def same(index, df, query="w1 w7 café"):
    assert sorted(map(tuple, index.term_statistics().collect())) == sorted(map(tuple, search.term_statistics(df).collect()))
    assert [tuple(r) for r in index.search(query).collect()] == [tuple(r) for r in search.bm25(df, query).collect()]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(I, "STRIPE", 8)
    monkeypatch.setattr(I, "FIRST", 2)


def test_refreshed_like_rebuilt(spark, tmp_path, small):
    pages = texts(1, 120)
    index = I.SearchIndex(spark, str(tmp_path / "i"))
    df = made(spark, list(pages.items()) + [("null", "")])
    assert index.refresh(df) == {"added": 121, "changed": 0, "removed": 0}
    same(index, df)
    assert index.refresh(df) == {"added": 0, "changed": 0, "removed": 0} and index.store.latest() == 0
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "i" / "data").rglob("*.parquet")}
    pages |= {"p003": "w1 w1 w1 brand new", "p900": "w7 café"}
    del pages["p010"], pages["p011"]
    df = made(spark, list(pages.items()))
    assert index.refresh(df) == {"added": 1, "changed": 1, "removed": 3}
    same(index, df)
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())  # nothing of the old segment was written anew
    for k in range(3):
        pages[f"p{k:03}"] = f"w{k} w1"
        df = made(spark, list(pages.items()))
        index.refresh(df)
    assert len(index.state()[1]["segments"]) == 5
    assert index.merge(most=2) == 4
    assert len(index.state()[1]["segments"]) == 2
    same(index, df)
    assert index.merge(most=2) == 0
    assert index.refresh(df)["changed"] == 0


def test_blocks_that_cannot_reach_the_top_stay_unread(spark, tmp_path, small):
    rows = [(f"p{i:04}", "common " * (1 + i % 3) + "filler " * 30) for i in range(500)] + [(f"q{i}", "common " * 40) for i in range(12)]
    df = made(spark, rows)
    index = I.SearchIndex(spark, str(tmp_path / "i"))
    index.refresh(df)
    assert [tuple(r) for r in index.search("common", 5).collect()] == [tuple(r) for r in search.bm25(df, "common", 5).collect()]
    assert 0 < index.blocks["read"] < 0.3 * index.blocks["total"]
    assert index.search("absent").count() == 0 and index.search("").count() == 0


def test_many_queries_in_one_plan(spark, tmp_path, small):
    pages = texts(2, 90)
    df = made(spark, list(pages.items()))
    index = I.SearchIndex(spark, str(tmp_path / "i"))
    index.refresh(made(spark, [(k, v + " old") for k, v in pages.items()]))
    index.refresh(df)
    rng = random.Random(4)
    queries = [(i, " ".join(rng.sample(WORDS, rng.randint(1, 4)))) for i in range(12)] + [(100, ""), (101, None), (102, "nowhere")]
    many = index.search_many(spark.createDataFrame(queries, "query_id long, query string"), 5)
    assert "WindowGroupLimit" in many._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in many.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.path, r.score))
    for i, q in queries[:6]:
        assert got.get(i, []) == [tuple(r) for r in search.bm25(df, q, 5).collect()]
    assert not {100, 101, 102} & got.keys()


@pytest.mark.parametrize("pairs", [500_000, 40])
def test_many_queries_meet_pages_by_blocks(spark, tmp_path, monkeypatch, pairs):
    """Only the first pages of a task's queries are shuffled, not a row for each page and word; ties among copies go by key."""
    from quillbase.operators import many

    monkeypatch.setattr(I, "MAX_PAIRS", pairs, raising=False)
    monkeypatch.setattr(I, "PART", 50, raising=False)
    monkeypatch.setattr(many, "PAGES", 16)
    monkeypatch.setattr(many, "QUERIES", 3)
    monkeypatch.setattr(many, "WORDS", 2)
    df = made(spark, [*texts(8, 120).items(), *[(f"copy{i:02}", "alpha beta same words") for i in range(40)]])
    index = I.SearchIndex(spark, str(tmp_path / "i"), postings=False)
    index.refresh(df)
    with pytest.raises(ValueError, match="postings"):
        index.search("alpha")
    rng = random.Random(9)
    queries = [(i, " ".join(rng.sample(WORDS, rng.randint(1, 5)))) for i in range(9)] + [(9, "same words same")]
    found = index.search_many(spark.createDataFrame(queries, "query_id long, query string"), 4)
    if pairs > 40:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.path, r.score))
    for i, q in queries:
        assert got.get(i, []) == [tuple(r) for r in search.bm25(df, q, 4).collect()]
    assert [k for k, _ in got[9]] == ["copy00", "copy01", "copy02", "copy03"]


def test_empty_index(spark, tmp_path):
    index = I.SearchIndex(spark, str(tmp_path / "i"))
    assert index.search("a").count() == 0 and index.term_statistics().count() == 0
    assert index.refresh(made(spark, [])) == {"added": 0, "changed": 0, "removed": 0}
    index.refresh(made(spark, [("a", "b")]))
    assert index.refresh(made(spark, [])) == {"added": 0, "changed": 0, "removed": 1}
    assert index.search("b").count() == 0 and index.term_statistics().count() == 0


def test_a_dead_writers_lock_is_passed_over(spark, tmp_path, monkeypatch):
    from quillbase.operators import versions

    store = Versions(spark, str(tmp_path / "v"))
    (tmp_path / "v/manifest").mkdir(parents=True)
    (tmp_path / "v/manifest/000000000000.lock").write_text("")
    with pytest.raises(Conflict):
        store.commit({}, None)
    monkeypatch.setattr(versions, "STALE_LOCK_S", -5.0)
    assert store.commit({"a": 1}, None) == 0 and store.manifest() == {"a": 1}
    with pytest.raises(Conflict):
        store.commit({}, None)  # published: its lock stays


def test_versions(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    assert store.latest() is None and store.manifest() == {}
    df = spark.range(5)
    assert store.publish({"a": df}) == 0
    reader = store.table("a")
    assert store.publish({"a": spark.range(9)}, note="x") == 1
    assert reader.count() == 5 and store.table("a").count() == 9 and store.table("a", 0).count() == 5
    assert store.manifest()["note"] == "x"
    with pytest.raises(Conflict):
        store.publish({"a": df}, after=0)
    store.write(df, store.new_folder("a"))  # of a writer that never published
    assert len(list((tmp_path / "v" / "data").iterdir())) == 4
    assert store.collect(keep=1, grace_s=3600) == ["manifest/000000000000.json"]
    assert len(store.collect(keep=1, grace_s=0)) == 3 and store.table("a").agg(F.sum("id")).first()[0] == 36
    assert store.all() == [1]


def test_segments_keep_counted_words(spark, tmp_path):
    """Blocks, tombstones and merges come from pages with counted words, so no single words are shuffled."""
    from quillbase.operators.index import SearchIndex

    index = SearchIndex(spark, str(tmp_path / "kept"))
    rows = [("a", "x y x"), ("b", "y z"), ("c", ""), ("d", None), (None, "x")]
    index.refresh(spark.createDataFrame(rows, "path string, body string"))
    kept = index.store.read(index.state()[1]["segments"][0]["pages"]).collect()
    assert {r.key: [tuple(t) for t in r.terms] for r in kept} == {"a": [("x", 2), ("y", 1)], "b": [("y", 1), ("z", 1)], "c": [], "d": []}
    assert index.refresh(spark.createDataFrame([("a", "y"), ("b", "y z"), ("e", "z z")], "path string, body string")) == {"added": 1, "changed": 1, "removed": 2}
    want = {"y": (2, 2), "z": (2, 3)}
    assert {r.term: (r.docs, r.n) for r in index.term_statistics().collect()} == want
    assert index.merge(most=1) == 2 and {r.term: (r.docs, r.n) for r in index.term_statistics().collect()} == want
    assert [r.path for r in index.search("z").collect()] == ["e", "b"]


def test_terms_are_dealt_without_a_pass_for_bounds(spark):
    """The index is computed once, to be dealt out by term."""
    from quillbase.operators import store

    taken = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            taken.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"t{i}", i) for i in range(50)], "term string, n long").mapInArrow(seen, "term string, n long")
    assert store.stored_by(rows, "term", "index").count() == 50 and taken.value == 50
