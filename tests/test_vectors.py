import numpy as np

from quillbase.operators import search
from quillbase.operators.vectors import VectorIndex


def frame(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, 12))
    rows = centres[rng.integers(0, 25, n)] + 0.4 * rng.normal(size=(n, 12))
    rows[: n // 3] = centres[0] + 0.05 * rng.normal(size=(n // 3, 12))  # one hot group
    listed = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(n, None), (n + 1, [0.0] * 12), (5, [float(x) for x in rows[5]])]
    return spark.createDataFrame(listed, "vec_id long, embedding array<double>"), rows


def test_lists(spark, tmp_path):
    df, rows = frame(spark, 1500)
    index = VectorIndex(spark, str(tmp_path / "v"))
    assert index.build(df) == 0
    assert index._open()[0].count() == 1501  # every row with a vector, repeated ones too
    query = rows[700].tolist()
    whole = [tuple(r) for r in search.nearest(df.where("vec_id < 1500"), query, 10).collect()]
    assert [tuple(r) for r in index.search(query, 10).collect()] == whole
    few = index.search(query, 10, probes=3)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan or "list IN" in plan or "INSET" in plan
    asked = spark.createDataFrame([(i, rows[i].tolist()) for i in range(0, 1500, 30)] + [(-1, None), (-2, [0.0] * 12)], "query_id long, query array<double>")
    near = {}
    for r in index.search_many(asked, 10, probes=6).collect():
        near.setdefault(r.query_id, set()).add(r.vec_id)
    assert not {-1, -2} & near.keys()
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    found = total = 0
    for i in range(0, 1500, 30):
        best = set(np.argsort(-(unit @ unit[i]), kind="stable")[:10].tolist())
        found += len(best & near[i])
        total += 10
    assert found >= 0.9 * total


def test_all_lists_are_the_full_scan(spark, tmp_path):
    df, rows = frame(spark, 300, 2)
    df = df.dropDuplicates(["vec_id"])
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(df, 7)
    asked = spark.createDataFrame([(i, rows[i].tolist()) for i in range(0, 300, 60)], "query_id long, query array<double>")
    got = {}
    for r in index.search_many(asked, 5, probes=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {i: [tuple(r) for r in search.nearest(df.where("vec_id < 300"), rows[i].tolist(), 5).collect()] for i in range(0, 300, 60)}


def test_empty(spark, tmp_path):
    df, _ = frame(spark, 30)
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(df.limit(0))
    assert index.search([1.0], 3).count() == 0
    assert index.search_many(spark.createDataFrame([(1, [1.0])], "query_id long, query array<double>"), 3).count() == 0


def test_blocks_against_brute_force(spark, tmp_path, monkeypatch):
    """Queries meet rows in blocks by matrix products, not as rows of pairs; copies, equal scores and small blocks change nothing."""
    import numpy as np

    from quillbase.operators import vectors

    for name, n in (("BLOCK_ROWS", 16), ("BLOCK_QUERIES", 7), ("AT_ONCE", 3)):
        monkeypatch.setattr(vectors, name, n, raising=False)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)] if i % 3 else [1.0, 2.0, 0.0, 1.0]) for i in range(150)] + [(900, None), (901, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = vectors.VectorIndex(spark, str(tmp_path / "v"))
    index.build(df, 5)
    asked = df.where("vec_id % 10 = 0").selectExpr("vec_id as query_id", "embedding as query")
    good = [(i, np.array(v)) for i, v in rows if v is not None and any(v)]
    want = []
    for q, v in good:
        if q % 10 == 0:
            scored = sorted((-round(float(v @ w) / (float(v @ v) ** 0.5 * float(w @ w) ** 0.5), 6), i) for i, w in good)
            want += [(q, at + 1, i, -s) for at, (s, i) in enumerate(scored[:4])]
    got = index.search_many(asked, 4, probes=5)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    some = index.search_many(asked, 4, probes=2).collect()
    scores = {(q, i): s for q, v in good if q % 10 == 0 for i, w in good for s in [round(float(v @ w) / (float(v @ v) ** 0.5 * float(w @ w) ** 0.5), 6)]}
    assert some and all(r.score == scores[r.query_id, r.vec_id] for r in some)
