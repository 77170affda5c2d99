from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from quillbase.llm import mixing


def targets(sizes, weights=mixing.WEIGHTS, share=1, most=mixing.MOST):
    """Rounds of the task's words: clamp, share the rest again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed = {}
    while True:
        rest, total = sum(sizes.values()) * share - sum(fixed.values()), sum(w for s, w in weight.items() if s not in fixed)
        now = {s: Fraction(rest * w, total) for s, w in weight.items() if s not in fixed}
        over = {s: most * sizes[s] for s, t in now.items() if t > most * sizes[s]}
        if not over:
            return fixed | now
        fixed |= over


def check(rows, df, **how):
    got = mixing.with_mix(df, **how).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = targets(sizes, **{k: v for k, v in how.items() if k != "seed" and k != "keep"}) if rows else {}
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) < 1e-6
        assert 0 <= r.taken <= how.get("most", 3) * r.size and r.taken == r.copies * r.size + r.part
    assert all(abs(taken[s] - want[s]) < 1 for s in want), (dict(taken), want)
    return got


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


KEEP = ("doc_id", "source")


def test_targets_are_met_to_a_word(spark):
    rows = [(i, "w " * (i * 7 % 31), f"s{i % 5}") for i in range(300)] + [(1000 + i, "a b", None) for i in range(4)] + [(2000, None, "empty"), (2001, "x " * 9000, "é")]
    a = check(rows, frame(spark, rows), keep=KEEP)
    b = check(rows, frame(spark, rows[::-1]).repartition(3), keep=KEEP)
    assert sorted(a, key=str) == sorted(b, key=str)
    assert a != check(rows, frame(spark, rows), keep=KEEP, seed="another")
    check(rows, frame(spark, rows), keep=KEEP, weights=(1, 9), most=2)
    check(rows, frame(spark, rows), keep=KEEP, weights=(1,), most=1)  # all clamped, or just not


def test_rows_that_are_the_same(spark):
    rows = [(None, "a", None)] * 997 + [(7, "b c d", "z")] * 50 + [(i, "e f", "q") for i in range(400)]
    check(rows, frame(spark, rows), keep=KEEP)


def test_joins_that_shuffle_agree(spark, sf, monkeypatch):
    one = mixing.op12_mixture(spark, sf).collect()
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert sorted(mixing.op12_mixture(spark, sf).collect()) == sorted(one)


def test_odd_rows(spark, odd, none):
    df = odd.withColumn("source", F.lit(None).cast("string")).withColumn("size", F.lit("x")).withColumn("_code", F.lit(1))
    got = mixing.with_mix(df, keep=("doc_id", "size", "_code"))
    assert got.columns == ["doc_id", "_code", "size", "source_size", "target", "taken", "copies", "part"]
    rows = got.collect()
    assert len(rows) == odd.count() and max(r.size for r in rows) == 30_002
    assert sum(r.taken for r in rows) == rows[0].source_size
    assert mixing.with_mix(none.withColumn("source", F.lit("a"))).count() == 0


def test_repetitions_are_rows(spark):
    rows = [(i, f"one two {i} four", f"s{i % 3}") for i in range(50)]
    mixed = mixing.with_mix(frame(spark, rows), keep=("doc_id", "text"))
    out = mixing.repeated(mixed).select("doc_id", "text").collect()
    want = {r.doc_id: r.taken for r in mixed.collect()}
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += len(r.text.split())
        assert rows[r.doc_id][1].startswith(r.text)
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_sql(spark, sf_dir):
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        rel = c.sql(mixing.OP12_SQL)
        got = mixing.op12_mixture(spark, sf_dir)
        assert got.columns == rel.columns
        assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
