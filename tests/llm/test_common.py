import os
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillbase.llm import common


def test_samples(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"))
    some = {r.doc_id for r in common.sampled(df, "doc_id", 200).collect()}
    assert len(some) == 200
    assert some == {r.doc_id for r in common.sampled(df.repartition(7), "doc_id", 200).collect()}
    assert some == {r.doc_id for r in df.orderBy(F.xxhash64("doc_id")).limit(200).collect()}
    assert common.sampled(df, "doc_id", 10_000).count() == 5000
    assert common.sampled(df.limit(0), "doc_id", 10).count() == 0


def test_folds(spark):
    rows = [(i,) for i in (*range(50), None)]
    got = {r.doc_id: r.f for r in spark.createDataFrame(rows, "doc_id long").select("doc_id", common.fold("doc_id", 5).alias("f")).collect()}
    assert got == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 for (i,) in rows}


def test_clashing_names_and_small_calls(spark):
    df = spark.createDataFrame([(i, "x" * i, "kept", "gone") for i in range(20)], "doc_id long, text string, other string, n string")
    got = common.per_document(df, lambda: lambda texts: [[len(texts)] * len(texts), [np.array([len(t)]) for t in texts]], "n long, sizes array<long>", keep=("doc_id", "other", "n"), per_call=3)
    assert got.columns == ["doc_id", "other", "n", "sizes"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == list(range(20)) and all(r.n <= 3 and r.sizes == [r.doc_id] and r.other == "kept" for r in rows)


def test_stored_tables_go(spark):
    t = common.stored(spark.range(10).toDF("x"), "test")
    folder = os.path.dirname(t.inputFiles()[0].removeprefix("file://"))
    assert t.count() == 10 and common.shared_dir(spark).removeprefix("file:") in folder
    common.drop_stored(t)
    assert not os.path.exists(folder)
