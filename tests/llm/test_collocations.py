import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbase.llm import collocations as C

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
        if words := re.findall("[^\x20\x09]+", piece):
            yield words


def brute(rows, least=100, top=2000, most=5):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    cand = {p for p, a in f.items() if a >= least and len(p) > 2}
    covered = set()
    for lang, *w in cand:
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                sub = (lang, *w[i : i + k])
                if 100 * f[(lang, *w)] >= 100 * f[sub]:
                    covered.add(sub)
    out = []
    for lang in n:
        found = []
        for p in cand - covered:
            if p[0] == lang:
                w, a = p[1:], f[p]
                score, _, left, right = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
                found.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def some_rows(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "é", "x", "in", "a", "\x01", "漢字", "state's"]
    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", " \t ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
    return [(rng.choice(["en", "en", "fr", None]), text()) for _ in range(n)] + [("en", None), (None, ""), ("fr", " . ")]


def test_against_brute_force(spark, monkeypatch):
    rows = some_rows(3, 400)
    assert sorted(map(tuple, C.collocations(frame(spark, rows)).collect())) == brute(rows)
    # small windows, many triggers, short chunks, bitmaps with many false marks: the same
    for name, value in (("WINDOW", 40), ("TRIGGER", 2), ("LONGEST", 3), ("MAX_BITS", 8), ("MOST_CODES", 50), ("MOST_PHRASES", 20), ("MAX_BROADCAST", 0)):
        monkeypatch.setattr(C, name, value)
    assert sorted(map(tuple, C.collocations(frame(spark, rows), least=20, top=15).collect())) == brute(rows, 20, 15)


def test_overlaps_count_once():
    text = b"a b c d e f g h i j k l m n o p q r s t u v w x y z " * 50 + b"\n"
    for C.TRIGGER in (1, 3, 16):
        found = Counter()
        for (own, chunk), times in C.parse(np.frombuffer(text, np.uint8)).items():
            w = chunk.split()
            assert own <= len(w) <= own + 4
            for i in range(own):
                for k in range(1, 6):
                    if i + k <= len(w):
                        found[tuple(w[i : i + k])] += times
        words = text.split()
        assert found == Counter(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))


def test_what_texts_share_is_one_chunk(spark):
    rows = [("en", "One two three four five six seven eight nine ten eleven twelve." * 3)] * 500
    found = C.dictionary(frame(spark, rows))
    assert found.agg(F.sum("times")).first()[0] % 1500 == 0 and found.count() < 14


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 3 * 10**15, 9 * 10**16, 4 * 10**15, 5 * 10**15
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    counts = spark.createDataFrame([("x", "p q", a), ("x", "p", left), ("x", "q", right)], "lang string, phrase string, f long")
    before, C.frequent_phrases = C.frequent_phrases, lambda *_: (counts, spark.createDataFrame([("x", n)], "lang string, n long"))
    try:
        row = C.collocations(df).first()
    finally:
        C.frequent_phrases = before
    assert row.score == 1000 * a * n // (left * right) and row.rank == 1


def test_odd_rows(spark, odd, none):
    df = odd.withColumn("lang", F.when(F.col("doc_id") == 4, "en")).withColumn("chunk", F.lit(1)).withColumn("times", F.lit("t"))
    rows = [(r.lang, r.text) for r in df.collect()]
    assert sorted(map(tuple, C.collocations(df).collect())) == brute(rows) != []
    assert C.collocations(none.withColumn("lang", F.lit("en"))).count() == 0


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_sql(spark, sf_dir):
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        rel = c.sql(C.OP13_SQL)
        got = C.op13_collocations(spark, sf_dir)
        assert got.columns == rel.columns
        assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
