import hashlib
import random
import re

import duckdb

from quillbase.llm import decontaminate


def brute(texts, items):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = [(i, tuple(w[k : k + 10])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - 9))]
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i, window in windows:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= set() if i is None else {str(i)}
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["a", "B", "é", "c1", "d-d", "E!"]) for _ in range(n))
    items = [(i, say(rng.randint(1, 13))) for i in range(12)] + [(12, "A b é"), (13, "a B é"), (None, "c1 a c1"), (14, None), (15, "!!"), (13, "a B é")]
    texts = [say(rng.randint(0, 60)) for _ in range(40)] + [None, "", " -- ", items[0][1].upper()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    for most in (decontaminate.MAX_SHARD_BYTES, 40):  # also in many shards
        monkeypatch.setattr(decontaminate, "MAX_SHARD_BYTES", most)
        got = sorted(decontaminate.with_hits(docs, bench).collect())
        assert [(r.n_words, r.n_hit, r["items"]) for r in got] == want
        for r in got:
            spans = "".join(texts[r.doc_id][s.start : s.end] + " " for s in r.spans)
            assert len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", spans)) == r.n_hit


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    rows = decontaminate.with_hits(odd, bench).collect()
    assert len(rows) == odd.count() and sum(r.n_hit for r in rows) == 6
    assert decontaminate.with_hits(none, bench).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate.with_hits(odd, empty).collect())


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = sorted(con.sql(decontaminate.OP4_SQL).fetchall())
    assert sorted(tuple(r) for r in decontaminate.op4_decontaminate(spark, sf).collect()) == want
    assert any(r[5] for r in want) and any(r[4] == hashlib.sha256(b"").hexdigest() for r in want)


def test_a_null_id_marks_words_in_sql_too(tmp_path, spark):
    """Rows as the query has them: an item without an id hits words, and isn't counted."""
    spark.createDataFrame([(1, "of all the words here"), (2, "None.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "The Words"), (7, "all the")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.sql(decontaminate.OP4_SQL).fetchall())
    assert sorted(tuple(r) for r in decontaminate.op4_decontaminate(spark, str(tmp_path)).collect()) == want
    assert [(r[2], r[3]) for r in want] == [(3, 1), (0, 0)]


def test_the_automaton_is_small():
    """Some 16 bytes a state and ten states a word; a very long text is scanned whole."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(30_000)}" for _ in range(60_000)]
    items = [(str(k), " ".join(words[k * 100 : k * 100 + 100])) for k in range(600)]
    automaton = decontaminate.Automaton(items)
    arrays = (automaton.edges, automaton.fail, automaton.out, automaton.length, automaton.seen)
    assert sum(a.nbytes for a in arrays) < 40 * len(automaton.fail) < 40 * 10 * len(words)
    long = " ".join(words[150:161]) + " x" * 300_000 + " " + " ".join(words[:12])
    ((n, ranges, found),) = automaton.scan([long])
    assert n == 11 + 300_000 + 12 and ranges == [(0, 11), (n - 12, n)] and found == {"0", "1"}
