import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quillbase.llm import lm_scores


def held(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0


class Brute:
    """The same model over words, in dictionaries."""

    def __init__(self, rows):
        self.grams = Counter()
        texts = [[b"\n", *(t or "").encode().lower().split(), b""] for i, t in rows if not held(i)]
        for seq in texts:
            for n in (1, 2, 3):
                self.grams.update(tuple(seq[k : k + n]) for k in range(len(seq) - n + 1))
        self.n = sum(len(s) - 1 for s in texts)
        self.v = len({w for s in texts for w in s[1:]})

    def base(self, w):
        return (self.grams[w,] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, history, w):
        if not history:
            return self.base(w)
        lower, whole = self.p(history[1:], w), self.grams[history]
        if whole < 2:
            return lower
        prior = lm_scores.PRIORS[len(history) - 1]
        return (self.grams[(*history, w)] + prior * lower) / (whole + prior)

    def row(self, i, t):
        words = [*(t or "").encode().lower().split(), b""]
        seq, score = [b"\n", *words], 0.0
        for k in range(1, len(seq)):
            score += math.log10(self.p(tuple(seq[max(0, k - 2) : k]), seq[k]))
        return i, held(i), len(words), sum(self.grams[w,] > 0 for w in words), self.n, sum(math.log10(self.base(w)) for w in words), score


def check(got, rows):
    model = Brute(rows)
    key = lambda r: (str(r[0]), r[2], round(r[5], 5))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted((model.row(i, t) for i, t in rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for k in (5, 6):
        assert [r[k] for r in got] == pytest.approx([r[k] for r in want], rel=1e-9)
    return model


def test_probabilities_of_each_history_add_up():
    model = Brute([(k, t) for k, t in enumerate(["a b c a b", "a b c", "b b a", "a b c c", "a b a b"] * 2)])
    unknown = b"never seen"
    for history in [(), *(g for g in model.grams if len(g) < 3 and g[-1] != b"")]:
        words = {g[0] for g in model.grams if len(g) == 1} - {b"\n"}
        assert sum(model.p(history, w) for w in words) + model.p(history, unknown) == pytest.approx(1)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, name):
    folder = f"/root/testdata/{name}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = lm_scores.op3_lm_scores(spark, folder).collect()
    check(got, rows)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_many_blocks_pieces_and_buckets(spark, sf, monkeypatch):
    """Small blocks, pieces and buckets change nothing."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for name, value in (("BLOCK_TOKENS", 700), ("PIECE_TOKENS", 50), ("BUCKET_BYTES", 4000)):
        monkeypatch.setattr(lm_scores, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(lm_scores.with_lm_scores(df).collect(), rows)


def test_copies_stand_apart(spark):
    """Texts that training rows hold twice score higher a token than those they hold once."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    times = Counter(t for i, t in docs if not held(i))
    got = {r.doc_id: r.score / r.n_tokens for r in lm_scores.op3_lm_scores(spark, "/root/testdata/sf0.01").collect() if r.n_tokens > 50}
    once, twice = ([got[i] for i, t in docs if i in got and not held(i) and times[t] == n] for n in (1, 2))
    assert np.mean(np.array(twice) > np.quantile(once, 0.9)) > 0.9


def test_odd_rows(odd, none):
    check(lm_scores.with_lm_scores(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert lm_scores.with_lm_scores(none).count() == 0


def test_packing():
    for x in (np.array([], np.uint64), np.array([3, 9, 2**63], np.uint64), np.arange(1000, dtype=np.float64) / 7, np.array([-1, 5], np.int32)):
        assert (lm_scores.unpack(lm_scores.pack(x), len(x), x.dtype) == x).all()
