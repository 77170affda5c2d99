import pytest

from quillbase.llm import toxicity
from quillbase.llm.common import table

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(table(spark, BIG, "documents"), table(spark, BIG, "labels"))


def test_channel(model):
    channel = toxicity.Channel(model["grams"])
    for shown, meant in [("1d10t", "idiot"), ("i d i o t", "idiot"), ("l-o-s-e-r", "loser"), ("m0r0n", "moron"), ("sc.um", "scum"), ("idiooot", "idiot"), ("tr@sh", "trash"), ("p4th3t1c", "pathetic"), ("d1sgust1ng", "disgusting")]:
        assert channel.restore(shown) == meant


def test_held_out_accuracy(spark, model):
    rows = toxicity.op10_toxicity(spark, BIG).join(table(spark, BIG, "labels"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted == r.toxic for r in rows)
    assert hit >= 0.95 * len(rows)
    wrong = [r for r in rows if r.predicted and not r.toxic]
    assert len(wrong) <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_disguised_like_plain(spark, model):
    texts = ["you are an idiot", "you are an 1d10t", "you are an i d i o t", "you are a nice one", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.predicted for r in sorted(toxicity.with_toxicity(df, model).collect())]
    assert got == [1, 1, 1, 0, 0, 0]


def test_odd_rows(spark, odd, none, model):
    got = toxicity.with_toxicity(odd, model)
    assert got.columns == ["doc_id", "score", "predicted"] and len(got.collect()) == odd.count()
    assert toxicity.with_toxicity(none, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    untaught = toxicity.train(odd, labels)
    assert all(r.score == 0 for r in toxicity.with_toxicity(odd, untaught).collect())
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (4, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    toxicity.train(odd, nulls)


def test_labels_are_no_input(spark, model):
    """The same text has the same score, whatever its other columns say."""
    df = spark.createDataFrame([(1, "the idiot", "en", "a"), (2, "the idiot", "fr", "b")], "doc_id long, text string, lang string, source string")
    assert len({r.score for r in toxicity.with_toxicity(df, model).collect()}) == 1


def test_scores_against_brute_force(spark):
    """Given a model, a score is the logistic of the sum of the log odds of the features of the restored tokens."""
    import itertools
    import math

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    model = toxicity.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    channel = toxicity.Channel(model["grams"])

    def slow(token):
        """All readings of a lattice, one by one."""
        steps = [*channel.lattice(token), [(" ", 0.0)]]
        if math.prod(map(len, steps)) > 20_000:
            return None
        best = None
        for path in itertools.product(*steps):
            context, cost = " ", 0.0
            for letters, extra in path:
                cost += extra
                for c in letters:
                    cost += channel.cost(context, c)
                    context = (context + c)[1 - toxicity.ORDER :]
            if best is None or cost < best[0] - 1e-12:
                best = cost, "".join(p[0] for p in path).strip()
        return best

    def cost_of(word):
        context, cost = " ", 0.0
        for c in word + " ":
            cost += channel.cost(context, c)
            context = (context + c)[1 - toxicity.ORDER :]
        return cost

    for token in ("1d1ot", "st0p", "i-d-i-o-t", "heeello", "p@thet1c", "a.b", "!!x1"):
        got = channel.restore(token)
        found = slow(token)
        assert found is None or got == found[1] or abs(cost_of(got) - cost_of(found[1])) < 2.0
    texts = docs + [(-1, "you 1d1ot and i d i o t"), (-2, ""), (-3, None)]
    got = {r.doc_id: r.score for r in toxicity.with_toxicity(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, t in texts:
        words = set()
        for token in (t or "").split():
            word = toxicity.plain(token)
            words.add(word)
            if word and (toxicity._ODD.search(token) or toxicity._ODD.search(word)) and any(c.isalpha() for c in word):
                words |= set(channel.restore(token.lower()).split())
        for run in toxicity._SPACED.findall(t or ""):
            words |= set(channel.restore(run.lower()).split())
        held = {f for w in words for f in [w, *(w[:n] + "-" for n in toxicity.PREFIXES if len(w) >= n)] if f in model["odds"]}
        x = model["none"] + math.fsum(model["odds"][f] for f in held)
        assert abs(got[i] - 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))) < 1e-9


def test_learns_from_all_labelled_rows(spark, monkeypatch):
    """The counts behind the odds are of all labelled rows outside the fold, however many; the old bound has no effect."""
    import math
    import zlib

    monkeypatch.setattr(toxicity, "MAX_LABELLED", 60, raising=False)
    monkeypatch.setattr(toxicity, "MAX_HELD", 5, raising=False)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    text = lambda i: "some plain words here" + (" zuckbad" if i % 3 == 0 else "") + (" otherbad" if i % 3 == 0 and i % 2 or i % 5 == 1 and i % 3 == 1 else "")
    bad = lambda i: int("bad" in text(i))
    docs = spark.createDataFrame([(i, text(i)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, bad(i)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    toxic, held = sum(map(bad, ids)), sum("zuckbad" in text(i) for i in ids)
    assert model["odds"]["zuckbad"] == pytest.approx(math.log((held + 0.5) / (toxic + 1)) - math.log(0.5 / (len(ids) - toxic + 1)))
    assert model["grams"]["uckb"] == held


def test_texts_meet_labels_without_a_shuffle(spark, monkeypatch):
    """The labels of dense numbers are broadcast as bits; what that gives is what a join gives, for odd numbers too."""
    ids = [*range(-70, 70), 32767, 32768, 32769, -32768, -32769, 65536, 2**62, -(2**62)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(5, "again 5"), (None, "none")], "id long, text string")
    usable = spark.createDataFrame([(i, int(i % 3 == 0)) for i in ids if i % 2] + [(5, 1), (32768, 0), (999, 1)], "id long, toxic int")
    got = toxicity._labelled(docs, usable)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    monkeypatch.setattr(toxicity, "MAX_BITMAPS", 0)
    joined = toxicity._labelled(docs, usable)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joined.collect())) and got.count() > 70


def test_simple_tokens_are_plain_ones():
    """Tokens that pass for simple are those that the expressions leave alone."""
    import random

    rng, seen = random.Random(3), 0
    for _ in range(40_000):
        token = "".join(rng.choice("aabBc1!.,_-($@|+'\u20ac\xe9") for _ in range(rng.randint(1, 6)))
        word = toxicity.simple(token)
        if word is not None:
            seen += 1
            assert word == toxicity.plain(token) and not toxicity._ODD.search(token) and not toxicity._ODD.search(word)
    assert seen > 1000
