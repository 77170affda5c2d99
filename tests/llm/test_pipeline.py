import re

import corpus_pipeline as P
import public_tokenizers
import pytest
import tiktoken

from quillbase.llm import toxicity
from quillbase.llm.common import table
from quillbase.llm.token_counts import load_ranks


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = table(spark, sf, "documents"), []
    folder = tmp_path_factory.mktemp("stages")
    for k, (name, f) in enumerate(P.STAGES):
        f(spark, docs, sf).write.parquet(f"{folder}/{k}")
        before, docs = docs, spark.read.parquet(f"{folder}/{k}")
        out.append((name, before, docs))
    return {name: (a, b) for name, a, b in out}


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages, spark, sf):
    documents = table(spark, sf, "documents").columns
    assert all(b.columns == documents for name, (_, b) in stages.items() if name != "byte_bpe")


def test_toxicity(stages, spark, sf):
    a, b = map(texts, stages["toxicity"])
    model = toxicity.train(stages["toxicity"][0], table(spark, sf, "labels"))
    bad = {r.doc_id for r in toxicity.with_toxicity(stages["toxicity"][0], model).collect() if r.predicted}
    assert b == {i: t for i, t in a.items() if i not in bad}


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_duplicates(stages):
    """Against the exact similarity of all pairs."""
    a, b = map(texts, stages["simhash"])
    sets = {i: shingles(t) for i, t in a.items()}
    near = lambda i, j: sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    kept = sorted(b)
    assert all(b[i] == a[i] for i in b)
    pairs = [(i, j) for i in a for j in a if i < j and near(i, j)]
    assert sum(i in b and j in b for i, j in pairs) <= 0.1 * len(pairs) and len(pairs) > 5
    assert not any(sets[i] == sets[j] for k, i in enumerate(kept) for j in kept[:k])
    for i in set(a) - set(b):  # what goes is similar to something
        assert any(j != i and near(i, j) for j in a)


def test_benchmark(stages, spark, sf):
    """What goes has ten consecutive words (or all, of shorter items) of an item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for r in table(spark, sf, "benchmark").collect() if (w := words(r.text)) for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    held = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    a, b = map(texts, stages["decontaminate"])
    assert b == {i: t for i, t in a.items() if not held(words(t))}


def test_personal_data(stages):
    a, b = map(texts, stages["pii"])
    assert a.keys() == b.keys()
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for i, t in a.items():
        if mail.search(t or ""):
            assert not mail.search(b[i]) and "<EMAIL>" in b[i]
        for word in re.findall(r"<[A-Z]+>|[a-z]{3,}", b[i]):
            assert word in t or word in ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")
    assert all(r.n_chars == len(r.text) for r in stages["pii"][1].collect())


def test_ids(stages):
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    a = texts(stages["byte_bpe"][0])
    got = {r.doc_id: r.token_ids for r in stages["byte_bpe"][1].collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in a.items()}


def test_run(spark, sf, stages):
    assert sorted(r.doc_id for r in P.run(spark, sf).collect()) == sorted(texts(stages["byte_bpe"][0]))


def test_odd_rows(spark, sf, odd):
    """Extra columns come through; of copies the smallest id stays, rows without one go."""
    docs = odd
    for name, f in P.STAGES[1:4]:
        docs = f(spark, docs, sf)
        assert docs.columns == odd.columns, name
    rows = docs.collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 7]  # rows without an id are copies of others
    assert P.STAGES[4][1](spark, docs, sf).count() == len(rows)


def test_one_row_of_each_group_whatever_its_id(spark, sf):
    """One id on many different texts loses none of them; copies, also without an id, stay once."""
    texts = [f"text {k} of " + " ".join(f"w{k}x{i}" for i in range(30)) for k in range(8)]
    rows = [(0, t, {"k": "v"}) for t in texts] + [(5, texts[0], None), (0, texts[1], {"k": "v"}), (0, texts[1], {"k": "u"})]
    rows += [(None, "a copy without any id", None)] * 3 + [(None, "another text that has no id", None), (None, texts[2], None)]
    got = P.duplicates_out(spark, spark.createDataFrame(rows, "doc_id long, text string, more map<string,string>"), sf)
    assert got.columns == ["doc_id", "text", "more"]
    want = [(0, t) for t in texts] + [(None, "a copy without any id"), (None, "another text that has no id")]
    assert sorted((r.text, r.doc_id) for r in got.collect()) == sorted((t, i) for i, t in want)


def test_empty_tables(spark, sf, none):
    docs = none
    for name, f in P.STAGES:
        docs = f(spark, docs, sf)
        assert docs.count() == 0, name
        if name != "byte_bpe":
            assert docs.columns == none.columns, name
