import hashlib
import random
from collections import Counter

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from quillbase.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HARD = ["", None, "x", " ", "  two  spaces ", "a▁b", "\x00\x01", "naïve — 漢字 😀 é", "<|endoftext|> <s></s> <unk> <0x41>", "'s 'tis don't\r\n\n\t x", " " * 700, "ab" * 3000, "ﷺ ﬁ ½", "�", "the quick brown fox"]


def brute(texts):
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    of = alignment.byte_alphabet()
    rows, links = [], []
    for t in texts:
        full = (" " + (t or "")).encode()
        a, b = tok.encode(full.decode(), add_special_tokens=False).ids, sp.encode(t or "")
        ab = [bytes(of[c] for c in tok.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if not t or b"".join(ab) != full or b"".join(bb) != full:
            a = b = ab = bb = []
        at, ends = 0, {}
        for k, x in enumerate(ab):
            ends[at := at + len(x)] = k
        at, i, j, groups, own = 0, 0, 0, [], []
        for k, x in enumerate(bb):
            if (at := at + len(x)) in ends:
                groups.append(",".join(map(str, a[i : ends[at] + 1])) + "|" + ",".join(map(str, b[j : k + 1])))
                own.append((a[ends[at]], b[k]))
                i, j = ends[at] + 1, k + 1
        rows.append((len(a), len(b), len(groups), len(own), ";".join(groups)))
        links.append(own)
    count = Counter(x for own in links for x in own)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(*r[:4], sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), hashlib.sha256(r[4].encode()).hexdigest() if r[0] else "") for r, own in zip(rows, links, strict=True)]


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    some = ["the", "Straße", " ", "  ", "\n", "can't", "123456", "été", "漢", "\t", "a.b", "...", "▁", "", "word,", "😀😀", "\x0b"]
    texts = HARD + ["".join(rng.choice(some) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    monkeypatch.setattr(alignment, "STRETCH", 64)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    for most in (alignment.MAX_BROADCAST_PAIRS, 0):  # counts by a broadcast, and by a join that shuffles
        got = {r.doc_id: r for r in alignment.with_link_counts(df, A, B, max_broadcast=most).collect()}
        assert [tuple(got[k][f] for f in FIGURES) for k in range(len(texts))] == want


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in alignment.op11_token_alignment(spark, sf).collect()}
    assert [tuple(got[d.doc_id][f] for f in FIGURES) for d in docs] == brute([d.text for d in docs])
    assert alignment.op11_token_alignment(spark, sf).columns == ["doc_id", *FIGURES]


def test_stretches_of_any_length_give_the_same_cuts():
    al = alignment.Aligner(A, B)
    text = ["one two  three\nquatre—cinq " * 40, "", "six"]
    before = alignment.STRETCH
    try:
        found = []
        for alignment.STRETCH in (1, 3, 50, 10_000):
            m = al.merge(text)
            found.append((m.cut_a.tolist(), m.cut_b.tolist()))
    finally:
        alignment.STRETCH = before
    assert all(x == found[0] for x in found)


def test_groups_are_real_outputs(spark):
    row = alignment.with_alignment(spark.createDataFrame([(1, "tokenizers don't agree"), (2, None)], "doc_id long, text string"), A, B).orderBy("doc_id").collect()
    groups = row[0].groups
    assert groups[-1].a == len(row[0].a_ids) and groups[-1].b == len(row[0].b_ids) and groups[-1].bytes == 23
    assert all(x.bytes < y.bytes for x, y in zip(groups, groups[1:])) and row[1].groups == []  # noqa: B905


def test_odd_rows(spark, odd, none):
    got = alignment.with_link_counts(odd, A, B)
    assert got.columns == ["doc_id", *FIGURES] and got.count() == odd.count()
    rows = got.collect()
    assert sum(r.n_a == 0 and r.groups_sha256 == "" and r.n_best == 0 == r.count_sum for r in rows) == 4
    assert max(r.n_a for r in rows) > 30_000
    assert alignment.with_link_counts(none, A, B).count() == 0
