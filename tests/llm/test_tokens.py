import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quillbase.llm import byte_bpe, token_counts

RANKS = token_counts.load_ranks(P.path("byte_bpe_50k.tiktoken"))
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def brute(word, scores):
    best = {0: (0, 0)}  # score, minus tokens
    for end in range(1, len(word) + 1):
        best[end] = max((best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores)
    return -best[len(word)][1], best[len(word)][0]


def test_trie_counts_like_brute_force():
    scores = token_counts.unigram_scores(RANKS)
    trie, rng = token_counts.PieceTrie(scores), random.Random(1)
    words = {b" " + "".join(rng.choice("theaning é") for _ in range(rng.randint(1, 14))).encode() for _ in range(300)}
    assert {w: trie.insert(w) for w in words} == {w: brute(w, scores) for w in words}
    assert {w: trie.insert(w) for w in words} == {w: brute(w, scores) for w in words}  # from the finished trie


def test_counts_of_odd_rows(spark, odd, none):
    got = token_counts.with_token_counts(odd, P.path("byte_bpe_50k.tiktoken"))
    assert got.columns == ["doc_id", "n_bytes", "n_pretokens", "n_tokens", "score"]
    rows = got.collect()
    assert len(rows) == odd.count()
    scores = token_counts.unigram_scores(RANKS)
    by = {(r.doc_id, r.n_bytes): r for r in rows}
    assert by[2, 0].n_tokens == 0 and by[3, 0].n_pretokens == 0 and by[5, 6].n_tokens == 0
    words = "One two three four five.".split()
    assert by[1, 24].n_tokens == sum(brute(b" " + w.encode(), scores)[0] for w in words)
    assert token_counts.with_token_counts(none, P.path("byte_bpe_50k.tiktoken")).count() == 0


def ids(codec, texts):
    return [np.frombuffer(x.ids, "<u4").tolist() for x in codec.encode(texts)]


def test_encoding_is_the_librarys():
    codec, rng = byte_bpe.Codec(RANKS), random.Random(2)
    letters = list("ab'sstrevlmd'' \n\t  1.!é\xa0　漢2\r9'\x85​\U0001f600")
    for _ in range(300):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(7)]
        assert ids(codec, texts) == [ENC.encode_ordinary(t) for t in texts]
    for text in ("ab" * 4000 + "x" * 3000, "".join(rng.choice("abcdefg") for _ in range(20_000)), " " * 5000, "don't we'll I've they're it's he'd I'm'x ''s"):
        assert ids(codec, [text]) == [ENC.encode_ordinary(text)]


def test_decoding_and_offsets():
    codec = byte_bpe.Codec(RANKS)
    text = "Les élèves don't — 漢字 12345  end"
    (coded,) = codec.encode([text])
    assert codec.decode(coded) == text.encode()
    offsets = codec.token_offsets(coded)
    pieces = [ENC.decode_single_token_bytes(i) for i in np.frombuffer(coded.ids, "<u4").tolist()]
    for a in range(len(text.encode()) + 1):
        for b in (a, a + 1, a + 5, 999):
            assert codec.decode(coded, a, b) == text.encode()[a:b]
    with pytest.raises(ValueError):
        codec.decode(coded._replace(starts=coded.starts + np.arange(len(coded.starts))))
    assert [codec.decode(x) for x in codec.encode(["", "é", "", "a b"])] == [b"", "é".encode(), b"", b"a b"]
    assert all(text.encode()[o : o + len(p)] == p for o, p in zip(offsets.tolist(), pieces, strict=True))


def test_digests_of_odd_rows(odd, none):
    got = byte_bpe.with_token_digests(odd, P.path("byte_bpe_50k.tiktoken"))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = sorted((str(r.doc_id), len(e := ENC.encode_ordinary(r.text or "")), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert byte_bpe.with_token_digests(none, P.path("byte_bpe_50k.tiktoken")).count() == 0
