import hashlib
import random
import re

import numpy as np
import pytest

from quillbase.llm import pii

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
]


def brute(text):
    return [(k, *m.span()) for k, p, ok in PATTERNS for m in re.finditer(p, text) if ok(m[0])]


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger().fit(*pii.training_windows(["the and of that with over " * 20]))


def test_base_spans():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("1234567890...@@ab-+ ()%é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute(text)
    assert pii.base_spans("4111 1111 1111 1111, a.b@c.de; 10.0.0.255 +1 (234) 555-0000") == brute("4111 1111 1111 1111, a.b@c.de; 10.0.0.255 +1 (234) 555-0000") != []


def test_long_texts_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "@" * 100_000):
        pii.base_spans(text)


def test_gradients(tagger):
    x, y = pii.training_windows(["call +1 (234) 555-0000 or a.b@c.de now"])
    t = pii.Tagger()
    _, g = t.gradients(x[:3], y[:3])
    for name in t.p:
        at = tuple(int(i) for i in np.unravel_index(np.abs(g[name]).argmax(), g[name].shape))
        e = 1e-5
        t.p[name][at] += e
        up, _ = t.gradients(x[:3], y[:3])
        t.p[name][at] -= 2 * e
        down, _ = t.gradients(x[:3], y[:3])
        t.p[name][at] += e
        assert g[name][at] == pytest.approx((up - down) / 2 / e, rel=1e-3, abs=1e-6)


#: Written by hand, not by disguise().
LINES = [
    ("email", "anna [at] example [dot] com"), ("email", "jane dot doe at example dot com"), ("email", "please ask jane (At) example (Dot) com for it"),
    ("email", "write to bob at mail dot org tomorrow"), ("email", "mail me: tom{at}site{dot}net"), ("email", "my address is lisa.m @ uni-bonn . de thanks"),
    ("email", "support AT company DOT co DOT uk"), ("email", "contact maria<at>correo<dot>es por favor"), ("email", "peter_99 (at) web.de"),
    ("email", "info [ at ] shop [ dot ] example [ dot ] fr"), ("email", "john.smith at gmail.com, he said"), ("email", "j.kim-at-corp-dot-com"),
    ("email", "kontakt: eva (at) verein (punkt) de oder eva [at] verein [dot] de"), ("email", "ask Sam.Lee at acme DOT io now"),
    ("card", "card 4111.1111.1111.1111"), ("card", "paid with 4111-1111/1111 1111"), ("card", "4012 / 8888 / 8888 / 1881 is the number"),
    ("card", "visa 5555.5555.5555.4444 exp soon"), ("card", "use 4242_4242_4242_4242 please"), ("card", "the card (4000 - 0566 - 5566 - 5556) was lost"),
    ("ip", "server 10 dot 0 dot 0 dot 1 is down"), ("ip", "ping 192[.]168[.]1[.]20 first"), ("ip", "the box at 172 . 16 . 254 . 3 hangs"),
    ("ip", "host 8(dot)8(dot)4(dot)4 answers"), ("ip", "route via 10-20-30-40 only"),
    ("phone", "call me on 555 123 4567 today"), ("phone", "reach her under 030 12345678 after six"), ("phone", "tel. 0171-2345678 evenings"),
    ("phone", "phone (415) 555-2671 or visit"), ("phone", "ring 0044 20 7946 0958 and ask"), ("phone", "my number: 212.555.0147"),
    ("phone", "five five five one two three four is mine"), ("phone", "06 12 34 56 78 le soir"), ("phone", "whatsapp 49 170 1234567 now"),
]


@pytest.mark.parametrize("n", [82, 300])
def test_held_out_lines(spark, n):
    """Data written in ways that no pattern has, after fits on few and on all texts of the bound."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '[0-9@]' and length(text) <= 20000").orderBy("doc_id").limit(n).collect()
    fitted = pii.Tagger().fit(*pii.training_windows([r.text for r in docs]))
    hit = sum(any(k == kind for k, _, _ in base + added) for (kind, _), (base, added) in zip(LINES, pii.find([x for _, x in LINES], fitted), strict=True))
    assert hit >= 0.9 * len(LINES)
    rest = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sum(len(added) for _, added in pii.find(rest, fitted)) <= 3


def test_held_out_disguises(tagger):
    rng = random.Random(77)
    for kind in pii.KINDS:
        texts = []
        for _ in range(60):
            texts.append(f"that with {pii.disguise(kind, pii.invent(kind, rng), rng)} over of the")
        hit = sum(bool(base or added) for base, added in pii.find(texts, tagger))
        assert hit >= 42, (kind, hit)


def test_clean_text_stays(tagger):
    texts = ["In 1999 there were 1,234 of them, 3.14 on average; see 12.5.2020.", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "no digits at all"]
    assert all(not base and not added for base, added in pii.find(texts, tagger))


def test_windows_are_reconciled(tagger):
    """A long text is decoded in windows, and a span in it is found wherever it lies."""
    hit = 0
    for pad in range(1, 71, 5):
        text = "the 9 " * 20 + ("with that over and of the " * 3)[-pad:] + " " + "jane.roe [at] mail [dot] com" + " of 8 " * 20
        ((_, added),) = pii.find([text], tagger)
        hit += any(text[a:b] == "jane.roe [at] mail [dot] com" for _, a, b in added)
    assert hit >= 9


def test_odd_rows(odd, none, tagger):
    got = pii.with_spans(odd, tagger)
    rows = got.collect()
    assert len(rows) == odd.count() and all(r.base == r.spans == "" for r in rows)
    assert pii.with_spans(none, tagger).count() == 0


def test_redaction(spark, tagger):
    text = "mail a.b@c.de or +1 (234) 555-0000."
    (r,) = pii.with_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), tagger).collect()
    assert r.redacted == "mail <EMAIL> or <PHONE>." and (r.n_email, r.n_phone) == (1, 1)


def test_query_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in pii.op7_pii(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = brute(d.text or "")
        r = got[d.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
