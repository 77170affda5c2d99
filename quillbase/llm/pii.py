"""Operator 7, personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns (e-mail, IP address, payment card, phone) give the base spans, each kind leftmost and without overlaps.
They are found in time linear in the text: e-mails from their "@", addresses from runs of digits and dots.

The model finds what the patterns miss, data written so as to be read by people only ("name at host dot com", cards with
other signs between digits, phones without "+"). It is trained in numpy from labelled spans: windows of a bounded sample (of
MAX_SCREENED documents of up to MAX_CHARS characters, by a hash of the id, MAX_SAMPLE with digits or "@") whose labels
are the base spans; up to PER_TEXT copies of spans of each text rewritten in many ways; INVENTED examples of each kind; and windows
without data, of the sample and with invented dates, versions, sums and hexadecimal numbers. Those are all bounds of the fit.

It reads, in overlapping windows, all text within AROUND characters of anything that such data can't do without: a digit, "@",
"at" in any brackets, "dot" as a word, a dot within a word, or two numerals as words; case doesn't matter. The windows' scores are
added up for each character, weighted by the distance to the window's ends, and one Viterbi pass with the CRF's transitions
decides each region as a whole. Which characters are a span, the CRF alone says; it is kept if it stands apart from letters
and digits, can be of its kind (numbers of an address at most 255, Luhn's sum, a count of digits, words of an e-mail)
and touches no base span.

Null texts are empty and have no spans. Very long texts are whole; their regions are read some at a time. Rows are kept as
they are, whatever their ids; columns not asked for are dropped, and one asked for with the name of a result gives way
to it. Without documents the model learns from generated spans alone. Equal samples are fitted once a session.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_document, sampled, table

KINDS = ("email", "ip", "card", "phone")
MAX_SAMPLE = 300
MAX_SCREENED = 6000
MAX_CHARS = 20_000
PER_TEXT, INVENTED, NOISE = 4, 1000, 1200
WINDOW, STRIDE, AROUND = 64, 32, 28
HIDDEN = 24
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMERAL = r"(?:zero|one|two|three|four|five|six|seven|eight|nine|oh)"
_TRIGGER = re.compile(rf"(?i)[0-9@]|[\[({{<*_-] ?at ?[\])}}>*_-]|\bdot\b|[a-z]\.[a-z]|\b{_NUMERAL}[ -]{_NUMERAL}\b")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _EMAIL.match(text, start) if start < at else None
        if match:
            yield match.span()
        done = match.end() if match else at + 1
        at = text.find("@", done)


def _byte(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _ips(text: str):
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        groups, at = [], run.start()
        for part in run[0].split("."):
            groups.append((part, at))
            at += len(part) + 1
        i = 0
        while i + 3 < len(groups):
            four = groups[i : i + 4]
            if all(part for part, _ in four):
                if all(_byte(part) for part, _ in four):
                    yield four[0][1], four[3][1] + len(four[3][0])
                i += 4
            else:
                i += 1


def _cards(text: str):
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield match.span()


def _phones(text: str):
    at = text.find("+")
    while at >= 0:
        match = _PHONE.match(text, at)
        if match and 8 <= sum(c.isdigit() for c in match[0]) <= 15:
            yield match.span()
        at = text.find("+", match.end() if match else at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns in code points, by kind as listed, then start."""
    found = [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        found += [(k, *s) for k, f in (("ip", _ips), ("card", _cards), ("phone", _phones)) for s in f(text)]
    return found


# ---- the model

_SYMBOLS = {c: i for i, c in enumerate("\0abcdefghijklmnopqrstuvwxyz0@.-+() _%[]<>{}/:,;\n'\"#*=", 0)}
_SYMBOLS |= {c.upper(): i for c, i in _SYMBOLS.items() if c.islower()}
_WIDE, _REST = max(_SYMBOLS.values()) + 1, max(_SYMBOLS.values()) + 2
N_SYMBOLS = _REST + 1
#: Outside, then the beginning and inside of each kind.
N_LABELS = 1 + 2 * len(KINDS)


def symbols(text: str) -> np.ndarray:
    get = _SYMBOLS.get
    return np.array([get(c) or (_SYMBOLS["0"] if "0" <= c <= "9" else _WIDE if c.isalpha() else _REST) for c in text], np.int32)


def label_array(n: int, spans, offset: int = 0) -> np.ndarray:
    labels = np.zeros(n, np.int32)
    for kind, start, end in spans:
        a, b = max(0, start - offset), min(n, end - offset)
        if a < b:
            k = 1 + 2 * KINDS.index(kind)
            labels[a:b] = k + 1
            if start >= offset:
                labels[a] = k
    return labels


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Emissions from two LSTMs over the symbols, and CRF transitions between labels."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {"A": np.zeros((N_LABELS, N_LABELS)), "Wo": rng.normal(0, 0.2, (2 * h, N_LABELS)), "bo": np.zeros(N_LABELS)}
        for d in "fb":
            self.p |= {f"Wx{d}": rng.normal(0, 0.3, (N_SYMBOLS, 4 * h)), f"Wh{d}": rng.normal(0, 0.2, (h, 4 * h))}
            self.p[f"Wx{d}"][:, h : 2 * h] += 1  # remember at first

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        h = HIDDEN
        pre, wh = self.p[f"Wx{d}"][x.T], self.p[f"Wh{d}"]  # time, batch, gates
        steps, n = pre.shape[:2]
        out = np.zeros((steps + 1, n, h), pre.dtype)
        c = np.zeros((n, h), pre.dtype)
        kept = []
        for t in range(steps):
            z = pre[t] + out[t - 1 if t else steps] @ wh
            gate = _sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            before, c = c, gate[:, h : 2 * h] * c + gate[:, :h] * new
            tc = np.tanh(c)
            out[t] = gate[:, 2 * h :] * tc
            if keep:
                kept.append((gate, new, before, tc))
        return out[:steps], kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """batch x time x labels"""
        f, _ = self._lstm(x, "f", False)
        b, _ = self._lstm(x[:, ::-1], "b", False)
        return (np.concatenate((f, b[::-1]), axis=2) @ self.p["Wo"] + self.p["bo"]).transpose(1, 0, 2)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h = HIDDEN
        runs = {"f": self._lstm(x, "f", True), "b": self._lstm(x[:, ::-1], "b", True)}
        hidden = np.concatenate((runs["f"][0], runs["b"][0][::-1]), axis=2)
        e = hidden @ self.p["Wo"] + self.p["bo"]
        loss, de, da = self._crf(e, y.T)
        g = {"A": da, "Wo": np.einsum("tbh,tbk->hk", hidden, de), "bo": de.sum(axis=(0, 1))}
        dh = de @ self.p["Wo"].T
        for d in "fb":
            out, kept = runs[d]
            grad = dh[:, :, :h] if d == "f" else dh[::-1, :, h:]
            xs = x.T if d == "f" else x[:, ::-1].T
            wh = self.p[f"Wh{d}"]
            gh, into = np.zeros_like(wh), np.zeros((*xs.shape, 4 * h), wh.dtype)
            back, dc = np.zeros_like(out[0]), np.zeros_like(out[0])
            for t in range(len(kept) - 1, -1, -1):
                gate, new, before, tc = kept[t]
                total = grad[t] + back
                i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
                dc = dc + total * o * (1 - tc**2)
                dz = np.concatenate((dc * new * i * (1 - i), dc * before * f * (1 - f), total * tc * o * (1 - o), dc * i * (1 - new**2)), axis=1)
                dc = dc * f
                into[t] = dz
                if t:
                    gh += out[t - 1].T @ dz
                back = dz @ wh.T
            hot = np.zeros((xs.size, N_SYMBOLS), wh.dtype)
            hot[np.arange(xs.size), xs.ravel()] = 1
            g |= {f"Wx{d}": hot.T @ into.reshape(xs.size, -1), f"Wh{d}": gh}
        return loss, g

    def _crf(self, e: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood of labels y (time x batch), and its gradients."""
        a = self.p["A"]
        steps, n, _ = e.shape
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        add = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = add(alpha[t - 1][:, :, None] + a, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = add(a + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = add(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        da = np.zeros_like(a)
        for t in range(1, steps):
            da += np.exp(alpha[t - 1][:, :, None] + a + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(da, (y[:-1].ravel(), y[1:].ravel()), -1)
        score = np.take_along_axis(e, y[:, :, None], 2).sum() + a[y[:-1], y[1:]].sum()
        rows = np.arange(n)
        for t in range(steps):
            de[t, rows, y[t]] -= 1
        return float(z.sum() - score) / n, de / n, da / n

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 16, batch: int = 80, rate: float = 0.02, seed: int = 3) -> "Tagger":
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                part = order[at : at + batch]
                _, g = self.gradients(x[part], y[part])
                step += 1
                fade = rate * (1 - step / (1 + epochs * -(-len(x) // batch)))
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] -= fade * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Labels of regions of one length: batch x time x labels."""
        a = self.p["A"]
        best, back = scores[:, 0], []
        for t in range(1, scores.shape[1]):
            total = best[:, :, None] + a
            back.append(total.argmax(axis=1))
            best = total.max(axis=1) + scores[:, t]
        label = [best.argmax(axis=1)]
        rows = np.arange(len(scores))
        for b in reversed(back):
            label.append(b[rows, label[-1]])
        return np.array(label[::-1]).T

    def labels(self, texts: list[str]) -> list[np.ndarray]:
        """The label of each character; overlapping windows are added up, then each text is decoded as a whole."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            longest = max(WINDOW, len(texts[order[at]]))
            end = at
            while end < len(order) and (end == at or (end - at + 1) * max(longest, len(texts[order[end]])) <= 1 << 16):
                longest = max(longest, len(texts[order[end]]))
                end += 1
            longest = WINDOW + -(-(longest - WINDOW) // STRIDE) * STRIDE
            x = np.zeros((end - at, longest), np.int32)
            for row, i in enumerate(order[at:end]):
                x[row, : len(texts[i])] = symbols(texts[i])
            starts = range(0, longest - WINDOW + 1, STRIDE)
            weight = np.minimum(np.arange(WINDOW) + 1, np.arange(WINDOW)[::-1] + 1).astype(float)
            scores, total = np.zeros((*x.shape, N_LABELS)), np.zeros(longest)
            for start in starts:
                e = self.emissions(x[:, start : start + WINDOW])
                scores[:, start : start + WINDOW] += e * weight[:, None]
                total[start : start + WINDOW] += weight
            found = self.viterbi(scores / total[:, None])
            for row, i in enumerate(order[at:end]):
                out[i] = found[row, : len(texts[i])]
            at = end
        return out


def spans_of(labels: np.ndarray) -> list[tuple[str, int, int]]:
    found, at = [], 0
    marked = labels.tolist()
    while at < len(marked):
        if marked[at]:
            kind, end = (marked[at] - 1) // 2, at + 1
            while end < len(marked) and marked[end] == 2 + 2 * kind:
                end += 1
            found.append((KINDS[kind], at, end))
            at = end
        else:
            at += 1
    return found


# ---- training data


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_NUMERALS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def _sign(word: str, sign: str, rng: random.Random) -> str:
    """A sign as a word, in brackets or between spaces; or with spaces around it."""
    case = rng.choice([str.lower, str.lower, str.upper, str.title])
    left, right = rng.choice(["[]", "()", "{}", "<>", "--", "__", "**"])
    inner, outer = " " * (rng.random() < 0.2), " " * (rng.random() < 0.6)
    kind = rng.random()
    if kind < 0.45:
        return outer + left + inner + case(word) + inner + right + outer
    if kind < 0.55:
        return outer + left + sign + right + outer
    return f" {case(word)} " if kind < 0.85 else f" {sign} "


def _numbers(digits: str, sizes: list[int], rng: random.Random) -> str:
    between = rng.choice([" ", " ", ".", "-", "/", "_", "  ", " - ", " . ", ":", "|", " / ", ","])
    parts, at = [], 0
    for n in sizes:
        parts.append(digits[at : at + n])
        at += n
    return between.join([*parts, *([digits[at:]] if at < len(digits) else [])])


def disguise(kind: str, span: str, rng: random.Random) -> str:
    """The span as people write it to hide it from machines, or carelessly."""
    if kind == "email":
        name, _, host = span.partition("@")
        dot = _sign("dot", ".", rng) if rng.random() < 0.8 else "."
        return name.replace(".", rng.choice([".", dot])) + (_sign("at", "@", rng) if rng.random() < 0.95 or dot == "." else "@") + host.replace(".", dot)
    if kind == "ip":
        return span.replace(".", rng.choice([_sign("dot", ".", rng), _sign("dot", ".", rng), "[.]", "(.)", " . ", ",", "-", ":"]))
    digits = re.sub(r"\D", "", span)
    if kind == "card":
        return _numbers(digits, [4] * 4 if rng.random() < 0.85 else [4, 6], rng)
    if rng.random() < 0.12:
        return rng.choice([" ", "-", ", "]).join(_NUMERALS[int(d)] for d in digits[:10])
    own = rng.choice([digits[:10], digits[-10:], "0" + digits[-9:], "00" + digits])
    own = own[: rng.choice([7, 10, 10, 10, 11, 13])] if not own.startswith("00") else own[:13]
    if rng.random() < 0.25:
        return f"({own[:3]}){rng.choice(['', ' ', '-'])}{_numbers(own[3:], [3], rng)}"
    return _numbers(own, rng.choice([[3, 3], [3, 3], [3, 4], [2, 2, 2, 2], [3], [4, 3], [2, 4]]), rng)


def invent(kind: str, rng: random.Random) -> str:
    pick = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    word = lambda: pick(_LETTERS, rng.randint(2, 8)) if rng.random() < 0.3 else "".join(pick("bcdfghjklmnprstvwz", 1) + pick("aeiou", 1) + pick("lnrst", rng.randint(0, 1)) for _ in range(rng.randint(1, 3)))
    if kind == "email":
        name = rng.choice([word(), f"{word()}.{word()}", f"{word()}.{pick(_DIGITS, 2)}", f"{word()}_{word()}", word() + pick(_DIGITS, rng.randint(1, 3))])
        host = rng.choice([word(), word() + pick(_DIGITS, 1), f"{word()}.{word()}", f"{word()}-{word()}", "example", "mail"])
        return f"{name}@{host}.{rng.choice(['com', 'com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk', 'info'])}"
    if kind == "ip":
        return ".".join(str(rng.choice([rng.randint(0, 255), rng.randint(0, 9), 10, 192])) for _ in range(4))
    if kind == "card":
        digits = pick("3456", 1) + pick(_DIGITS, 14)
        return next(digits + d for d in _DIGITS if luhn(digits + d))
    return f"+{rng.randint(1, 99)} ({pick('123456789', 1)}{pick(_DIGITS, 2)}) {pick(_DIGITS, 3)}-{pick(_DIGITS, 4)}"


def _noise(rng: random.Random) -> str:
    """Text with digits, "at" or "dot" that is no personal data."""
    n = rng.randint
    return rng.choice([
        "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 16, 32, 40]))), str(n(1, 10 ** n(1, 7))), f"{n(1, 31)}.{n(1, 12)}.{n(1900, 2030)}", f"{n(1900, 2030)}-{n(1, 12):02}-{n(1, 28):02} {n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}",
        f"{n(1, 999)},{n(0, 999):03}", f"{n(1, 999)},{n(0, 999):03},{n(0, 999):03}", f"{n(0, 99)}.{n(0, 99)}", f"version {n(0, 9)}.{n(0, 20)}.{n(0, 9)}", f"{n(1, 12)}:{n(0, 59):02} pm", f"pages {n(1, 99)}-{n(100, 400)}", f"{n(1, 90)} %", f"${n(1, 999)}.{n(0, 99):02}",
        "at the dot on the map", "a dot com company", "look at this dot and that one", "he was at home at last", "one two three and go", "a polka dot dress", f"chapter {n(1, 30)}, section {n(1, 9)}.{n(1, 9)}", f"at {n(1, 12)} or {n(1, 12)}", "(at least) one", "e.g. this, i.e. that", "www.site.org", "end.The next", f"{n(1, 9)} x {n(1, 9)} = {n(1, 81)}", f"no. {n(1000, 99999)}",
    ])


def training_windows(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows around the base spans of texts and around triggers without any, then rewritten, invented and empty ones."""
    rng = random.Random(seed)
    made: list[tuple[str, list[tuple[str, int, int]]]] = []
    for text in texts:
        spans = base_spans(text)
        for kind, start, end in rng.sample(spans, min(PER_TEXT, len(spans))):
            made.append((text[max(0, start - rng.randint(5, 30)) : end + 30], []))
            left, right = text[max(0, start - rng.randint(0, 25)) : start], text[end : end + 25]
            other = disguise(kind, text[start:end], rng)
            made.append((left + other + right, [(kind, len(left), len(left) + len(other))]))
        triggers = list(_TRIGGER.finditer(text))
        for trigger in rng.sample(triggers, min(PER_TEXT, len(triggers))):
            made.append((text[max(0, trigger.start() - rng.randint(5, 40)) : trigger.start() + 40], []))
    words = [w for t in texts for w in t.split()] + ["the", "and", "of", "to", "in", "call", "me", "on", "write", "card", "mail", "from", "today", "please", "or", "is", "at"] * 40
    words += [rng.choice(_LETTERS) * rng.randint(1, 30) if rng.random() < 0.1 else "".join(rng.choices(_LETTERS if rng.random() < 0.7 else _DIGITS, k=min(rng.randint(1, 9), rng.randint(1, 9)))) for _ in range(len(words) // 4)]
    some = lambda: " ".join(rng.choices(words, k=rng.randint(0, 4)))
    for kind in KINDS:
        for i in range(INVENTED):
            span = invent(kind, rng)
            if i % 5:
                span = disguise(kind, span, rng)
            cue = rng.choice(["", "", "", {"email": "mail", "ip": "host", "card": "card", "phone": "call"}[kind] + rng.choice([" ", ": "])])
            left = some()
            left += " " * bool(left) + cue
            made.append((f"{left}{span}{rng.choice([' ', ' ', ', ', '. ', ''])}{some() if rng.random() < 0.9 else ''}", [(kind, len(left), len(left) + len(span))]))
    for _ in range(NOISE):
        made.append((f"{some()} {_noise(rng)} {some()} {_noise(rng) if rng.random() < 0.3 else ''}", []))
    x, y = np.zeros((len(made), WINDOW), np.int32), np.zeros((len(made), WINDOW), np.int32)
    for row, (text, spans) in enumerate(made):
        text = text[:WINDOW]
        x[row, : len(text)] = symbols(text)
        y[row, : len(text)] = label_array(len(text), spans + [s for s in base_spans(text) if not any(a < s[2] and s[1] < b for _, a, b in spans)])
    return x, y


#: Taggers of this session by the digest of their sample.
_FITTED: dict[str, Tagger] = {}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    screened = sampled(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= MAX_CHARS), "id", MAX_SCREENED)
    wanted = screened.where(F.regexp_like("text", F.lit("[0-9@]")))
    sample = wanted.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(MAX_SAMPLE)
    texts = [r.text for r in sample.collect()]
    code = hashlib.sha256("\0".join(texts).encode()).hexdigest()
    if code not in _FITTED:
        _FITTED[code] = Tagger().fit(*training_windows(texts))
    return _FITTED[code]


# ---- finding


def _fits(kind: str, text: str) -> bool:
    """Whether a span can be of its kind at all, however it is written."""
    numbers = re.findall(r"[0-9]+", text)
    digits = "".join(numbers)
    if kind == "ip":
        return len(numbers) == 4 and all(map(_byte, numbers))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) + len(re.findall(rf"(?i)\b{_NUMERAL}\b", text)) <= 15
    runs = re.findall(r"[A-Za-z0-9]+", text)
    return len(runs) >= 3 and runs[-1].isalpha() and 2 <= len(runs[-1]) <= 6 and (len(runs) >= 5 or "@" in text or "." in text or bool(re.search(r"[\[({<*_]", text)))


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Without signs and white space at the ends, but for an opening bracket or plus of a number."""
    while b > a and not text[b - 1].isalnum():
        b -= 1
    while a < b and not (text[a].isalnum() or text[a] in "(+" and text[a + 1 : a + 2].isdigit()):
        a += 1
    return a, b


def find(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    found = []
    regions: list[tuple[int, int, int]] = []
    for i, text in enumerate(texts):
        spans = base_spans(text)
        found.append((spans, []))
        taken = sorted((a, b) for _, a, b in spans)
        at, end = 0, -1
        first = None
        for trigger in _TRIGGER.finditer(text):
            p = trigger.start()
            while at < len(taken) and taken[at][1] <= p:
                at += 1
            if at < len(taken) and taken[at][0] <= p:
                continue
            if first is not None and p - AROUND > end:
                regions.append((i, first, min(end, len(text))))
                first = None
            if first is None:
                first = max(0, p - AROUND)
            end = trigger.end() + AROUND
        if first is not None:
            regions.append((i, first, min(end, len(text))))
    for (i, start, _), labels in zip(regions, tagger.labels([texts[i][a:b] for i, a, b in regions]), strict=True):
        text, (base, added) = texts[i], found[i]
        for kind, a, b in spans_of(labels):
            a, b = _trimmed(text, a + start, b + start)
            if a >= b or not _fits(kind, text[a:b]):
                continue
            apart = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
            if apart and not any(a < y and x < b for _, x, y in base + added):
                added.append((kind, a, b))
    return found


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def with_spans(df: DataFrame, tagger: Tagger, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row n_email, n_ip, n_card, n_phone and base (of the patterns), spans (those and the model's) and redacted."""
    sent = df.sparkSession.sparkContext.broadcast(tagger)

    def make():
        def call(texts):
            texts = [t or "" for t in texts]
            rows = []
            for text, (base, added) in zip(texts, find(texts, sent.value), strict=True):
                counts = [sum(k == s[0] for s in base) for k in KINDS]
                out, at = [], 0
                for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
                    if b > at:
                        out += [text[at : max(at, a)], f"<{kind.upper()}>" if a >= at else ""]
                        at = b
                rows.append((*counts, joined(base), joined(base + added), "".join(out) + text[at:]))
            return list(zip(*rows, strict=True)) if rows else [[]] * 7

        return call

    return per_document(df, make, "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, redacted string", text_col, keep)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = with_spans(docs, train(docs))
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", n_spans)
