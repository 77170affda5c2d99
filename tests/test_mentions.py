import random
import re

from quillbase.operators import mentions

WORD = re.compile(r"[^\W_]+")


def brute(pages, least=2):
    words = lambda t: WORD.findall((t or "").lower())
    titles = {}
    for path, _, title, _ in sorted(pages):
        if len(words(title)) >= least:
            titles[tuple(words(title))] = path
    names = {path: name.lower() for path, name, _, _ in pages}
    out = []
    for path, _, _, body in pages:
        held = words(body)
        links = [x.strip() for x in re.findall(r"\[\[([^\]\n|#]+)", body or "")]
        for title, target in titles.items():
            times, i = 0, 0
            while i + len(title) <= len(held):
                hit = tuple(held[i : i + len(title)]) == title
                times += hit
                i += len(title) if hit else 1
            linked = any(x.lower() == names[target] or tuple(words(x)) == title for x in links)
            if times and path != target and not linked:
                out.append((path, target, " ".join(title), times))
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    some = ["open", "data", "lake", "house", "index", "Café", "x1", "the"]
    say = lambda n: " ".join(rng.choice(some) for _ in range(n))
    pages = [(f"wiki/{i:02}.md", f"n{i}", say(rng.randint(1, 3)).title(), say(rng.randint(0, 60)) + rng.choice(["", f" [[n{rng.randint(0, 39)}]]", f" [[{say(2)}|shown]]"])) for i in range(40)]
    pages += [("wiki/a.md", "a", None, "open data"), ("wiki/b.md", "b", "Lake House", None), ("wiki/c.md", "c", "Data data", "data data data data, data")]
    df = spark.createDataFrame(pages, "path string, name string, title string, body string")
    for most in (mentions.MAX_BROADCAST, 0):
        monkeypatch.setattr(mentions, "MAX_BROADCAST", most)
        assert sorted(map(tuple, mentions.missing_links(df).collect())) == brute(pages) != []
    assert mentions.missing_links(df.limit(0)).count() == 0


def test_only_the_rarest_word_fetches(spark):
    """A title with a word that no text holds is never compared."""
    df = spark.createDataFrame([("a", "a", "The unheard", "the the the"), ("b", "b", "The heard", "said the heard once")], "path string, name string, title string, body string")
    rows = mentions.mentions(df, mentions.titles_of(df)).collect()
    assert [(r.path, r.title, r.target, r.times) for r in rows] == [("b", "the heard", "b", 1)]


def test_titles_of_the_same_words_are_not_all_compared(spark):
    """Titles that share all their words stand in all texts by these; only runs of words that begin as a title does are compared."""
    rng = random.Random(5)
    some = ["w%d" % i for i in range(12)]
    pages = [(f"p{i:03}", f"n{i}", " ".join(rng.sample(some, 6)), " ".join(rng.choices(some, k=30))) for i in range(300)]
    df = spark.createDataFrame(pages, "path string, name string, title string, body string")
    titles = mentions.titles_of(df)
    texts = df.selectExpr("path", "split(body, ' ') as w", "monotonically_increasing_id() as row")
    compared = mentions.possible(texts, titles.selectExpr("title", "size(words) as size", "words")).count()
    # by words it would be 300 texts with nearly all of 300 titles
    assert compared < 1500
    assert sorted(map(tuple, mentions.missing_links(df).collect())) == brute(pages)
    twice = spark.createDataFrame([("a", "a", "x y x", "x y x y x y x y x"), ("b", "b", "y x", "z")], "path string, name string, title string, body string")
    assert sorted(map(tuple, mentions.mentions(twice, mentions.titles_of(twice)).collect())) == [("a", "x y x", "a", 2), ("a", "y x", "b", 4)]
