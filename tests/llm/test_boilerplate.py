import random

from palimpsest.llm.boilerplate import Wrapper, article_lines, without_repeats, wrappers

CHUNKS = "ref string, url string, title string, text string, fetched_at double, host string, token string"


def site(rng, host, n):
    menu = ["Home", "News", "Contact", "Search"]
    out = []
    for i in range(n):
        title = f"How the {rng.choice('red blue green grey'.split())} engine number {i} was repaired"
        body = [f"The {rng.choice('mill boat train clock'.split())} of {rng.choice('Anna Ben Cleo Dora'.split())} stood still for {rng.randrange(99)} days in {rng.choice('Rome Oslo Bern Lima'.split())}, and part {i}-{j} was gone." for j in range(4)]
        tail = ["Related articles", f"Why the lamp number {rng.randrange(99)} was sold", "Terms of use · Privacy", f"© 20{i % 30} {host}"]
        lines = [*(f"* {m}" for m in menu), "We use cookies.", title, f"By the desk, 2025-01-{i % 28 + 1:02d}", "", *body[:2], *["Summary"] * (i % 9 == 0), *body[2:], *rng.sample(["Advertisement", "Share this"], rng.randrange(3)), *tail]
        article = {lines.index(x) for x in (title, *body)} | {n for n, x in enumerate(lines) if x == "Summary"}
        out.append((f"url:https://{host}/p{i}#x", f"https://WWW.{host.upper()}/p{i}", f"{title} - {host}", "\n".join(lines), article))
    return out


def test_articles(spark, rows):
    rng = random.Random(1)
    pages = [p for h, n in (("one.example", 70), ("two.example", 12), ("three.example", 9), ("four.example", 8), ("lone.test", 1)) for p in site(rng, h, n)]
    data = [(r, u, t, x, 1.0, "h", "t") for r, u, t, x, _ in pages]
    data += data[:5] + [("url:x", None, None, None, None, "h", "t"), (None, None, None, "lost", 1.0, "h", "t"), ("url:y", None, None, "", None, "h", "t"), ("url:z", None, None, "word " * 30_000, 1.0, "h", "t")]
    got: dict = {}
    for ref, n in rows(article_lines(spark.createDataFrame(data, CHUNKS)), "ref", "line_no"):
        got.setdefault(ref, set()).add(n)
    want = {r: a for r, _, _, _, a in pages}
    hits = sum(len(got.get(r, set()) & a) for r, a in want.items())
    lost = [t.split(chr(10))[n] for r, _, _, t, a in pages for n in a - got.get(r, set())]
    extra = [t.split(chr(10))[n] for r, _, _, t, a in pages for n in got.get(r, set()) - a]
    assert hits / sum(map(len, want.values())) > 0.98, (lost[:9], extra[:9], len(lost), len(extra))
    assert hits / sum(len(v) for k, v in got.items() if k in want) > 0.95


def test_empty(spark):
    assert article_lines(spark.createDataFrame([], CHUNKS)).count() == 0


def test_wrapper():
    pages = [["a", "b", *([] if i % 4 else ["o"]), f"x{i}", *(["ad"] if i % 3 == 1 else []), f"y{i}", *["r"] * (1 + i % 3), "z"] for i in range(20)]
    wrapper = Wrapper(pages)
    assert wrapper.expression() == "a b [text ad?] (r)+ z"
    by_token = dict(zip(pages[1], wrapper.places[1], strict=True))
    assert by_token["a"] == by_token["b"] == 0 and by_token["x1"] == by_token["ad"] == 1 and by_token["z"] == 2
    assert without_repeats(list("xababyy")) == [("x", 1, 0), ("a", 2, 1), ("b", 2, 2), ("y", 2, 5)]
    assert Wrapper([[f"x{i}", f"y{i}", "z"] for i in range(9)]).expression() == "[text] z"
    assert Wrapper([]).places == [] and Wrapper([]).expression() == ""


def test_the_place_decides(spark, rows):
    """A menu's word is text where it is a heading of the article; counts of pages by word couldn't tell them apart."""
    rng = random.Random(3)
    pages = site(rng, "five.example", 40)
    ref, url, title, text, _ = pages[7]
    lines = text.split("\n")
    lines[9:9] = ["Contact"]
    long = "The start of the two is the same and goes on for long, " * 8
    lines[10:10] = [long + "one.", long + "other."]
    pages[7] = (ref, url, title, "\n".join(lines), None)
    data = [(r, u, t, x, 1.0, "h", "t") for r, u, t, x, _ in pages]
    data.append((ref, url, title, "An older read", 0.5, "h", "t"))
    df = spark.createDataFrame(data, CHUNKS)
    got = {n for r, n in rows(article_lines(df), "ref", "line_no") if r == ref}
    contact = [n for n, x in enumerate(lines) if x in ("Contact", "* Contact")]
    assert len(contact) == 2 and contact[0] not in got and contact[1] in got
    assert {n for n, x in enumerate(lines) if x.startswith(long)} <= got
    told = wrappers(df).collect()
    assert len(told) == 1 and told[0].pages == 40 and "[text" in told[0].expression and "(contact)" not in told[0].expression and "contact" in told[0].expression
