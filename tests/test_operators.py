import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import is_blank, norm_entity, seconds, sha_id
from palimpsest.operators.chains import resolve_chains
from palimpsest.operators.graph import communities
from palimpsest.operators.journal import OPERATIONS, corrected, standing
from palimpsest.operators.search import bm25, fused, query_terms
from palimpsest.operators.spans import extract_spans, overlaps, scope_bound, spans_of, time_scope
from palimpsest.operators.windows import containment, needs_context, sentences, shingles, text_windows


def test_chains(spark, rows):
    nodes = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "gone"), ("f", "e"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("b", "a"), (None, "a")]
    got = {r[0]: r[1:] for r in rows(resolve_chains(spark.createDataFrame(nodes, "node string, parent string")))}
    assert got["d"] == ("a", 3, "ok") and got["a"] == ("a", 0, "ok")
    assert got["f"] == ("e", 1, "orphan") and got["e"] == ("e", 0, "orphan")
    assert {k for k, v in got.items() if v[2] == "cycle"} == {"x", "y", "z", "s"}
    assert resolve_chains(spark.createDataFrame([], "node string, parent string")).count() == 0


def test_weighted_chain(spark, rows):
    nodes = [(i, i - 1 if i else None, i + 1) for i in range(40)]
    got = {r[0]: r[2] for r in rows(resolve_chains(spark.createDataFrame(nodes, "node int, parent int, w int"), weight="w"))}
    assert got == {i: sum(range(1, i + 1)) for i in range(40)}


def test_identity(spark, rows):
    df = spark.createDataFrame([("The  Old Van's ",), (" an Apple.",), (None,), ("their",)], "s string")
    assert [r[0] for r in df.select(norm_entity(F.col("s"))).collect()] == ["old van", "apple", "", "their"]
    assert spark.range(1).select(sha_id(F.lit("chat:1:ab"), F.lit(0))).first()[0] == hashlib.sha1(b"chat:1:ab\x1f0\x1f").hexdigest()[:16]
    blanks = spark.createDataFrame([("",), (None,), ("  ​\n",), ("x",)], "s string").select(is_blank(F.col("s")))
    assert [r[0] for r in blanks.collect()] == [True, True, True, False]
    assert spark.range(1).select(seconds(F.lit(1735884600500.0))).first()[0] == 1735884600.5


def test_sentences_and_windows():
    assert sentences("Dr. Who left. He came back!") == ["Dr. Who left.", "He came back!"]
    assert sentences('"Yes!" (ok) then.\n\n- one\n- two') == ['"Yes!', "(ok) then.", "- one", "- two"]
    assert sentences("") == [] and text_windows("") == [] and text_windows(None) == []
    windows = text_windows("One. Two. Three. Four. Five.")
    assert windows == ["One. Two. Three.", "Four. Five."]
    long = "word " * 400
    assert all(len(w) <= 480 for w in text_windows(long)) and "".join(text_windows(long)).replace(" ", "") == long.replace(" ", "")
    code = "Before.\n```\n" + "x = 1\n" * 300 + "```\nAfter."
    assert text_windows(code)[1].endswith(" …") and len(text_windows(code)[1]) <= 482 and text_windows(code)[2] == "After."


def test_text_columns(spark):
    row = spark.createDataFrame([("a b c d e f", "a b c d e x", "Yes please do that right now for me and for everybody in this house today")], "a string, b string, c string")
    got = row.select(containment(shingles(F.col("a")), shingles(F.col("b"))), needs_context(F.col("c")), needs_context(F.col("a")), F.size(shingles(F.lit("")))).first()
    assert tuple(got) == (0.5, True, True, 0)


SAID = dt.datetime(2026, 9, 20, 12, tzinfo=dt.UTC).timestamp()  # a Sunday


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("next Tuesday at 9:30am", "time", "2026-09-22T09:30"), ("the second week of May", "time", "2027-05-08/2027-05-15"), ("in May 2023", "time", "2023-05"), ("since 2007", "time", "2007"),
        ("two weeks ago", "time", "2026-09-06"), ("in three months", "time", "2026-12-20"), ("yesterday", "time", "2026-09-19"), ("last month", "time", "2026-08"), ("2025-03-14", "time", "2025-03-14"),
        ("it cost $12.40", "money", "12.4 USD"), ("about 3 million euros", "money", None), ("2k EUR", "money", None), ("for two hours", "duration", "PT2H"), ("6.5 km", "quantity", "6.5 km"),
        ("see https://a.example/x.", "contact", "https://a.example/x"), ("mail a.b@c.example now", "contact", "a.b@c.example"), ("run /srv/notes/1.md", "artifact", "/srv/notes/1.md"), ("v2.59.1 is out", "artifact", "v2.59.1"),
        ("during 2019", "time", "2019"), ("from 2020 on", "time", "2020"), ("of 2021", "time", "2021"), ("by 2030", "time", "2030"), ("the 12th of June, 2021", "time", "2021-06-12"), ("May 5", "time", "2026-05-05"),
        ("May 5, 2024 at 14:30", "time", "2024-05-05T14:30"), ("the day after tomorrow at 3 p.m.", "time", "2026-09-22T15:00"), ("this weekend", "time", "2026-09-19/2026-09-21"), ("on Sunday", "time", "2026-09-20"), ("next Sunday", "time", "2026-09-27"),
        ("last Friday", "time", "2026-09-18"), ("a couple of days ago", "time", "2026-09-18"), ("last week of February", "time", "2027-02-22/2027-03-01"), ("in January", "time", "2027-01"), ("last October", "time", "2025-10"), ("next year", "time", "2027"),
        ("5 km/h", "quantity", "5 km/h"), ("20 °C outside", "quantity", "20 °c"), ("300 tokens", "quantity", "300 tokens"), ("6 foot", "quantity", "6 foot"), ("at 10 mph", "quantity", "10 mph"), ("50%", "quantity", "50 %"), ("1,250 steps", "quantity", "1250 steps"),
        ("€2,500.50 now", "money", "2500.5 EUR"), ("$5k", "money", "5000 USD"), ("20 bucks", "money", "20 USD"), ("call +1 (555) 123-4567", "contact", "+15551234567"), ("555-123-4567", "contact", "5551234567"), ("`ls -la`", "artifact", "ls -la"),
        ("AB-12 is open", "artifact", "AB-12"), ("see #123", "artifact", "#123"), ("~/notes/today.md", "artifact", "~/notes/today.md"), ("a few minutes", "duration", "PT3M"), ("twelve years", "duration", "P12Y"),
    ],
)
def test_spans(text, kind, value):
    found = [x for x in extract_spans(text, SAID) if x[2] == kind]
    assert [x[3] for x in found[:1]] == [value] if value else True


@pytest.mark.parametrize("text", ["5 kmx", "it may be", "march on", "2025-13-40", "in 3000", "1.2", "in two hours' time 99:99", "AB-", "#1", "https://", "a@b", "``", "/ and /x", "may 99", "9 0", "week of may", "seconds"])
def test_no_false_values(text):
    assert [x for x in extract_spans(text, SAID) if x[2] not in ("duration", "time") or x[3][:4] not in ("2026",)] == []


def test_questions_look_back():
    stamp = lambda *a: dt.datetime(*a, tzinfo=dt.UTC).timestamp()
    assert time_scope("what did she say on Friday?", SAID) == (stamp(2026, 9, 18), stamp(2026, 9, 19), "any")
    assert time_scope("and on Sunday", SAID)[0] == stamp(2026, 9, 13)
    assert time_scope("in October", SAID) == (stamp(2025, 10, 1), stamp(2025, 11, 1), "any")
    assert time_scope("on December 3", SAID)[0] == stamp(2025, 12, 3) and time_scope("next month", SAID) == (stamp(2026, 10, 1), stamp(2026, 11, 1), "happens")
    assert time_scope("from 2020 to the first week of May", SAID)[:2] == (stamp(2020, 1, 1), stamp(2026, 5, 8))
    assert time_scope("anything lately?", SAID) == (SAID - 7 * 86400, SAID, "any") and time_scope("why?", SAID) is None
    assert scope_bound("2025-01-01", SAID, end=True) == stamp(2025, 1, 2) and scope_bound("2025-01-01T10:00", SAID) == stamp(2025, 1, 1, 10)
    assert scope_bound("March", SAID, end=True) == stamp(2026, 4, 1) and scope_bound("", SAID) is None and scope_bound("soon", SAID) is None


def test_spans_of_tables(spark, rows):
    """As reading each text on its own; texts that are left out before hold no value."""
    rng = random.Random(8)
    parts = ["next Tuesday", "5 km", "hello there", "€5", "in May", "a few hours", "x@y.example", "today", "`x`", "/a/b", "it is", "50%", "tonight", "no date"]
    data = [(i, " ".join(rng.choices(parts, k=rng.randrange(4))), SAID if i % 5 else None, "extra") for i in range(200)] + [(900, None, SAID, "x"), (901, "", None, None), (902, "word " * 20_000 + "5 km", SAID, "x")]
    got = rows(spans_of(spark.createDataFrame(data, "id int, text string, said double, value string"), ["id"]))
    assert got == sorted(((i, *x) for i, t, s, _ in data if t for x in extract_spans(t, s)), key=str)
    assert spans_of(spark.createDataFrame([], "id int, text string, said double"), ["id"]).count() == 0
    times = spark.createDataFrame([(1.0, 2.0), (5.0, None), (None, None)], "a double, b double")
    assert times.where(overlaps(F.col("a"), F.col("b"), (1.5, 5.0))).count() == 1


def test_spans_do_not_overlap():
    rng = random.Random(2)
    words = ["next", "Tuesday", "2025-03-14", "$5", "at", "9:30", "two", "hours", "ago", "km", "12", "May", "2023", "a@b.example", "in"]
    for _ in range(300):
        spans = extract_spans(" ".join(rng.choices(words, k=12)), SAID)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert all(s[4] is None or s[4] < s[5] for s in spans)
    assert extract_spans("", SAID) == [] and extract_spans("tomorrow", None) == []


def test_bm25_against_brute_force(spark):
    docs = [(1, "the red fox"), (2, "red red dog"), (3, None), (4, ""), (5, "a fox and a dog and a fox"), (6, "nothing here")]
    got = {r.item: r.bm25 for r in bm25(spark.createDataFrame(docs, "id int, text string"), "Fox, dog!").collect()}
    words = {i: (t or "").lower().split() for i, t in docs}
    mean = sum(map(len, words.values())) / len(docs)
    for i, w in words.items():
        score = 0.0
        for term in ("fox", "dog"):
            df = sum(term in x for x in words.values())
            idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
            tf = w.count(term)
            score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        assert (i in got) == (score > 0) and abs(got.get(i, 0) - score) < 1e-9
    assert query_terms("The THE a") == [] and bm25(spark.createDataFrame(docs, "id int, text string"), "the").count() == 0


def test_terms_of_any_language(spark):
    docs = [(1, "Zürich im Café"), (2, "ZURICH"), (3, "Größe 10"), (4, "Привет мир")]
    df = spark.createDataFrame(docs, "id int, text string")
    assert {r.item for r in bm25(df, "Zürich").collect()} == {1, 2} and {r.item for r in bm25(df, "cafe").collect()} == {1}
    assert {r.item for r in bm25(df, "große привет").collect()} == {3, 4}


def test_fusion(spark, rows):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "item string, sim double")
    k = spark.createDataFrame([("b", 4.0), ("c", 2.0)], "item string, bm25 double")
    assert rows(fused(v, k), "item", F.round("score", 6)) == [("a", 0.9), ("b", 0.55), ("c", 0.025)]


def test_communities(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 0.1), ("x", "y", 1.0), ("q", "q", 3.0), (None, "a", 1.0)]
    got = {r.node: r.community for r in communities(spark.createDataFrame(edges, "a string, b string, weight double")).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"] == got["e"] == got["f"] and got["x"] == got["y"] == -1 and "q" not in got
    assert communities(spark.createDataFrame([], "a string, b string, weight double")).count() == 0


def test_corrections_and_undo(spark, rows):
    base = spark.createDataFrame([("1", "Rowan", 0), ("2", "guest", 0)], "id string, speaker string, dropped int")
    ops = [(1, "relabel", "1", "speaker", "Ada", None), (2, "relabel", "1", "speaker", "Eve", None), (3, "drop", "2", "dropped", "1", None), (4, "undo", None, None, None, 2), (5, "undo", None, None, None, 3), (6, "undo", None, None, None, 5)]
    df = spark.createDataFrame(ops, OPERATIONS)
    assert [r[0] for r in rows(standing(df), "op")] == [1, 3]
    assert rows(corrected(base, df, "id", ["speaker", "dropped"])) == [("1", "Ada", 0), ("2", "guest", 1)]
    assert rows(corrected(base, df.where("false"), "id", ["speaker"])) == rows(base)
