import random

from palimpsest.llm import truncation
from palimpsest.llm.truncation import _words, longer_copies, truncated

DOCS = "doc_id bigint, text string, source string, key string, stem string, cut int"


def test_longer_copies_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = {"".join(rng.choices("ab", k=rng.randrange(1, 9))) for _ in range(150)}
    texts |= {("word " * 40)[: rng.randrange(1, 200)] + rng.choice(["", "x", "y"]) for _ in range(120)}
    for least in (1, 8):
        monkeypatch.setattr(truncation, "PREFIX", least)
        df = spark.createDataFrame([(t,) for t in sorted(texts)], "stem string").selectExpr("stem", "substring(sha2(stem, 256), 1, 24) as key")
        stem_of = {r.key: r.stem for r in df.collect()}
        got = {(stem_of[r.key], r.follows) for r in longer_copies(df).collect()}
        assert got == {(t, x[len(t) : len(t) + 40]) for t in texts for x in texts if len(t) >= least and x != t and x.startswith(t)}
    assert longer_copies(df.where("false")).count() == 0


def test_words_and_what_follows():
    assert _words("One, two 33. Then e.g. four and\nfive (six)") == [("one", "N"), ("two", "M"), ("0", "E"), ("then", "M"), ("e", "N"), ("g", "N"), ("four", "N"), ("and", "E"), ("five", "N"), ("six", "N")]
    assert _words("") == [] and _words("a b")[-1] == ("b", "F")
    long = "Start. " + "word " * 900 + "end of it"
    assert truncation._last_words(long)[-3:] == _words(long)[-3:] and len(truncation._last_words(long)) >= 900


def sentence(rng):
    return f"The {rng.choice('red blue old new'.split())} {rng.choice('lamp boat table clock'.split())} was {rng.choice('sold moved repaired painted'.split())} in {rng.choice('Rome Oslo Bern Lima'.split())}."


def test_cuts(spark, rows):
    rng = random.Random(9)
    whole = [" ".join(sentence(rng) for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    docs = [(i, t, "notes", "k", "s", 0) for i, t in enumerate(whole)]
    docs += [(1000 + i, t.rstrip("."), "notes", "k", "s", 0) for i, t in enumerate(whole[:20])]  # no full stop, but the end
    docs += [(2000, whole[0][:-12], "Notes ", "k", "s", 0), (2001, whole[0][:-12], "notes", "k", "s", 0), (2002, "The old lamp was repaired in Rome. The new boat was mo", "notes", "k", "s", 0), (2003, "The red clock was sold in Bern. The blue table was sold in", None, "k", "s", 0)]
    docs += [(3000, None, "notes", "k", "s", 0), (3001, "", "notes", "k", "s", 0), (3002, "A b. " * 20_000, "notes", "k", "s", 0)]
    long = [" ".join(sentence(rng) for _ in range(20))[:500] for _ in range(30)]
    docs += [(4000 + i, t, "fields", "k", "s", 0) for i, t in enumerate(long)]
    got = {r.doc_id: r.cut for r in truncated(spark.createDataFrame(docs, DOCS)).collect()}
    assert all(got[i] for i in (2000, 2001, 2002, 2003)) and all(got[4000 + i] for i in range(30))
    evidence = {r.doc_id: r.evidence for r in truncated(spark.createDataFrame(docs, DOCS)).collect()}
    assert evidence[2000] == evidence[2001] == "longer copy" and evidence[2003] == "words go on" and evidence[0] is None
    assert [i for i in got if got[i] and i not in (2000, 2001, 2002, 2003) and i < 4000] == []


def test_without_the_join_nothing_is_found(spark, monkeypatch):
    """Cut inside a sentence that nobody else has, a text is told by its longer copy alone."""
    rng = random.Random(3)
    docs = [(i, f"Entry {i} {rng.random()}: zq{rng.randrange(10**6)} xv{rng.randrange(10**6)} jk{rng.randrange(10**6)} was seen here.", "s", "k", "s", 0) for i in range(60)]
    docs += [(100 + i, docs[i][1][:-11], "s", "k", "s", 0) for i in range(5)]
    df = spark.createDataFrame(docs, DOCS)
    assert {r.doc_id for r in truncated(df).where("evidence = 'longer copy'").collect()} == set(range(100, 105))
    real = truncation.longer_copies
    monkeypatch.setattr(truncation, "longer_copies", lambda stems: real(stems).where("false"))
    assert truncated(df).where("evidence = 'longer copy'").count() == 0


def test_empty(spark):
    assert truncated(spark.createDataFrame([], DOCS)).count() == 0
