"""The fused ranking against a plain computation, and the walk over a small graph."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.recall import Weights, attached, candidates, hop, ranked_items, sourced, touching

NOW = dt.datetime(2026, 9, 20, 12, tzinfo=dt.UTC).timestamp()
WINDOWS = "id string, session_id string, said double, text string, flags string, stream string, item string, score double"
VECTORS = "item string, vec array<double>, norm double"


def unit(angle):
    return [math.cos(angle), math.sin(angle)]


ROWS = [
    ("a", "s1", NOW - 40 * 86400, "the greenhouse pump was fixed on 2026-09-19", "", 0.1),
    ("b", "s1", NOW - 86400, "the greenhouse pump is loud", "assistant", 0.2),
    ("c", "s2", NOW - 9e6, "is the pump old?", "", 0.3),
    ("d", "s2", NOW - 9e6, "echo of the pump", "assistant echo", 0.0),
    ("e", "live", NOW, "pump now", "", 0.0),
    ("f", "live", NOW, "pump before", "compacted", 0.4),
    ("g", "s3", NOW - 9e6, "nothing alike", "", 1.5),
    ("h", "s3", NOW - 9e6, "a pump step", "action", 0.1),
    ("i", "s3", NOW, "a new pump step", "action", 0.5),
    ("j", "s3", NOW - 9e6, "a kept thought on the pump", "thought", 0.2),
    ("k", "s3", NOW - 9e6, None, None, 0.2),
]


def run(spark, query, scope=None, **more):
    windows = spark.createDataFrame([(i, s, t * 1000 if i == "b" else t, x, f, "conversation", "clash", 9.0) for i, s, t, x, f, _ in ROWS for _ in range(1 + (i == "a"))], WINDOWS)
    vectors = spark.createDataFrame([(i, unit(angle), 1.0) for i, *_, angle in ROWS], VECTORS)
    asked = spark.createDataFrame([(unit(0.0), 1.0)], "vec array<double>, norm double")
    night = spark.createDataFrame([(NOW - 2 * 86400,)], "last_night double")
    return {r.id: r for r in candidates(windows, vectors, query, asked, night, scope=scope, **more).collect()}


def test_terms_of_the_score(spark):
    got = run(spark, "greenhouse pump", live_session="live")
    assert set(got) == {"a", "b", "c", "f", "i", "j", "k"}  # not hidden, live, unlike, or an old step
    w = Weights()
    top = max(("a", "b"), key=lambda x: got[x].score - got[x].sim + (w.assistant - w.recent) * (x == "b"))
    assert got[top].score == pytest.approx(got[top].sim + w.lexical + (w.recent - w.assistant) * (top == "b"), abs=2e-6)
    assert got["k"].score == pytest.approx(math.cos(0.2), abs=2e-6)
    assert got["i"].action and not got["a"].action
    assert set(run(spark, "greenhouse pump", thoughts=False)) == {"a", "b", "c", "e", "f", "i", "k"}
    assert "h" in run(spark, "greenhouse pump", scaffolding=True)


def test_what_a_question_asks_for(spark):
    plain, advice, agent = (run(spark, q) for q in ("the pump", "any tips for the pump", "what did you say, you told of the pump"))
    shift = lambda x, y, i: round(y[i].score - x[i].score, 3)
    lexical = {i: {n: r[i].score for n, r in enumerate((plain, advice, agent))} for i in plain}
    assert shift(plain, agent, "b") == pytest.approx(0.06, abs=0.02) and shift(plain, advice, "b") == pytest.approx(-0.06, abs=0.02), lexical
    assert shift(plain, advice, "c") == pytest.approx(0.04, abs=0.02)
    hinted = run(spark, "when the pump")
    assert shift(plain, hinted, "a") == pytest.approx(0.02, abs=1e-3) and shift(plain, hinted, "b") == 0
    scoped = run(spark, "the pump", (NOW - 2 * 86400, NOW - 43200, "any"))
    assert shift(plain, scoped, "a") == 0.05 and shift(plain, scoped, "b") == 0.05 and shift(plain, scoped, "c") == 0
    assert run(spark, "").keys() == {"a", "b", "c", "e", "f", "i", "j", "k"}


def test_facts_as_keys(spark, rows):
    items = spark.createDataFrame([("w1", 0.6, 0.7, "match", False), ("w2", 0.9, 0.9, "match", True)], "id string, sim double, score double, via string, action boolean")
    sources = spark.createDataFrame([("f1", "w0"), ("f1", "w1"), ("f2", "w3"), ("f3", "w4"), ("f4", "gone"), (None, None)], "fact_id string, window_id string")
    facts = spark.createDataFrame([("f1", 0.8), ("f2", 0.75), ("f3", 0.99), ("f4", 0.5)], "fact_id string, score double")
    keys = sourced(facts, sources, items)
    assert rows(keys, "fact_id", "id") == [("f1", "w1"), ("f2", "w3"), ("f3", "w4"), ("f4", "gone")]
    flags = spark.createDataFrame([("w1", False, False), ("w3", False, True), ("w4", True, False)], "id string, hidden boolean, action boolean")
    got = attached(items, keys, flags, "fact")
    assert rows(got, "id", "score", "via", "action") == [("w1", 0.8, "fact", False), ("w2", 0.9, "match", True), ("w3", 0.75, "fact", True)]
    assert rows(ranked_items(got, 9, 1), "id") == [("w1",), ("w2",)]
    assert attached(items.where("false"), keys.where("false"), flags, "x").count() == 0


def test_walk(spark, rows):
    facts = spark.createDataFrame(
        [("1", "ann", "Bob", "active", 3.0), ("2", "bob", "the Cellar", "active", 2.0), ("3", "ann", "Tea", "retracted", 1.0), ("4", "ann", None, "active", None), *((f"h{i}", "hub", f"x{i}", "active", float(i)) for i in range(40))],
        "id string, subject_norm string, object string, status string, valid_from double",
    )
    touched = touching(facts)
    degree = touched.groupBy("entity").agg(F.count(F.lit(1)).alias("degree"))
    similar = spark.createDataFrame([("2", 0.95), ("h7", 0.1)], "fact_id string, sim double")
    frontier = spark.createDataFrame([("ann", 0.8), ("hub", 0.8)], "entity string, weight double")
    reached, onward = hop(touched, frontier, degree, similar, ["user"], Weights())
    scores = dict(rows(reached))
    assert scores["1"] == 0.72 and scores["4"] == 0.72 and scores["h7"] == pytest.approx(0.8 * 0.9 * math.sqrt(8 / 40), abs=1e-6) and len(scores) == 5
    assert onward.first().entity == "bob" and onward.count() == 4
    again, _ = hop(touched, onward, degree, similar, ["user"], Weights())
    assert dict(rows(again))["2"] == 0.95
    assert hop(touched, frontier.where("false"), degree, similar, [], Weights())[0].count() == 0
