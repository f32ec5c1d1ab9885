"""Recall: one ranking of windows by meaning, words and circumstances, and what they are connected with."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import words
from palimpsest.functions.text import norm_entity, seconds
from palimpsest.operators.search import B, IDF_FLOOR, K1, query_terms, similar_to, terms_of
from palimpsest.operators.spans import overlaps, spans_of
from palimpsest.session import cut, small

LIVE = ("active", "unconfirmed")
HIDDEN = ("echo", "dropped", "ungrounded")


@dataclass(frozen=True)
class Weights:
    """What a circumstance adds to or takes from the similarity, and the bounds of the search."""

    lexical: float = 0.05
    typed: float = 0.02
    in_scope: float = 0.05
    recent: float = 0.01
    assistant: float = 0.06
    advice: float = 0.06
    question: float = 0.04
    floor: float = 0.5
    pool: int = 3
    steps: int = 3
    seeds: int = 10
    entities: int = 6
    fanout: int = 3
    newest: int = 50
    hub: float = 8.0
    decay: float = 0.9


def graded(column: Column | str) -> Column:
    """A score as it is ranked: rounded, so that engines agree on ties."""
    return F.round(column, 6)


def _times(term: str) -> Column:
    return F.size(F.filter("_words", lambda word: word == term))


def window_features(windows: DataFrame, terms: list[str], live_session: str | None = None) -> DataFrame:
    """One row per window id with what scoring needs, read once and without the text: id, said, length, tf_0 ... and flags.

    Texts are reduced to numbers before rows of one id are merged, so no text is moved.
    """
    flags = F.split(F.coalesce("flags", F.lit("")), " ")
    has = lambda *names: F.arrays_overlap(flags, F.array(*map(F.lit, names)))
    found = terms_of(F.col("text"))
    live = (F.col("session_id") == F.lit(live_session)) & ~has("compacted") if live_session else F.lit(False)
    asked = F.rtrim("text").endswith("?") & (F.length("text") < 240)
    marks = {"own": has("assistant"), "hidden": has(*HIDDEN), "thought": has("thought"), "action": has("action"), "continuity": has("continuity"), "live": live, "question": asked}
    rows = windows.withColumn("_words", found)
    counts = {f"tf_{n}": _times(term) for n, term in enumerate(terms)}
    rows = rows.select("id", seconds(F.col("said")).alias("said"), F.size("_words").alias("length"), *(c.alias(n) for n, c in counts.items()), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in marks.items()))
    merged = rows.groupBy("id").agg(F.min("said").alias("said"), F.max("length").alias("length"), *(F.max(n).alias(n) for n in (*counts, *marks)))
    return cut(merged)


def with_bm25(features: DataFrame, terms: list[str]) -> DataFrame:
    """Features with ``bm25``, 0 where no term occurs; corpus statistics are one row."""
    counts = [f"tf_{n}" for n in range(len(terms))]
    stats = features.agg(F.count(F.lit(1)).alias("_n"), F.avg("length").alias("_mean"), *(F.count_if(F.col(c) > 0).alias(f"_{c}") for c in counts))
    total: Column = F.lit(0.0)
    for c in counts:
        idf = F.log((F.col("_n") - F.col(f"_{c}") + 0.5) / (F.col(f"_{c}") + 0.5))
        idf = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
        total = total + idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("length") / F.col("_mean")))
    scored = features.join(F.broadcast(stats)).withColumn("bm25", graded(total))
    return scored.drop("_n", "_mean", *counts, *(f"_{c}" for c in counts))


def best(rows: DataFrame, score: str, k: int, key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(score), key).limit(k)


def candidates(windows: DataFrame, vectors: DataFrame, query: str, query_vector: DataFrame, last_night: DataFrame, k: int = 20, weights: Weights | None = None,
               scope: tuple[float, float, str] | None = None, live_session: str | None = None, thoughts: bool = True, scaffolding: bool = False) -> DataFrame:
    """Windows for a question: id, sim, score, own, action; at most six times ``k`` before the facts join in.

    ``vectors``: item, vec, norm of windows, each once; ``query_vector``: one row of vec, norm; ``last_night``: one row of
    last_night. The pool is the best by similarity and the best by words. A time scope or a type that the question asks
    for lifts a window and hides none. Hidden rows, those of the live session and, unless asked for, scaffolding are
    left out, as are pool rows without a vector and those below the floor that hold no word. An empty query gives no words.
    """
    w, terms = weights or Weights(), query_terms(query)
    asks_agent = bool(re.search(words.ASKS_AGENT, query))
    asks_advice = bool(re.search(words.ASKS_ADVICE, query)) and not asks_agent
    hint = next((kind for kind, pattern in words.HINTS.items() if re.search(pattern, query)), None)
    rows = with_bm25(window_features(windows, terms, live_session), terms).join(F.broadcast(last_night))
    kept = F.lit(True) if scaffolding else ~F.col("continuity") & ~(F.col("action") & F.coalesce(F.col("said") <= F.col("last_night"), F.lit(True)))
    rows = rows.withColumn("kept", kept)
    near = similar_to(vectors, query_vector).select(F.col("item").alias("id"), graded("sim").alias("sim"))
    rows = rows.where("kept or bm25 > 0").join(near, "id", "left").where("sim is not null or bm25 > 0")
    rows = cut(rows)  # without the text and the vectors
    lexical = small(best(rows.where("bm25 > 0").select("id", "bm25"), "bm25", w.pool * k))
    like = best(rows.where("kept and sim is not null").select("id", "sim"), "sim", w.pool * k).select("id")
    pool = rows.where("kept and sim is not null").join(F.broadcast(like.union(lexical.select("id")).distinct()), "id", "left_semi")
    pool = small(pool.join(F.broadcast(lexical.select("id", F.lit(True).alias("by_words"))), "id", "left"))  # at most 2 * w.pool * k rows
    top = lexical.agg(F.max("bm25").alias("top"))
    pool = pool.join(F.broadcast(top)).withColumns({"typed": F.lit(False), "in_scope": F.lit(False)})
    if hint or scope:
        texts = windows.join(F.broadcast(pool.select("id")), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"), F.min(seconds(F.col("said"))).alias("said"))
        spans = spans_of(texts, ["id"])
        typed = F.col("type") == (hint or "")
        within = (F.col("type") == "time") & overlaps(F.col("t_start"), F.col("t_end"), scope[:2]) if scope else F.lit(False)
        told = spans.groupBy("id").agg(F.max(typed).alias("has_type"), F.max(within).alias("speaks"))
        pool = pool.join(told, "id", "left").withColumn("typed", F.coalesce("has_type", F.lit(False)))
        if scope:
            said_in = (F.col("said") >= scope[0]) & (F.col("said") < scope[1]) & F.lit(scope[2] == "any")
            pool = pool.withColumn("in_scope", F.coalesce(said_in, F.lit(False)) | F.coalesce("speaks", F.lit(False)))
        pool = pool.drop("has_type", "speaks")
    pool = pool.where(~F.col("hidden") & ~F.col("live") & (F.lit(thoughts) | ~F.col("thought")) & ((F.col("sim") >= w.floor) | F.coalesce("by_words", F.lit(False))))
    add = lambda mark, x: F.when(F.coalesce(mark, F.lit(False)), x).otherwise(0.0)
    score = F.col("sim") + add(F.col("by_words"), w.lexical * F.col("bm25") / F.col("top")) + add(F.col("typed"), w.typed) + add(F.col("in_scope"), w.in_scope)
    score = score + add(F.col("said") > F.col("last_night"), w.recent)
    if not asks_agent:
        score = score - add(F.col("own"), w.assistant + w.advice * asks_advice)
    if not asks_advice:
        score = score - add(F.col("question"), w.question)
    return pool.select("id", "sim", graded(score).alias("score"), "own", "action", "hidden", "live")


def sourced(facts_scored: DataFrame, sources: DataFrame, items: DataFrame) -> DataFrame:
    """The window that a fact is a key of: fact_id, score, id; one that is among ``items`` already, else its first source."""
    has = items.select(F.col("id").alias("window_id"), F.lit(0).alias("there"))
    rows = facts_scored.join(sources, "fact_id").join(F.broadcast(has), "window_id", "left")
    chosen = F.min(F.struct(F.coalesce("there", F.lit(1)).alias("rank"), "window_id")).alias("c")
    return rows.groupBy("fact_id").agg(F.max("score").alias("score"), chosen).select("fact_id", "score", F.col("c.window_id").alias("id"))


def attached(items: DataFrame, keys: DataFrame, flags: DataFrame, via: str) -> DataFrame:
    """``items`` (id, sim, score, via, action) raised by facts that are keys of their windows, and the windows that join in.

    ``keys``: fact_id, score, id; ``flags``: id, hidden, action of all windows. Hidden windows don't join.
    """
    lifted = keys.groupBy("id").agg(F.max("score").alias("by_fact"))
    both = items.join(lifted, "id", "full")
    new = both.where("score is null").select("id").join(flags, "id").where("not hidden").select("id", F.col("action").alias("_action"))
    both = both.join(F.broadcast(new), "id", "left").where("score is not null or _action is not null")
    more = F.col("score").isNull() | (F.col("by_fact") > F.col("score"))
    return both.select(
        "id", F.greatest("sim", "by_fact").alias("sim"), F.greatest("score", "by_fact").alias("score"),
        F.when(more & F.col("by_fact").isNotNull(), F.lit(via)).otherwise(F.col("via")).alias("via"), F.coalesce("action", "_action").alias("action"),
    )


def ranked_items(items: DataFrame, k: int, steps: int) -> DataFrame:
    """The best ``k`` items, of tool steps only the best few."""
    acts = best(items.where("action"), "score", steps)
    return best(items.where("not action").unionByName(acts), "score", k)


def touching(facts: DataFrame) -> DataFrame:
    """Live facts by the entities they touch: entity, fact_id, valid_from, s, o."""
    rows = facts.where(F.col("status").isin(*LIVE)).select(F.col("id").alias("fact_id"), "valid_from", F.col("subject_norm").alias("s"), norm_entity(F.col("object")).alias("o"))
    ends = F.explode(F.array_distinct(F.array("s", "o"))).alias("entity")
    return rows.select(ends, "fact_id", "valid_from", "s", "o").where("entity is not null and entity <> ''")


def hop(touched: DataFrame, frontier: DataFrame, entities: DataFrame, similar: DataFrame, skip: list[str], w: Weights) -> tuple[DataFrame, DataFrame]:
    """One step of the walk: the facts reached (fact_id, score) and the entities behind them (entity, weight).

    ``frontier``: entity, weight, a few rows; ``entities``: entity, degree; ``similar``: fact_id, sim. Of an entity's newest
    facts the most similar count; the path fades, and more at hubs. The next frontier is the best known entities.
    """
    near = touched.join(F.broadcast(frontier.join(entities, "entity")), "entity").join(similar, "fact_id", "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    newest = "row_number() over (partition by entity order by valid_from desc nulls last, fact_id)"
    closest = "row_number() over (partition by entity order by sim desc, fact_id)"
    near = near.withColumn("rn", F.expr(newest)).where(F.col("rn") <= w.newest).withColumn("rn", F.expr(closest)).where(F.col("rn") <= w.fanout)
    damp = F.least(F.lit(1.0), F.sqrt(w.hub / F.greatest("degree", F.lit(1))))
    near = small(near.select("fact_id", "entity", "s", "o", graded(F.greatest("sim", F.col("weight") * w.decay * damp)).alias("score")))  # w.fanout facts of each entity
    reached = near.groupBy("fact_id").agg(F.max("score").alias("score"))
    others = near.select(F.explode(F.array("s", "o")).alias("next"), "entity", "score").where("next is not null and next <> entity and next <> ''").where(~F.col("next").isin(*skip))
    onward = others.groupBy(F.col("next").alias("entity")).agg(F.max("score").alias("weight")).join(entities.select("entity"), "entity", "left_semi")
    return reached, best(onward, "weight", w.entities, "entity")
