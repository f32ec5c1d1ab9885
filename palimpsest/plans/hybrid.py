"""Queries on the whole recall: fused ranking, facts as keys, and the walk through what matched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import words
from palimpsest.functions.text import norm_entity
from palimpsest.operators.recall import HIDDEN, LIVE, Weights, attached, best, candidates, graded, hop, ranked_items, sourced, touching
from palimpsest.operators.search import latest_vectors, similar_to
from palimpsest.operators.spans import time_scope
from palimpsest.plans.base import SQL_F, SQL_W, clean_facts
from palimpsest.plans.texts import _BM25_SQL, _LAST_SQL, _NORM, SEARCH
from palimpsest.session import cut, small
from palimpsest.sources.tables import table

MODEL, K, W = "emb-s64", 20, Weights()
USER = "rowan"
#: Entities that a walk never starts from or goes to.
SKIP = [USER, words.AGENT.lower(), "i", "me", "user", "assistant"]


def last_night(windows: DataFrame) -> DataFrame:
    """One row: the start of the latest night, in epoch seconds."""
    return windows.agg(F.unix_timestamp(F.try_to_date(F.substring(F.max("night_id"), 7, 10)).cast("timestamp")).cast("double").alias("last_night"))


def _vectors(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = table(spark, sf_dir, "vectors").where((F.col("kind") == kind) & (F.col("model") == MODEL))
    return latest_vectors(rows).select("rid", F.col("item_id").alias("item"), "vec", "norm")


def matched(spark: SparkSession, sf_dir: str, query: str = SEARCH, now: float | None = None, live_session: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items of a question before they are cut off (id, sim, score, via, action), similarities of facts, and the facts that
    were keys of them. The vector of the question is that of the first window."""
    windows, facts, sources = table(spark, sf_dir, "windows"), table(spark, sf_dir, "facts"), table(spark, sf_dir, "fact_sources")
    vectors = _vectors(spark, sf_dir, "window")
    asked = small(vectors.orderBy("rid").limit(1).select("vec", "norm"))
    scope = time_scope(query, now) if now is not None else None
    items = candidates(windows, vectors, query, asked, last_night(windows), K, W, scope, live_session)
    items = small(items.select("id", "sim", "score", F.lit("match").alias("via"), "action"))
    similar = cut(similar_to(_vectors(spark, sf_dir, "fact"), asked).select(F.col("item").alias("fact_id"), graded("sim").alias("sim")))
    hits = best(similar.where(F.col("sim") >= W.floor), "sim", K, "fact_id")
    live = hits.join(facts.where(F.col("status").isin(*LIVE)).select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    keys = small(sourced(live.withColumnRenamed("sim", "score"), sources, items))
    return small(attached(items, keys, _flags(windows, keys), "fact")), similar, keys


def _flags(windows: DataFrame, keys: DataFrame) -> DataFrame:
    """Marks of the windows that ``keys``, a few rows, name: id, hidden, action."""
    flags = F.split(F.coalesce("flags", F.lit("")), " ")
    named = windows.join(F.broadcast(keys.select("id").distinct()), "id", "left_semi")
    return named.groupBy("id").agg(F.max(F.arrays_overlap(flags, F.array(*map(F.lit, HIDDEN)))).alias("hidden"), F.max(F.array_contains(flags, "action")).alias("action"))


def hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best windows for a question: similarity, words, type, time, recency and penalties in one score, facts as keys."""
    items, _, _ = matched(spark, sf_dir)
    return ranked_items(items, K, W.steps).select("id", "score", "via")


def scoped_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As hybrid_recall for a question that names a time and asks for one, on a day of the tables."""
    items, _, _ = matched(spark, sf_dir, "when did we check the locker last month, and what did you recommend?", 1771970454.0)
    return ranked_items(items, K, W.steps).select("id", "score", "via")


def _lines(spark: SparkSession, sf_dir: str, seeds: DataFrame) -> DataFrame:
    """Timed lines of the sessions that the seeds, a few rows, are in: id, session_id, said, text, own, hidden."""
    windows = table(spark, sf_dir, "windows").where("session_id is not null and session_id <> ''")
    sessions = windows.join(F.broadcast(seeds.select("id")), "id", "left_semi").select("session_id").distinct()
    flags = F.split(F.coalesce("flags", F.lit("")), " ")
    rows = windows.join(F.broadcast(sessions), "session_id", "left_semi").groupBy("id").agg(
        F.min("session_id").alias("session_id"), F.min(F.when(F.abs("said") > 1e11, F.col("said") / 1000).otherwise(F.col("said"))).alias("said"), F.min("text").alias("text"),
        F.max(F.array_contains(flags, "assistant")).alias("own"), F.max(F.arrays_overlap(flags, F.array(*map(F.lit, HIDDEN)))).alias("hidden"), F.min("stream").alias("stream"),
    )
    return cut(rows.where("said is not null"))


def expanded_recall(spark: SparkSession, sf_dir: str, hops: int = 2) -> DataFrame:
    """What matched, and what two hops between entities, the lines beside it and answers or corrections add: id, score, via.

    Seeds are the best ten items. Entities are those of the facts that are keys of them and the names in their texts; each
    hop takes a few facts of a few entities, so every step joins a handful of rows with a table.
    """
    items, similar, keys = matched(spark, sf_dir)
    windows, facts, sources = table(spark, sf_dir, "windows"), clean_facts(spark, sf_dir), table(spark, sf_dir, "fact_sources")
    seeds = small(best(items, "score", W.seeds).select("id", "sim", "score"))
    touched = cut(touching(facts))
    known = table(spark, sf_dir, "entities").select(F.col("id").alias("entity")).distinct()
    entities = cut(touched.groupBy("entity").agg(F.count(F.lit(1)).alias("degree")).join(known, "entity", "right").withColumn("degree", F.coalesce("degree", F.lit(0))))
    of_facts = touched.join(F.broadcast(keys.join(seeds.select("id", F.col("score").alias("weight")), "id").select("fact_id", "weight")), "fact_id").select("entity", "weight")
    texts = windows.join(F.broadcast(seeds.select("id", F.col("score").alias("weight"))), "id").groupBy("id", "weight").agg(F.min("text").alias("text"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\p{L}&&[^\x00-\x7F]]", "_")
    named = texts.select(F.explode(F.array_except(F.regexp_extract_all(plain, F.lit(words.NAMES), 0), F.array(*map(F.lit, words.NAME_STOP)))).alias("name"), "weight")
    weights = of_facts.union(named.select(norm_entity(F.col("name")), "weight")).where(~F.col("entity").isin(*SKIP)).groupBy("entity").agg(F.max("weight").alias("weight"))
    frontier = small(best(weights.join(entities.select("entity"), "entity", "left_semi"), "weight", W.entities, "entity"))
    reached = None
    for _ in range(hops):
        facts_reached, onward = hop(touched, frontier, entities, similar, SKIP, W)
        reached = facts_reached if reached is None else reached.union(facts_reached)
        frontier = small(onward)
    reached = reached.groupBy("fact_id").agg(F.max("score").alias("score"))
    found = small(sourced(reached, sources, items))
    items = small(attached(items, found, _flags(windows, found), "link"))

    lines = _lines(spark, sf_dir, seeds)
    pairs = lines.select("id", "session_id", "said", "hidden", "text", "own", "stream")
    at = pairs.join(F.broadcast(pairs.join(seeds, "id").select(F.col("id").alias("seed"), "session_id", F.col("said").alias("seed_said"), "score", "sim", F.col("text").alias("seed_text"), F.col("own").alias("seed_own"), F.col("stream").alias("seed_stream"))), "session_id")
    place = F.struct("said", "id", "hidden", "text", "own", "stream")
    beside = small(at.groupBy("seed", "score", "sim", "seed_text", "seed_own", "seed_stream").agg(F.max(F.when(F.col("said") < F.col("seed_said"), place)).alias("before"), F.min(F.when(F.col("said") > F.col("seed_said"), place)).alias("after")))
    faded = graded(F.col("score") * W.decay)
    near = beside.select(faded.alias("score"), "sim", F.explode(F.array("before", "after")).alias("x")).where("x.id is not null and not x.hidden").select(F.col("x.id").alias("id"), "sim", "score", F.lit("near").alias("via"))
    present = items.select("id", "sim", "score", "via", "action")
    more = near.groupBy("id").agg(F.max("sim").alias("sim"), F.max("score").alias("score"), F.min("via").alias("via")).join(present.select("id"), "id", "left_anti").join(_flags(windows, near), "id")
    whole = present.unionByName(more.select("id", "sim", "score", "via", "action"))
    return ranked_items(whole, 2 * K, W.steps).select("id", "score", "via")


_FL = "string_split(coalesce(flags, ''), ' ')"
_HID = f"list_has_any({_FL}, {list(HIDDEN)})"
_ACT = f"list_contains({_FL}, 'action')"
_MATCH = f"""{SQL_W}, {_BM25_SQL}, {_LAST_SQL}, {SQL_F},
ln AS (SELECT epoch(CAST(substr(max(night_id), 7, 10) AS TIMESTAMP)) AS night FROM windows),
q AS (SELECT vec AS qv FROM v WHERE kind = 'window' AND model = '{MODEL}' ORDER BY rid LIMIT 1),
ft AS (SELECT id, said, list_contains({_FL}, 'assistant') AS own, {_HID} AS hidden, {_ACT} AS action, coalesce(rtrim(text) LIKE '%?' AND length(text) < 240, false) AS question,
       NOT list_contains({_FL}, 'continuity') AND NOT ({_ACT} AND coalesce(said <= night, true)) AS kept, night FROM w, ln),
nr AS (SELECT item_id AS id, round(list_dot_product(vec, qv) / sqrt(list_dot_product(vec, vec)) / sqrt(list_dot_product(qv, qv)), 6) AS sim FROM v, q WHERE kind = 'window' AND model = '{MODEL}' AND len(vec) = len(qv)),
lx AS (SELECT id, round(bm25, 6) AS bm FROM b ORDER BY 2 DESC, 1 LIMIT {W.pool * K}), tp AS (SELECT max(round(bm25, 6)) AS top FROM b),
sc AS (SELECT ft.*, sim FROM nr JOIN ft USING (id) WHERE kept),
pl AS (SELECT id FROM (SELECT id FROM sc ORDER BY sim DESC, id LIMIT {W.pool * K}) UNION SELECT id FROM lx),
c0 AS (SELECT id, sim, action, round(sim + CASE WHEN bm IS NOT NULL THEN {W.lexical} * bm / top ELSE 0 END + CASE WHEN said > night THEN {W.recent} ELSE 0 END - CASE WHEN own THEN {W.assistant} ELSE 0 END
       - CASE WHEN question THEN {W.question} ELSE 0 END, 6) AS score FROM sc JOIN pl USING (id) LEFT JOIN lx USING (id), tp WHERE NOT hidden AND (sim >= {W.floor} OR bm IS NOT NULL)),
fs0 AS (SELECT item_id AS fact_id, round(list_dot_product(vec, qv) / sqrt(list_dot_product(vec, vec)) / sqrt(list_dot_product(qv, qv)), 6) AS sim FROM v, q WHERE kind = 'fact' AND model = '{MODEL}' AND len(vec) = len(qv)),
fh AS (SELECT * FROM fs0 WHERE sim >= {W.floor} ORDER BY sim DESC, fact_id LIMIT {K}),
k0 AS (SELECT fh.fact_id, fh.sim AS score, arg_min(s.window_id, (CASE WHEN c0.id IS NULL THEN 1 ELSE 0 END, s.window_id)) AS id FROM fh JOIN f ON f.id = fh.fact_id AND f.status IN {LIVE}
       JOIN fact_sources s ON s.fact_id = fh.fact_id LEFT JOIN c0 ON c0.id = s.window_id GROUP BY 1, 2),
l0 AS (SELECT id, max(score) AS by_fact FROM k0 GROUP BY 1),
i0 AS (SELECT id, greatest(sim, by_fact) AS sim, greatest(score, by_fact) AS score, CASE WHEN by_fact > score OR (by_fact IS NOT NULL AND score IS NULL) THEN 'fact' ELSE 'match' END AS via, coalesce(c0.action, ft.action) AS action
       FROM c0 FULL JOIN l0 USING (id) LEFT JOIN (SELECT id, action, hidden FROM ft) ft USING (id) WHERE score IS NOT NULL OR (ft.id IS NOT NULL AND NOT ft.hidden))"""


def _ranked(items: str, k: int) -> str:
    return f"""SELECT id, score, via FROM (SELECT * FROM {items} WHERE NOT action UNION ALL SELECT * FROM (SELECT * FROM {items} WHERE action ORDER BY score DESC, id LIMIT {W.steps})) ORDER BY score DESC, id LIMIT {k}"""


def _hop(n: int) -> str:
    """One step of the walk from frontier fr{n} as CTEs: near facts h{n}, next frontier fr{n + 1}."""
    return f"""
n{n} AS (SELECT t.*, fr.weight, en.degree, coalesce(fs0.sim, 0) AS sim, row_number() OVER (PARTITION BY t.entity ORDER BY valid_from DESC NULLS LAST, t.fact_id) AS rn FROM t JOIN fr{n} fr ON fr.entity = t.entity JOIN en ON en.entity = t.entity LEFT JOIN fs0 ON fs0.fact_id = t.fact_id),
h{n} AS (SELECT *, round(greatest(sim, weight * {W.decay} * least(1.0, sqrt({W.hub} / greatest(degree, 1)))), 6) AS score FROM n{n} WHERE rn <= {W.newest} QUALIFY row_number() OVER (PARTITION BY entity ORDER BY sim DESC, fact_id) <= {W.fanout}),
fr{n + 1} AS (SELECT x AS entity, max(score) AS weight FROM (SELECT unnest([s, o]) AS x, entity, score FROM h{n}) WHERE x IS NOT NULL AND x <> entity AND x <> '' AND x NOT IN {tuple(SKIP)} AND x IN (SELECT entity FROM en) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {W.entities})"""


_EXPANDED = rf"""{_MATCH},
sd AS (SELECT id, sim, score FROM i0 ORDER BY score DESC, id LIMIT {W.seeds}),
tf AS (SELECT id AS fact_id, valid_from, subject_norm AS s, {_NORM.format('object')} AS o FROM f WHERE status IN {LIVE}),
t AS (SELECT DISTINCT fact_id, valid_from, s, o, entity FROM (SELECT *, unnest([s, o]) AS entity FROM tf) WHERE entity IS NOT NULL AND entity <> ''),
en AS (SELECT e.id AS entity, coalesce(d.n, 0) AS degree FROM (SELECT DISTINCT id FROM entities) e LEFT JOIN (SELECT entity, count(*) AS n FROM t GROUP BY 1) d ON d.entity = e.id),
nm AS (SELECT unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\x00-\x7F\PL]', '_', 'g'), '{words.NAMES}')) AS name, score AS weight FROM w JOIN sd USING (id)),
wt AS (SELECT entity, max(weight) AS weight FROM (SELECT entity, sd.score AS weight FROM k0 JOIN sd USING (id) JOIN t USING (fact_id) UNION ALL SELECT {_NORM.format('name')}, weight FROM nm WHERE name NOT IN {tuple(words.NAME_STOP)})
       WHERE entity NOT IN {tuple(SKIP)} GROUP BY 1),
fr1 AS (SELECT * FROM wt WHERE entity IN (SELECT entity FROM en) ORDER BY weight DESC, entity LIMIT {W.entities}),{_hop(1)},{_hop(2)},
rc AS (SELECT fact_id, max(score) AS score FROM (SELECT fact_id, score FROM h1 UNION ALL SELECT fact_id, score FROM h2) GROUP BY 1),
k1 AS (SELECT rc.fact_id, rc.score, arg_min(s.window_id, (CASE WHEN i0.id IS NULL THEN 1 ELSE 0 END, s.window_id)) AS id FROM rc JOIN fact_sources s ON s.fact_id = rc.fact_id LEFT JOIN i0 ON i0.id = s.window_id GROUP BY 1, 2),
l1 AS (SELECT id, max(score) AS by_fact FROM k1 GROUP BY 1),
i1 AS (SELECT id, greatest(sim, by_fact) AS sim, greatest(score, by_fact) AS score, CASE WHEN by_fact > score OR (by_fact IS NOT NULL AND score IS NULL) THEN 'link' ELSE via END AS via, coalesce(i0.action, ft.action) AS action
       FROM i0 FULL JOIN l1 USING (id) LEFT JOIN (SELECT id, action, hidden FROM ft) ft USING (id) WHERE score IS NOT NULL OR (ft.id IS NOT NULL AND NOT ft.hidden)),
ls AS (SELECT id, session_id, said, {_HID} AS hidden FROM w WHERE session_id IS NOT NULL AND session_id <> '' AND said IS NOT NULL),
pr AS (SELECT a.id AS seed, sd.sim, round(sd.score * {W.decay}, 6) AS score, b.id, b.said, b.hidden, b.said < a.said AS before FROM sd JOIN ls a USING (id) JOIN ls b ON b.session_id = a.session_id AND b.said <> a.said),
bs AS (SELECT * FROM pr WHERE before QUALIFY row_number() OVER (PARTITION BY seed ORDER BY said DESC, id DESC) = 1 UNION ALL SELECT * FROM pr WHERE NOT before QUALIFY row_number() OVER (PARTITION BY seed ORDER BY said, id) = 1),
ad AS (SELECT id, max(sim) AS sim, max(score) AS score FROM bs WHERE NOT hidden AND id NOT IN (SELECT id FROM i1) GROUP BY 1),
i2 AS (SELECT * FROM i1 UNION ALL SELECT ad.id, ad.sim, ad.score, 'near', ft.action FROM ad JOIN ft ON ft.id = ad.id)"""

QUERIES = {"hybrid_recall": hybrid_recall, "expanded_recall": expanded_recall, "scoped_recall": scoped_recall}
SQL = {"hybrid_recall": f"WITH {_MATCH} {_ranked('i0', K)}", "expanded_recall": f"WITH {_EXPANDED} {_ranked('i2', 2 * K)}"}
