"""Queries on facts, the graph between entities, and tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import norm_entity
from palimpsest.functions.words import AGENT
from palimpsest.operators.graph import communities
from palimpsest.operators.segments import carry_last, carry_next, ranked, running_sum
from palimpsest.plans.base import SQL_A, SQL_F, SQL_W, WEEK, clean_actions, clean_facts, clean_windows, session_lines
from palimpsest.plans.texts import _NORM, _STATUS_SQL, action_status
from palimpsest.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_LIVE = ["active", "unconfirmed"]
# What makes a statement unusable, in the order it is tested.
_PLACEHOLDER = r"(?i)^\s*(\[?implicit\]?|unknown|unspecified|n/?a|none|null|-|\?)\s*$"
_ASKS = r"(?i)\b(wants? to know|asks?|asked|asking|wonders?|wondering|inquir\w*|is curious|request\w*|wants? (?:me|you|the assistant|" + AGENT + r") to|told (?:me|you) to)\b"


@query(f"""WITH {SQL_F} SELECT CASE WHEN coalesce(subject, '') = '' OR coalesce(relation, '') = '' OR coalesce(object, '') = '' THEN 'empty'
  WHEN regexp_matches(object, '{_PLACEHOLDER}') OR regexp_matches(subject, '{_PLACEHOLDER}') THEN 'placeholder'
  WHEN contains(lower(relation), lower(object)) THEN 'object inside relation' WHEN regexp_matches(relation, '{_ASKS}') THEN 'question, not a fact'
  WHEN regexp_matches(trim(relation), '.\\b[A-Z][A-Za-z]+|\\d') THEN 'entity inside relation' ELSE 'valid' END AS verdict, count(*) AS facts FROM f GROUP BY 1""")
def fact_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = reduce(lambda a, b: a | b, (F.coalesce(c, F.lit("")) == "" for c in ("subject", "relation", "object")))
    verdict = (
        F.when(blank, "empty")
        .when(F.col("object").rlike(_PLACEHOLDER) | F.col("subject").rlike(_PLACEHOLDER), "placeholder")
        .when(F.contains(F.lower("relation"), F.lower("object")), "object inside relation")
        .when(F.col("relation").rlike(_ASKS), "question, not a fact")
        .when(F.trim("relation").rlike(r".\b[A-Z][A-Za-z]+|\d"), "entity inside relation")
        .otherwise("valid")
    )
    return clean_facts(spark, sf_dir).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("facts"))


_MENTIONS_SQL = f"""{SQL_F}, e AS (SELECT id, subject_norm AS entity, subject AS name, status FROM f UNION ALL SELECT id, {_NORM.format('object')}, object, status FROM f),
m AS (SELECT DISTINCT id, entity, name, status FROM e WHERE coalesce(entity, '') <> '')"""


def mentions(facts: DataFrame) -> DataFrame:
    """Entities of facts as subject or object, each once a fact and spelling: id, entity, name, status."""
    both = facts.select("id", F.col("subject_norm").alias("entity"), F.col("subject").alias("name"), "status")
    both = both.union(facts.select("id", norm_entity(F.col("object")), "object", "status"))
    return both.where(F.coalesce("entity", F.lit("")) != "").distinct()


@query(f"""WITH {_MENTIONS_SQL} SELECT entity, min(name) AS name, count(DISTINCT name) AS spellings, count(DISTINCT id) FILTER (status IN ('active', 'unconfirmed')) AS live_facts
FROM m WHERE length(name) <= 60 AND regexp_matches(name, '[A-Z]') GROUP BY 1""")
def entity_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities named by the facts, with the count of live facts that touch them."""
    named = mentions(clean_facts(spark, sf_dir)).where((F.length("name") <= 60) & F.col("name").rlike("[A-Z]"))
    live = F.when(F.col("status").isin(_LIVE), F.col("id"))
    return named.groupBy("entity").agg(F.min("name").alias("name"), F.countDistinct("name").alias("spellings"), F.countDistinct(live).alias("live_facts"))


@query(f"""WITH {_MENTIONS_SQL}, d AS (SELECT entity, count(DISTINCT id) AS live FROM m WHERE status IN ('active', 'unconfirmed') GROUP BY 1)
SELECT e.id, e.fact_count AS stored, coalesce(d.live, 0) AS counted FROM entities e LEFT JOIN d ON d.entity = e.id WHERE e.fact_count IS DISTINCT FROM coalesce(d.live, 0)""")
def stale_fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = mentions(clean_facts(spark, sf_dir)).where(F.col("status").isin(_LIVE)).groupBy(F.col("entity").alias("id")).agg(F.countDistinct("id").alias("live"))
    stored = table(spark, sf_dir, "entities").select("id", F.col("fact_count").alias("stored"))
    counted = F.coalesce("live", F.lit(0))
    return stored.join(live, "id", "left").where(~F.col("stored").eqNullSafe(counted)).select("id", "stored", counted.alias("counted"))


@query(f"""WITH {SQL_F}, c AS (SELECT id, subject_norm, relation_norm, {_NORM.format('object')} AS value, valid_from FROM f
  WHERE valid_from IS NOT NULL AND subject_norm IS NOT NULL AND relation_norm IS NOT NULL AND coalesce(modality, '') NOT IN ('planned', 'negated') AND coalesce(status, '') <> 'retracted'),
n AS (SELECT *, lead(valid_from) OVER w AS next_from, lead(id) OVER w AS next_id, lead(value) OVER w AS next_value FROM c WINDOW w AS (PARTITION BY subject_norm, relation_norm ORDER BY valid_from, id))
SELECT id AS old_id, next_id AS new_id, valid_from, next_from AS valid_to FROM n WHERE next_value IS NOT NULL AND next_value <> value""")
def superseded_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements followed by one of another value about the same attribute, and the one that follows."""
    kept = clean_facts(spark, sf_dir).where(
        F.col("valid_from").isNotNull() & F.col("subject_norm").isNotNull() & F.col("relation_norm").isNotNull()
        & ~F.coalesce("modality", F.lit("")).isin("planned", "negated") & (F.coalesce("status", F.lit("")) != "retracted")
    )
    rows = kept.select("id", "subject_norm", "relation_norm", "valid_from", norm_entity(F.col("object")).alias("value"))
    keys = ["subject_norm", "relation_norm"]
    rows = rows.withColumns({"block": F.floor(F.col("valid_from") / WEEK), "at": F.struct("valid_from", "id")})
    rows = carry_last(rows, keys, "block", "at", F.struct("id", "value", "valid_from"), "old")
    changed = rows.where(F.col("old.value") != F.col("value"))
    return changed.select(F.col("old.id").alias("old_id"), F.col("id").alias("new_id"), F.col("old.valid_from").alias("valid_from"), F.col("valid_from").alias("valid_to"))


@query(f"""WITH {SQL_F}, n AS (SELECT max(created_at) AS now FROM f) SELECT id, h_end FROM f, n WHERE modality = 'planned' AND status = 'active' AND h_end IS NOT NULL AND h_end < now""")
def expired_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = clean_facts(spark, sf_dir)
    now = facts.agg(F.max("created_at").alias("now"))  # one row
    return facts.where("modality = 'planned' and status = 'active'").join(F.broadcast(now)).where("h_end < now").select("id", "h_end")


@query(f"""WITH {SQL_F}, n AS (SELECT max(h_start) - 7 * 86400 AS now FROM f) SELECT subject, relation, object, h_start FROM f, n WHERE status = 'active' AND h_start BETWEEN now AND now + 7 * 86400""")
def upcoming_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = clean_facts(spark, sf_dir)
    now = facts.agg((F.max("h_start") - 7 * 86400).alias("now"))  # one row
    return facts.where("status = 'active'").join(F.broadcast(now)).where("h_start between now and now + 604800").select("subject", "relation", "object", "h_start")


@query(f"""WITH {SQL_F}, p AS (SELECT id, h_start, coalesce(h_end, h_start) AS h_end FROM f WHERE h_start IS NOT NULL),
k AS (SELECT id, unnest(range(CAST(floor(h_start / {WEEK}) AS BIGINT), CAST(floor(greatest(h_end, h_start) / {WEEK}) AS BIGINT) + 1)) AS week FROM p)
SELECT week, count(*) AS facts FROM k GROUP BY 1""")
def plans_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose time overlaps each week; a fact goes to the weeks it touches, so the join is one on equal weeks."""
    rows = clean_facts(spark, sf_dir).where("h_start is not null")
    end = F.greatest(F.coalesce("h_end", "h_start"), "h_start")
    weeks = F.sequence(F.floor(F.col("h_start") / WEEK), F.floor(end / WEEK))
    return rows.select("id", F.explode(weeks).alias("week")).groupBy("week").agg(F.count(F.lit(1)).alias("facts"))


@query(f"""WITH {SQL_F}, {SQL_W}, j AS (SELECT f.relation_norm, w.session_id FROM f JOIN fact_sources s ON s.fact_id = f.id JOIN w ON w.id = s.window_id),
i AS (SELECT relation_norm, count(*) AS instances, count(DISTINCT session_id) AS sessions FROM j GROUP BY 1),
u AS (SELECT relation_norm, subject_norm, count(*) FILTER (status = 'superseded') AS gone, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) >= 2),
x AS (SELECT relation_norm, sum(gone) / greatest(1, sum(n - 1)) AS share FROM u GROUP BY 1)
SELECT i.relation_norm, instances, sessions, instances >= 5 AND sessions >= 2 AS canonical, instances >= 5 AND sessions >= 2 AND coalesce(share, 0) >= 0.5 AS exclusive FROM i LEFT JOIN x USING (relation_norm)""")
def relation_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances and sessions of each relation, whether they make it canonical, and whether newer values replaced older ones."""
    facts = clean_facts(spark, sf_dir)
    sources = table(spark, sf_dir, "fact_sources").select(F.col("fact_id").alias("id"), "window_id")
    sessions = clean_windows(spark, sf_dir).select(F.col("id").alias("window_id"), "session_id")
    per = facts.select("id", "relation_norm").join(sources, "id").join(sessions, "window_id").groupBy("relation_norm", "session_id").agg(F.count(F.lit(1)).alias("n"))
    seen = per.groupBy("relation_norm").agg(F.sum("n").alias("instances"), F.count("session_id").alias("sessions"))
    multi = facts.groupBy("relation_norm", "subject_norm").agg(F.count_if(F.col("status") == "superseded").alias("gone"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    learned = multi.groupBy("relation_norm").agg((F.sum("gone") / F.greatest(F.lit(1), F.sum(F.col("n") - 1))).alias("share"))
    canonical = (F.col("instances") >= 5) & (F.col("sessions") >= 2)
    return seen.join(learned, "relation_norm", "left").select("relation_norm", "instances", "sessions", canonical.alias("canonical"), (canonical & (F.coalesce("share", F.lit(0)) >= 0.5)).alias("exclusive"))


@query(f"""WITH {_MENTIONS_SQL}, t AS (SELECT DISTINCT entity, id FROM m),
g AS (SELECT entity, f.relation_norm, f.status, count(*) AS n, max(f.valid_from) AS latest FROM t JOIN f USING (id) GROUP BY 1, 2, 3)
SELECT entity, sum(n) AS facts, coalesce(sum(n) FILTER (status IN ('active', 'unconfirmed')), 0) AS current_facts, coalesce(sum(n) FILTER (status = 'superseded'), 0) AS history, count(DISTINCT relation_norm) AS relations, max(latest) AS latest
FROM g GROUP BY 1 HAVING sum(n) >= 3""")
def entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = clean_facts(spark, sf_dir)
    touched = mentions(facts).select("entity", "id").distinct().join(facts.select("id", "relation_norm", "status", "valid_from"), "id")
    parts = touched.groupBy("entity", "relation_norm", "status").agg(F.count(F.lit(1)).alias("n"), F.max("valid_from").alias("latest"))
    pages = parts.groupBy("entity").agg(
        F.sum("n").alias("facts"),
        F.coalesce(F.sum(F.when(F.col("status").isin(_LIVE), F.col("n"))), F.lit(0)).alias("current_facts"),
        F.coalesce(F.sum(F.when(F.col("status") == "superseded", F.col("n"))), F.lit(0)).alias("history"),
        F.countDistinct("relation_norm").alias("relations"), F.max("latest").alias("latest"),
    )
    return pages.where("facts >= 3")


@query(f"""WITH {SQL_F}, {SQL_W}, s AS (SELECT s.fact_id, arg_min(w.text, (coalesce(w.said, 0), w.id)) FILTER (w.text IS NOT NULL) AS first_text, count(*) AS sources FROM fact_sources s JOIN w ON w.id = s.window_id GROUP BY 1)
SELECT f.id, f.subject || ' ' || f.relation || ' ' || f.object || coalesce(' — ' || left(s.first_text, 160), '') AS index_text, coalesce(s.sources, 0) AS sources FROM f LEFT JOIN s ON s.fact_id = f.id
WHERE f.subject IS NOT NULL AND f.relation IS NOT NULL AND f.object IS NOT NULL""")
def fact_index_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = clean_facts(spark, sf_dir).where("subject is not null and relation is not null and object is not null")
    texts = clean_windows(spark, sf_dir).select(F.col("id").alias("window_id"), "said", "text")
    at = F.when(F.col("text").isNotNull(), F.struct(F.coalesce("said", F.lit(0.0)), "window_id"))
    first = table(spark, sf_dir, "fact_sources").join(texts, "window_id").groupBy(F.col("fact_id").alias("id")).agg(F.min_by("text", at).alias("first_text"), F.count(F.lit(1)).alias("sources"))
    shown = F.concat_ws(" — ", F.concat_ws(" ", "subject", "relation", "object"), F.substring("first_text", 1, 160))
    return facts.join(first, "id", "left").select("id", shown.alias("index_text"), F.coalesce("sources", F.lit(0)).alias("sources"))


@query(f"""WITH {SQL_F}, {SQL_W}, s AS (SELECT s.window_id, f.subject || ' ' || f.relation || ' ' || f.object || ' → ' || coalesce(n.object, '?') AS note FROM fact_sources s JOIN f ON f.id = s.fact_id LEFT JOIN f n ON n.id = f.superseded_by WHERE f.status = 'superseded')
SELECT w.id, count(DISTINCT note) AS changes, min(note) AS first_note FROM w JOIN s ON s.window_id = w.id GROUP BY 1""")
def changed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that stated something since superseded, with what it changed to."""
    facts = clean_facts(spark, sf_dir)
    new = facts.select(F.col("id").alias("superseded_by"), F.col("object").alias("new_object"))
    gone = facts.where("status = 'superseded'").select(F.col("id").alias("fact_id"), "subject", "relation", "object", "superseded_by").join(new, "superseded_by", "left")
    note = F.concat(F.concat(F.col("subject"), F.lit(" "), F.col("relation"), F.lit(" "), F.col("object")), F.lit(" → "), F.coalesce("new_object", F.lit("?")))
    notes = gone.withColumn("note", note).join(table(spark, sf_dir, "fact_sources"), "fact_id").select(F.col("window_id").alias("id"), "note")
    return notes.join(clean_windows(spark, sf_dir).select("id"), "id", "left_semi").groupBy("id").agg(F.countDistinct("note").alias("changes"), F.min("note").alias("first_note"))


@query(f"WITH {SQL_F} SELECT f.id, f.relation_norm FROM f WHERE NOT EXISTS (SELECT 1 FROM fact_sources s JOIN windows w ON w.id = s.window_id WHERE s.fact_id = f.id)")
def facts_without_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "fact_sources").join(clean_windows(spark, sf_dir).select(F.col("id").alias("window_id")), "window_id", "left_semi")
    return clean_facts(spark, sf_dir).join(known.select(F.col("fact_id").alias("id")), "id", "left_anti").select("id", "relation_norm")


@query(f"""WITH {SQL_F} SELECT id, subject, relation, object, coalesce(h_start, valid_from) AS at FROM f WHERE status = 'active' AND (subject ILIKE '%an%' OR object ILIKE '%an%') AND relation ILIKE '%work%' AND coalesce(h_start, valid_from) >= 1740000000""")
def fact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.coalesce("h_start", "valid_from")
    kept = clean_facts(spark, sf_dir).where((F.col("status") == "active") & (F.col("subject").ilike("%an%") | F.col("object").ilike("%an%")) & F.col("relation").ilike("%work%") & (at >= 1740000000))
    return kept.select("id", "subject", "relation", "object", at.alias("at"))


@query(f"""WITH {SQL_F} SELECT subject_norm, strftime(make_timestamp(CAST(valid_from AS BIGINT) * 1000000), '%Y-%m') AS month, count(*) AS facts, count(DISTINCT relation_norm) AS relations, min(valid_from) AS first_from, max(valid_from) AS last_from
FROM f WHERE valid_from IS NOT NULL AND subject_norm IS NOT NULL GROUP BY 1, 2""")
def entity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_facts(spark, sf_dir).where("valid_from is not null and subject_norm is not null")
    month = F.date_format(F.timestamp_seconds("valid_from"), "yyyy-MM")
    return rows.groupBy("subject_norm", month.alias("month")).agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("relation_norm").alias("relations"), F.min("valid_from").alias("first_from"), F.max("valid_from").alias("last_from"))


@query(f"""WITH {SQL_F}, {SQL_W}, r AS (SELECT s.fact_id, s.window_id, row_number() OVER (PARTITION BY s.fact_id ORDER BY w.said NULLS LAST, s.window_id) AS rn, w.text FROM fact_sources s JOIN w ON w.id = s.window_id)
SELECT fact_id, window_id, left(text, 120) AS shown FROM r WHERE rn <= 3""")
def fact_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three earliest sources of each fact; only three are kept of any fact, before and after the shuffle."""
    texts = clean_windows(spark, sf_dir).select(F.col("id").alias("window_id"), "said", F.substring("text", 1, 120).alias("shown"))
    rows = table(spark, sf_dir, "fact_sources").join(texts, "window_id")
    rank = F.row_number().over(Window.partitionBy("fact_id").orderBy(F.asc_nulls_last("said"), "window_id"))
    return rows.withColumn("rn", rank).where("rn <= 3").select("fact_id", "window_id", "shown")


USER = "rowan"
_SEEDS_SQL = f"""{_MENTIONS_SQL}, t AS (SELECT DISTINCT entity, id FROM m WHERE status IN ('active', 'unconfirmed')),
d AS (SELECT entity, count(*) AS degree FROM t GROUP BY 1), s AS (SELECT entity, degree FROM d WHERE entity <> '{USER}' AND entity IN (SELECT id FROM entities) ORDER BY degree DESC, entity LIMIT 6)"""


@query(f"""WITH {_SEEDS_SQL}, h AS (SELECT s.entity, s.degree, f.id, f.valid_from, f.subject_norm, {_NORM.format('f.object')} AS object_norm FROM s JOIN t USING (entity) JOIN f USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY valid_from DESC NULLS LAST, id) AS rn FROM h)
SELECT entity, id, CASE WHEN subject_norm = entity THEN object_norm ELSE subject_norm END AS reached, round(0.8 * least(1.0, sqrt(4.0 / degree)), 6) AS score FROM r WHERE rn <= 3""")
def graph_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the six best connected entities to what their three newest facts name, damped for hubs."""
    facts = clean_facts(spark, sf_dir)
    touched = mentions(facts).where(F.col("status").isin(_LIVE)).select("entity", "id").distinct()
    degree = touched.groupBy("entity").agg(F.count(F.lit(1)).alias("degree"))
    known = table(spark, sf_dir, "entities").select(F.col("id").alias("entity"))
    seeds = degree.where(F.col("entity") != USER).join(known, "entity", "left_semi").orderBy(F.desc("degree"), "entity").limit(6)
    edges = touched.join(F.broadcast(seeds), "entity").join(facts.select("id", "valid_from", "subject_norm", norm_entity(F.col("object")).alias("object_norm")), "id")
    newest = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc_nulls_last("valid_from"), "id"))
    damped = 0.8 * F.least(F.lit(1.0), F.sqrt(F.lit(4.0) / F.col("degree")))
    reached = F.when(F.col("subject_norm") == F.col("entity"), F.col("object_norm")).otherwise(F.col("subject_norm"))
    return edges.withColumn("rn", newest).where("rn <= 3").select("entity", "id", reached.alias("reached"), F.round(damped, 6).alias("score"))


_EDGES_SQL = f"""{SQL_F}, p AS (SELECT least(subject_norm, {_NORM.format('object')}) AS a, greatest(subject_norm, {_NORM.format('object')}) AS b FROM f WHERE status IN ('active', 'unconfirmed')),
g AS (SELECT a, b, count(*) AS facts FROM p WHERE a <> b AND a <> '' AND b IN (SELECT id FROM entities) AND a IN (SELECT id FROM entities) GROUP BY 1, 2),
deg AS (SELECT e, sum(facts) AS degree FROM (SELECT a AS e, facts FROM g UNION ALL SELECT b, facts FROM g) GROUP BY 1)"""


def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities joined by live facts: a < b, facts."""
    known = table(spark, sf_dir, "entities").select("id")
    rows = clean_facts(spark, sf_dir).where(F.col("status").isin(_LIVE)).select(F.col("subject_norm").alias("s"), norm_entity(F.col("object")).alias("o"))
    pairs = rows.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).where("s is not null and o is not null and a <> b and a <> ''")
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("facts"))
    return counted.join(known.select(F.col("id").alias("a")), "a", "left_semi").join(known.select(F.col("id").alias("b")), "b", "left_semi")


@query(f"""WITH {_EDGES_SQL} SELECT g.a, g.b, facts, round(facts * least(1.0, 1.0 / sqrt(greatest(x.degree, y.degree) / 4.0)), 6) AS weight FROM g JOIN deg x ON x.e = g.a JOIN deg y ON y.e = g.b""")
def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between entities, weaker where one of them is a hub."""
    edges = entity_edges(spark, sf_dir)
    degree = edges.select(F.col("a").alias("e"), "facts").union(edges.select("b", "facts")).groupBy("e").agg(F.sum("facts").alias("degree"))
    both = edges.join(degree.select(F.col("e").alias("a"), F.col("degree").alias("da")), "a").join(degree.select(F.col("e").alias("b"), F.col("degree").alias("db")), "b")
    damped = F.least(F.lit(1.0), 1.0 / F.sqrt(F.greatest("da", "db") / 4.0))
    return both.select("a", "b", "facts", F.round(F.col("facts") * damped, 6).alias("weight"))


@query()
def entity_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of entities by weighted label propagation; small ones are -1."""
    return communities(weighted_edges(spark, sf_dir))


@query(f"""WITH {SQL_F}, s AS (SELECT DISTINCT s.window_id, f.subject_norm AS e FROM fact_sources s JOIN f ON f.id = s.fact_id WHERE f.subject_norm IS NOT NULL)
SELECT x.e AS a, y.e AS b, count(*) AS windows FROM s x JOIN s y ON x.window_id = y.window_id AND x.e < y.e GROUP BY 1, 2""")
def comentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of facts from one window. A window is a few sentences, so it names few of them."""
    facts = clean_facts(spark, sf_dir).where("subject_norm is not null").select(F.col("id").alias("fact_id"), F.col("subject_norm").alias("e"))
    seen = table(spark, sf_dir, "fact_sources").join(facts, "fact_id").select("window_id", "e").distinct()
    pairs = seen.select("window_id", F.col("e").alias("a")).join(seen.select("window_id", F.col("e").alias("b")), "window_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("windows"))


@query(f"""WITH {SQL_W}, l AS (SELECT * FROM w WHERE stream = 'conversation' AND said IS NOT NULL AND session_id IS NOT NULL)
SELECT id, lag(id) OVER o AS before_id, lead(id) OVER o AS after_id FROM l WINDOW o AS (PARTITION BY session_id ORDER BY said, id)""")
def adjacent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = session_lines(spark, sf_dir).select("id", "session_id", "block", "said").withColumn("at", F.struct("said", "id"))
    before = carry_last(lines, ["session_id"], "block", "at", F.col("id"), "before_id")
    after = before.select(F.col("before_id").alias("id"), F.col("id").alias("after_id")).where("id is not null")
    return before.select("id", "before_id").join(after, "id", "left")


@query(f"""WITH {SQL_W}, l AS (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY said, id) AS n FROM w WHERE stream = 'conversation' AND said IS NOT NULL AND session_id IS NOT NULL)
SELECT session_id, CAST(floor((n - 1) / 40) AS BIGINT) AS batch, count(*) AS lines, min(n) AS first_line FROM l GROUP BY 1, 2""")
def context_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each session in batches of 40."""
    lines = ranked(session_lines(spark, sf_dir).select("id", "session_id", "block", "said"), ["session_id"], "block", ["said", "id"], "n")
    return lines.groupBy("session_id", F.floor((F.col("n") - 1) / 40).alias("batch")).agg(F.count(F.lit(1)).alias("lines"), F.min("n").alias("first_line"))


#: Flags of windows that no statement may be drawn from.
_SKIP = ["echo", "dropped", "code", "assistant", "action", "thought", "event", "caption"]


@query(f"""WITH {SQL_W}, c AS (SELECT DISTINCT ref FROM chunks WHERE headroom = 'novel'), f2 AS (SELECT id, string_split(coalesce(flags, ''), ' ') AS fl, stream, ref FROM w),
e AS (SELECT id, stream FROM f2 WHERE NOT list_has_any(fl, {_SKIP}) AND (NOT list_contains(fl, 'external') OR ref IN (SELECT ref FROM c)))
SELECT stream, count(*) AS eligible, count(*) FILTER (id NOT IN (SELECT window_id FROM fact_sources WHERE window_id IS NOT NULL)) AS untouched FROM e GROUP BY 1""")
def relation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that statements may be drawn from, and those that none has been."""
    flags = F.split(F.coalesce("flags", F.lit("")), " ")
    novel = table(spark, sf_dir, "chunks").where("headroom = 'novel'").select("ref", F.lit(True).alias("novel")).distinct()
    used = table(spark, sf_dir, "fact_sources").select(F.col("window_id").alias("id"), F.lit(True).alias("used")).distinct()
    rows = clean_windows(spark, sf_dir).where(~F.arrays_overlap(flags, F.array(*map(F.lit, _SKIP)))).join(novel, "ref", "left").join(used, "id", "left")
    rows = rows.where(~F.array_contains(flags, "external") | F.coalesce("novel", F.lit(False)))
    return rows.groupBy("stream").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("used").isNull()).alias("untouched"))


_STEPS_SQL = f"""{SQL_A}, o AS (SELECT *, CASE WHEN request_ref IS DISTINCT FROM lag(request_ref) OVER s OR row_number() OVER s = 1 THEN 1 ELSE 0 END AS fresh FROM a
  WHERE session_id IS NOT NULL AND said IS NOT NULL WINDOW s AS (PARTITION BY session_id ORDER BY said, coalesce(seq, 0), id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY said, coalesce(seq, 0), id ROWS UNBOUNDED PRECEDING) AS island FROM o)"""


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool steps of each session with the number of their run of one request."""
    steps = clean_actions(spark, sf_dir).where("session_id is not null and said is not null").withColumns({"block": F.floor(F.col("said") / WEEK), "seq": F.coalesce("seq", F.lit(0))})
    steps = steps.withColumn("at", F.struct("said", "seq", "id"))
    steps = carry_last(steps, ["session_id"], "block", "at", F.struct("request_ref"), "before")
    fresh = (F.col("before").isNull() | ~F.col("before.request_ref").eqNullSafe(F.col("request_ref"))).cast("bigint")
    return running_sum(steps, ["session_id"], "block", ["said", "seq", "id"], fresh, "island").drop("before", "at")


@query(f"""WITH {_STEPS_SQL} SELECT session_id, island, min(request_ref) AS request_ref, count(*) AS steps, min(said) AS first_said, max(said) AS last_said, count(*) FILTER (error = 1) AS failed,
  CASE WHEN count(*) FILTER (error = 1) = 0 THEN 'done' WHEN arg_max(coalesce(error, 0), (said, coalesce(seq, 0), id)) = 0 THEN 'done after errors' ELSE 'failed' END AS outcome FROM i GROUP BY 1, 2""")
def task_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of steps for one request, and how they ended."""
    runs = islands(spark, sf_dir).groupBy("session_id", "island").agg(
        F.min("request_ref").alias("request_ref"), F.count(F.lit(1)).alias("steps"), F.min("said").alias("first_said"), F.max("said").alias("last_said"),
        F.count_if(F.col("error") == 1).alias("failed"), F.max_by(F.coalesce("error", F.lit(0)), F.struct("said", "seq", "id")).alias("last_error"),
    )
    outcome = F.when(F.col("failed") == 0, "done").when(F.col("last_error") == 0, "done after errors").otherwise("failed")
    return runs.withColumn("outcome", outcome).drop("last_error")


@query(f"""WITH {_STEPS_SQL}, {SQL_W}, t AS (SELECT session_id, island, max(said) AS last_said FROM i GROUP BY 1, 2),
r AS (SELECT session_id, id, said, ref FROM w WHERE stream = 'conversation' AND list_contains(string_split(coalesce(flags, ''), ' '), 'assistant') AND said IS NOT NULL)
SELECT t.session_id, t.island, arg_min(r.ref, (r.said, r.id)) AS reply_ref, min(r.said) - t.last_said AS wait FROM t JOIN r ON r.session_id = t.session_id AND r.said >= t.last_said GROUP BY t.session_id, t.island, t.last_said""")
def first_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of the assistant after each run of steps: runs and lines in one order, the next line carried back."""
    runs = islands(spark, sf_dir).groupBy("session_id", "island").agg(F.max("said").alias("said"))
    own = session_lines(spark, sf_dir).where(F.array_contains(F.split(F.coalesce("flags", F.lit("")), " "), "assistant"))
    none = F.lit(None)
    rows = own.select("session_id", "said", F.lit(1).alias("line"), F.col("id").alias("tie"), "ref", none.cast("bigint").alias("island"))
    rows = rows.union(runs.select("session_id", "said", F.lit(0), F.col("island").cast("string"), none.cast("string"), "island"))
    rows = rows.withColumn("block", F.floor(F.col("said") / WEEK)).withColumn("at", F.struct("said", "line", "tie"))
    number = ranked(rows, ["session_id"], "block", ["at"], "n")
    found = carry_next(number, ["session_id"], "block", "n", F.when(F.col("line") == 1, F.struct("ref", "said")), "reply")
    kept = found.where("line = 0 and reply is not null")
    return kept.select("session_id", "island", F.col("reply.ref").alias("reply_ref"), (F.col("reply.said") - F.col("said")).alias("wait"))


@query(f"""WITH {_STEPS_SQL}, l AS (SELECT session_id, island, id, said, seq, length(tool) + length(coalesce(args, '')) + 8 AS size, row_number() OVER (PARTITION BY session_id, island ORDER BY said, coalesce(seq, 0), id) AS n FROM i WHERE tool IS NOT NULL),
c AS (SELECT *, sum(CASE WHEN n > 2 THEN size ELSE 0 END) OVER (PARTITION BY session_id, island ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS back, sum(CASE WHEN n <= 2 THEN size ELSE 0 END) OVER (PARTITION BY session_id, island) AS head FROM l)
SELECT session_id, island, count(*) AS steps, count(*) FILTER (n <= 2 OR back + head <= 400) AS shown FROM c GROUP BY 1, 2""")
def clipped_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many steps of each run fit in 400 characters: the first two, then as many of the last as go in."""
    rows = islands(spark, sf_dir).where("tool is not null").withColumn("size", F.length("tool") + F.length(F.coalesce("args", F.lit(""))) + 8)
    keys = ["session_id", "island"]
    rows = ranked(rows, keys, "block", ["said", "seq", "id"], "n").withColumns({"turned": -F.col("block"), "back_n": -F.col("n")})
    rows = running_sum(rows, keys, "turned", ["back_n"], F.when(F.col("n") > 2, F.col("size")).otherwise(0), "back")
    head = rows.where("n <= 2").groupBy(*keys).agg(F.sum("size").alias("head"))
    fits = (F.col("n") <= 2) | (F.col("back") + F.col("head") <= 400)
    return rows.join(head, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), F.count_if(fits).alias("shown"))


@query(f"""WITH {SQL_A} SELECT tool, {_STATUS_SQL} AS status, count(*) AS steps, round(avg(result_chars), 3) AS mean_chars FROM a GROUP BY 1, 2""")
def tool_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_actions(spark, sf_dir).groupBy("tool", action_status().alias("status")).agg(F.count(F.lit(1)).alias("steps"), F.round(F.avg("result_chars"), 3).alias("mean_chars"))


@query(f"""WITH {SQL_A}, r AS (SELECT task_id, request_ref, session_id FROM a WHERE task_id IS NOT NULL),
l AS (SELECT task_id, 'request' AS kind, request_ref AS target FROM r UNION SELECT task_id, 'session', session_id FROM r)
SELECT kind, count(*) AS links, count(DISTINCT task_id) AS tasks, count(DISTINCT target) AS targets FROM l WHERE target IS NOT NULL GROUP BY 1""")
def task_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_actions(spark, sf_dir).where("task_id is not null")
    both = rows.select("task_id", F.explode(F.create_map(F.lit("request"), "request_ref", F.lit("session"), "session_id")).alias("kind", "target")).where("target is not null").distinct()
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("task_id").alias("tasks"), F.countDistinct("target").alias("targets"))


def role_of(entity: Column) -> Column:
    return F.when(entity == USER, "user").when(entity == "tessel", "agent").otherwise("thing")


@query(f"""WITH {_MENTIONS_SQL} SELECT CASE WHEN entity = '{USER}' THEN 'user' WHEN entity = 'tessel' THEN 'agent' ELSE 'thing' END AS role, count(DISTINCT entity) AS entities, count(DISTINCT id) AS facts FROM m GROUP BY 1""")
def entity_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions(clean_facts(spark, sf_dir)).select(role_of(F.col("entity")).alias("role"), "entity", "id")
    facts = rows.select("role", "id").distinct().groupBy("role").agg(F.count(F.lit(1)).alias("facts"))
    return rows.select("role", "entity").distinct().groupBy("role").agg(F.count(F.lit(1)).alias("entities")).join(facts, "role")


@query(f"""WITH {SQL_W} SELECT ref, string_agg(text, ' ' ORDER BY id) AS thought, min(said) AS said FROM w WHERE stream = 'thought' GROUP BY 1""")
def thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_windows(spark, sf_dir).where("stream = 'thought'")
    ordered = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("id", "text"))))
    return rows.groupBy("ref").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("thought"), F.min("said").alias("said"))


@query(f"""WITH {SQL_W} SELECT ref, min(said) AS said, count(*) AS windows FROM w WHERE stream = 'conversation' AND NOT list_contains(string_split(coalesce(flags, ''), ' '), 'assistant') GROUP BY 1""")
def user_message_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_windows(spark, sf_dir).where("stream = 'conversation'").where(~F.array_contains(F.split(F.coalesce("flags", F.lit("")), " "), "assistant"))
    return rows.groupBy("ref").agg(F.min("said").alias("said"), F.count(F.lit(1)).alias("windows"))
