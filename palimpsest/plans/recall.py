"""Queries on recall, conversations' structure, repeated work and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import sha_id
from palimpsest.operators.journal import corrected, standing
from palimpsest.operators.search import bm25, latest_vectors, similar_to
from palimpsest.operators.segments import carry_last, exact_median, ranked, running_sum, value_at
from palimpsest.operators.windows import window_texts
from palimpsest.plans.base import SQL_A, SQL_F, SQL_W, WEEK, clean_actions, clean_facts, clean_windows, session_lines
from palimpsest.plans.ledger import _E, events, with_gaps
from palimpsest.plans.texts import _BM25_SQL, _LAST_SQL, SEARCH
from palimpsest.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, each content once, cut into windows under the name of their host."""
    pages = table(spark, sf_dir, "chunks").where("text is not null and ref is not null").groupBy("content_hash").agg(F.min(F.struct("ref", "url", "text")).alias("p")).select("p.*")
    host = F.lower(F.regexp_extract(F.coalesce("url", "ref"), "[a-zA-Z]+://([^/:?#]+)", 1))
    rows = pages.select("ref", F.concat(F.lit("source:"), host).alias("speaker"), F.posexplode(window_texts("text")).alias("position", "text"))
    return rows.withColumn("id", sha_id(F.col("ref"), F.col("position")))


@query(f"""WITH {SQL_W} SELECT CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'empty' WHEN regexp_matches(text, '(?i)^(ok|okay|yes|no|thanks|fine|sure|got it|tomorrow)\\b') AND length(text) < 40 THEN 'short answer'
  WHEN regexp_matches(text, '(?i)(started, queue|ended at|no reading since|battery of|motion near|temperature|door sensor)') THEN 'notice' WHEN text LIKE '%?' THEN 'question' ELSE 'statement' END AS kind, count(*) AS windows
FROM w WHERE stream = 'conversation' GROUP BY 1""")
def turn_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    kind = (
        F.when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(text.rlike(r"(?i)^(ok|okay|yes|no|thanks|fine|sure|got it|tomorrow)\b") & (F.length(text) < 40), "short answer")
        .when(text.rlike("(?i)(started, queue|ended at|no reading since|battery of|motion near|temperature|door sensor)"), "notice")
        .when(text.endswith("?"), "question")
        .otherwise("statement")
    )
    return clean_windows(spark, sf_dir).where("stream = 'conversation'").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("windows"))


@query(f"""WITH {SQL_W}, {_BM25_SQL}, j AS (SELECT s.fact_id, b.bm25, b.id FROM b JOIN fact_sources s ON s.window_id = b.id), {SQL_F}
SELECT f.id, round(max(bm25), 6) AS score, count(*) AS sources FROM f JOIN j ON j.fact_id = f.id GROUP BY 1""")
def facts_by_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose source windows match the search, with the best of their scores."""
    hits = bm25(clean_windows(spark, sf_dir), SEARCH).withColumnRenamed("item", "window_id")
    joined = hits.join(table(spark, sf_dir, "fact_sources"), "window_id").join(clean_facts(spark, sf_dir).select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    return joined.groupBy(F.col("fact_id").alias("id")).agg(F.round(F.max("bm25"), 6).alias("score"), F.count(F.lit(1)).alias("sources"))


@query(f"""WITH {_LAST_SQL}, {SQL_F}, fv AS (SELECT * FROM v WHERE kind = 'fact' AND model = 'emb-s64'), q AS (SELECT vec AS qv FROM fv ORDER BY rid LIMIT 1)
SELECT f.id, round(list_cosine_similarity(fv.vec, qv), 6) AS sim, f.status FROM fv JOIN f ON f.id = fv.item_id, q WHERE len(fv.vec) = len(qv) AND coalesce(f.status, '') <> 'retracted' ORDER BY 2 DESC, 1 LIMIT 40""")
def facts_by_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty facts nearest to the first fact's vector; retracted ones are left out before the cut."""
    vectors = latest_vectors(table(spark, sf_dir, "vectors")).where("kind = 'fact' and model = 'emb-s64'")
    kept = clean_facts(spark, sf_dir).where(F.coalesce("status", F.lit("")) != "retracted").select("id", "status")
    near = similar_to(vectors, vectors.orderBy("rid").limit(1)).select(F.col("item_id").alias("id"), F.round("sim", 6).alias("sim"))
    return near.join(kept, "id").orderBy(F.desc("sim"), "id").limit(40)


@query(f"""WITH {SQL_W}, s AS (SELECT id, session_id, length(text) AS size, row_number() OVER (PARTITION BY session_id ORDER BY length(text) DESC NULLS LAST, id) AS rn FROM w WHERE stream = 'action') SELECT session_id, count(*) AS kept, max(size) AS longest FROM s WHERE rn <= 3 GROUP BY 1""")
def best_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three step lines of each session, the longest; a window that only keeps three needs no whole group."""
    rows = clean_windows(spark, sf_dir).where("stream = 'action'").select("id", "session_id", F.length("text").alias("size"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc_nulls_last("size"), "id"))
    return rows.withColumn("rn", rank).where("rn <= 3").groupBy("session_id").agg(F.count(F.lit(1)).alias("kept"), F.max("size").alias("longest"))


@query(f"""WITH {SQL_W}, {_BM25_SQL}, t AS (SELECT w.id, round(bm25, 6) AS score, '- [' || coalesce(strftime(make_timestamp(CAST(floor(said) AS BIGINT) * 1000000), '%Y-%m-%d'), '?') || ' · ' || coalesce(speaker, '?') || '] ' || text AS line FROM b JOIN w USING (id) WHERE text IS NOT NULL ORDER BY round(bm25, 6) DESC, id LIMIT 60),
c AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM t) SELECT count(*) AS lines, sum(length(line)) AS chars, md5(string_agg(line, chr(10) ORDER BY score DESC, id)) AS digest FROM c WHERE used <= 2000""")
def rendered_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits as text within 2000 characters, up to the first that doesn't fit."""
    windows = clean_windows(spark, sf_dir).where("text is not null")
    hits = bm25(clean_windows(spark, sf_dir), SEARCH).select(F.col("item").alias("id"), F.round("bm25", 6).alias("score"))
    day = F.coalesce(F.date_format(F.timestamp_seconds(F.floor("said")), "yyyy-MM-dd"), F.lit("?"))
    line = F.concat(F.lit("- ["), day, F.lit(" · "), F.coalesce("speaker", F.lit("?")), F.lit("] "), F.col("text"))
    top = hits.join(windows, "id").select("id", "score", line.alias("line")).orderBy(F.desc("score"), "id").limit(60)
    used = top.withColumn("used", F.sum(F.length("line") + 1).over(Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0))).where("used <= 2000")  # at most 60 rows
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "line")))
    return used.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"), F.md5(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("digest"))


_OWN = "list_contains(string_split(coalesce(flags, ''), ' '), 'assistant')"


@query(f"""WITH {SQL_W}, l AS (SELECT *, lag(id) OVER o AS p_id, lag(text) OVER o AS p_text, lag({_OWN}) OVER o AS p_own FROM w WHERE stream = 'conversation' AND said IS NOT NULL AND session_id IS NOT NULL WINDOW o AS (PARTITION BY session_id ORDER BY said, id))
SELECT id AS src, p_id AS dst, 'answers' AS kind FROM l WHERE {_OWN} AND NOT p_own AND p_text LIKE '%?' UNION ALL SELECT id, p_id, 'corrects' FROM l WHERE NOT {_OWN} AND p_own AND regexp_matches(text, '(?i)^(no,|not |wrong|actually)')""")
def conversation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that answer or correct the line before."""
    own = F.array_contains(F.split(F.coalesce("flags", F.lit("")), " "), "assistant")
    lines = session_lines(spark, sf_dir).withColumns({"own": own, "at": F.struct("said", "id")})
    lines = carry_last(lines, ["session_id"], "block", "at", F.struct("id", "text", "own"), "before")
    answers = F.col("own") & ~F.col("before.own") & F.col("before.text").endswith("?")
    corrects = ~F.col("own") & F.col("before.own") & F.col("text").rlike("(?i)^(no,|not |wrong|actually)")
    return lines.withColumn("kind", F.when(answers, "answers").when(corrects, "corrects")).where("kind is not null").select(F.col("id").alias("src"), F.col("before.id").alias("dst"), "kind")


@query(f"""WITH {SQL_A}, s AS (SELECT tool, regexp_replace(coalesce(args, ''), '\\d+', '0', 'g') AS step, session_id, error FROM a WHERE tool IS NOT NULL)
SELECT tool, step, count(*) AS uses, count(DISTINCT session_id) AS sessions, count(*) FILTER (error = 1) AS failures FROM s GROUP BY 1, 2 HAVING count(DISTINCT session_id) >= 2""")
def repeated_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that several sessions took, numbers aside."""
    rows = clean_actions(spark, sf_dir).where("tool is not null").select("tool", F.regexp_replace(F.coalesce("args", F.lit("")), r"\d+", "0").alias("step"), "session_id", (F.col("error") == 1).alias("failed"))
    per = rows.groupBy("tool", "step", "session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("f"))
    return per.groupBy("tool", "step").agg(F.sum("n").alias("uses"), F.count("session_id").alias("sessions"), F.sum("f").alias("failures")).where("sessions >= 2")


@query(f"""WITH {SQL_A}, r AS (SELECT request_text, request_ref, min(said) AS first_said FROM a WHERE request_text IS NOT NULL AND request_ref IS NOT NULL AND said IS NOT NULL GROUP BY 1, 2)
SELECT request_ref, row_number() OVER (PARTITION BY request_text ORDER BY first_said, request_ref) AS attempt, lag(request_ref) OVER (PARTITION BY request_text ORDER BY first_said, request_ref) AS earlier FROM r""")
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that were made before in the same words: the number of the attempt and the one before."""
    rows = clean_actions(spark, sf_dir).where("request_text is not null and request_ref is not null and said is not null")
    rows = rows.groupBy(F.sha2("request_text", 256).alias("words"), "request_ref").agg(F.min("said").alias("said")).withColumns({"block": F.floor(F.col("said") / WEEK), "at": F.struct("said", "request_ref")})
    rows = ranked(rows, ["words"], "block", ["at"], "attempt")
    return carry_last(rows, ["words"], "block", "at", F.col("request_ref"), "earlier").select("request_ref", "attempt", "earlier")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE contains(text, '```')),
m AS (SELECT *, CASE WHEN starts_with(trim(line, ' '), '```') THEN 1 ELSE 0 END AS mark, coalesce(sum(CASE WHEN starts_with(trim(line, ' '), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS marks FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (mark = 0 AND marks % 2 = 0) AS prose, count(*) FILTER (mark = 0 AND marks % 2 = 1) AS code FROM m GROUP BY 1""")
def fenced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents outside and inside of fences: a scan from marker to marker within a document."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.trim(x).startswith("```").cast("int"))
    start = F.struct(F.lit(0).alias("marks"), F.lit(0).alias("prose"), F.lit(0).alias("code"))

    def step(acc, mark):
        inside = acc["marks"] % 2
        return F.struct(
            (acc["marks"] + mark).alias("marks"),
            (acc["prose"] + (1 - mark) * (1 - inside)).cast("int").alias("prose"),
            (acc["code"] + (1 - mark) * inside).cast("int").alias("code"),
        )

    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("```"))).withColumn("marks", lines)
    return docs.select("doc_id", F.size("marks").alias("lines"), F.aggregate("marks", start, step).alias("s")).select("doc_id", "lines", "s.prose", "s.code")


@query(f"""WITH {SQL_W}, c AS (SELECT id, CASE WHEN lower(trim(regexp_replace(speaker, '\\s*\\(.*\\)$', ''), ' ')) IN (SELECT lower(trim(label, ' ')) FROM speakers WHERE role = 'assistant') THEN 'Tessel' ELSE speaker END AS speaker FROM w WHERE stream = 'conversation')
SELECT coalesce(speaker, '?') AS speaker, count(*) AS windows FROM c GROUP BY 1""")
def corrected_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers after one relabelling of all spellings of the assistant, made as operations over the unchanged rows."""
    rows = clean_windows(spark, sf_dir).where("stream = 'conversation'").select("id", "speaker")
    labels = table(spark, sf_dir, "speakers").where("role = 'assistant'").select(F.lower(F.trim("label")).alias("spelling")).distinct()
    spelled = rows.withColumn("spelling", F.lower(F.trim(F.regexp_replace("speaker", r"\s*\(.*\)$", ""))))
    hit = spelled.join(F.broadcast(labels), "spelling", "left_semi")  # a fixed dozen of labels
    ops = hit.select(F.xxhash64("id").alias("op"), F.lit("relabel").alias("kind"), F.col("id").alias("key"), F.lit("speaker").alias("field"), F.lit("Tessel").alias("value"), F.lit(None).cast("bigint").alias("undoes"))
    return corrected(rows, ops, "id", ["speaker"]).groupBy(F.coalesce("speaker", F.lit("?")).alias("speaker")).agg(F.count(F.lit(1)).alias("windows"))


@query("""WITH o AS (SELECT event_id AS op, user_id, event_type, CASE WHEN event_type = 'error' THEN event_id - CAST(json_extract(props, '$.k') AS BIGINT) % 5 - 1 END AS undoes FROM events),
t AS (SELECT DISTINCT undoes AS op FROM o WHERE undoes IS NOT NULL), e AS (SELECT DISTINCT undoes AS op FROM o WHERE undoes IS NOT NULL AND op NOT IN (SELECT op FROM t))
SELECT event_type, count(*) AS standing, max(op) AS last_op FROM o WHERE undoes IS NULL AND op NOT IN (SELECT op FROM e) GROUP BY 1""")
def standing_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that hold after undoings, some of which were undone themselves."""
    rows = table(spark, sf_dir, "events")
    undoes = F.when(F.col("event_type") == "error", F.col("event_id") - F.get_json_object("props", "$.k").cast("bigint") % 5 - 1)
    ops = rows.select(F.col("event_id").alias("op"), "event_type", undoes.alias("undoes"))
    return standing(ops).groupBy("event_type").agg(F.count(F.lit(1)).alias("standing"), F.max("op").alias("last_op"))


@query(f"""WITH {_E}, g AS (SELECT event_type, t - lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) AS gap FROM e), s AS (SELECT event_type, gap, row_number() OVER (PARTITION BY event_type ORDER BY gap) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM g WHERE gap IS NOT NULL)
SELECT event_type, max(n) AS gaps, round(max(gap) FILTER (rn = n // 2 + 1), 3) AS upper_median FROM s GROUP BY 1""")
def outreach_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of the pauses between events of a kind."""
    rows = events(spark, sf_dir).withColumn("at", F.struct("t", "event_id"))
    gaps = carry_last(rows, ["event_type"], "block", "at", F.col("t"), "before").withColumn("gap", F.col("t") - F.col("before"))
    found = value_at(gaps, ["event_type"], "gap", 60.0, {"m": F.floor(F.col("n") / 2)})
    return found.select("event_type", F.col("n").alias("gaps"), F.round("m", 3).alias("upper_median"))


@query(f"""WITH {_E}, g AS (SELECT user_id, t, event_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e), v AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY t, event_id) AS k FROM v) SELECT user_id, run, max(k) AS turns, sum(least(60 * pow(2, least(k, 10) - 1), 3600)) AS waited FROM n GROUP BY 1, 2""")
def back_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds waited over each run of events when every further one doubles the pause, up to an hour: a sum by number."""
    gaps = with_gaps(events(spark, sf_dir))
    fresh = (F.col("gap").isNull() | (F.col("gap") >= 43200)).cast("bigint")
    runs = running_sum(gaps, ["user_id"], "block", ["t", "event_id"], fresh, "run").groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("turns"))
    few = F.least(F.col("turns"), F.lit(6))  # 60 * 2 ** 6 is over an hour
    return runs.select("user_id", "run", "turns", (60 * (F.pow(F.lit(2.0), few) - 1) + F.greatest(F.col("turns") - 6, F.lit(0)) * 3600).alias("waited"))


@query(f"""WITH {SQL_F}, {SQL_W}, s AS (SELECT f.night_id, count(DISTINCT f.id) AS facts, count(DISTINCT s.window_id) AS evidence FROM f LEFT JOIN fact_sources s ON s.fact_id = f.id GROUP BY 1)
SELECT night_id, facts, evidence, round(facts / greatest(evidence, 1), 6) AS facts_a_window FROM s WHERE night_id IS NOT NULL""")
def stage_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = clean_facts(spark, sf_dir).where("night_id is not null").select("night_id", F.col("id").alias("fact_id"))
    joined = facts.join(table(spark, sf_dir, "fact_sources"), "fact_id", "left")
    evidence = joined.select("night_id", "window_id").where("window_id is not null").distinct().groupBy("night_id").agg(F.count(F.lit(1)).alias("evidence"))
    counted = facts.groupBy("night_id").agg(F.count(F.lit(1)).alias("facts")).join(evidence, "night_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))
    return counted.withColumn("facts_a_window", F.round(F.col("facts") / F.greatest("evidence", F.lit(1)), 6))


@query(f"""WITH {SQL_W}, s AS (SELECT session_id, count(*) AS lines, max(said) - min(said) AS seconds FROM w WHERE stream = 'conversation' AND session_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS sessions, median(lines) AS median_lines, max(lines) AS most_lines, round(median(seconds), 3) AS median_seconds FROM s""")
def session_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = clean_windows(spark, sf_dir).where("stream = 'conversation' and session_id is not null")
    sizes = lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"), (F.max("said") - F.min("said")).alias("seconds")).withColumn("all", F.lit(1))
    by_lines = exact_median(sizes, ["all"], "lines", 50, "median_lines")
    by_time = exact_median(sizes, ["all"], "seconds", 600, "median_seconds").select("all", F.round("median_seconds", 3).alias("median_seconds"))
    most = sizes.groupBy("all").agg(F.count(F.lit(1)).alias("sessions"), F.max("lines").alias("most_lines"))
    return most.join(by_lines, "all").join(by_time, "all").select("sessions", "median_lines", "most_lines", "median_seconds")


@query(f"""WITH {SQL_F} SELECT e.id, e.name, count(f.id) AS facts FROM entities e LEFT JOIN f ON f.subject_norm = e.id WHERE e.name ILIKE '%ham%' OR e.aliases ILIKE '%ham%' GROUP BY 1, 2""")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "entities").where(F.col("name").ilike("%ham%") | F.col("aliases").ilike("%ham%")).select("id", "name")
    facts = clean_facts(spark, sf_dir).groupBy(F.col("subject_norm").alias("id")).agg(F.count(F.lit(1)).alias("facts"))
    return found.join(facts, "id", "left").select("id", "name", F.coalesce("facts", F.lit(0)).alias("facts"))


@query(f"""WITH {SQL_F} SELECT relation_norm, object, count(DISTINCT subject_norm) AS subjects FROM (SELECT relation_norm, subject_norm, lower(trim(coalesce(object, ''), ' ')) AS object FROM f) GROUP BY 1, 2 HAVING count(DISTINCT subject_norm) >= 3""")
def shared_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics: what at least three subjects have in common."""
    rows = clean_facts(spark, sf_dir).select("relation_norm", F.lower(F.trim(F.coalesce("object", F.lit("")))).alias("object"), "subject_norm").distinct()
    return rows.groupBy("relation_norm", "object").agg(F.count("subject_norm").alias("subjects")).where("subjects >= 3")


@query(f"""WITH {SQL_W} SELECT ref, min(session_id) AS session_id, count(*) AS windows, sum(length(text)) AS chars FROM w WHERE stream = 'external' GROUP BY 1""")
def external_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_windows(spark, sf_dir).where("stream = 'external'")
    return rows.groupBy("ref").agg(F.min("session_id").alias("session_id"), F.count(F.lit(1)).alias("windows"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {SQL_F} SELECT id, subject_norm, md5(coalesce(subject, '') || '|' || coalesce(relation, '') || '|' || coalesce(object, '')) AS statement FROM f WHERE created_at - valid_from > 86400 * 7""")
def late_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts stored more than a week after they were said."""
    text = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("subject", "relation", "object")))
    return clean_facts(spark, sf_dir).where("created_at - valid_from > 604800").select("id", "subject_norm", F.md5(text).alias("statement"))
