"""Queries on lines' wear, grounding and supersession of facts, notices, cards of tasks, overlays and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import norm_entity, sha_id
from palimpsest.operators.journal import OPERATIONS, corrected
from palimpsest.operators.segments import carry_next
from palimpsest.operators.spans import spans_of
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


#: Seconds of the band of lines that wear a line, in which they fade to 1 / e, and of the blocks that sessions are scanned in.
BAND, TAU, DAY = 7200, 6 * 3600, 86400
_L = "l AS (SELECT * FROM w WHERE stream = 'conversation' AND said IS NOT NULL AND session_id IS NOT NULL)"


@query(f"""WITH {SQL_W}, {_L} SELECT a.id, count(b.id) AS near, round(coalesce(sum(exp(-abs(a.said - b.said) / {TAU}.0)), 0), 6) AS wear FROM l a LEFT JOIN l b ON b.session_id = a.session_id AND b.id <> a.id AND abs(a.said - b.said) <= {BAND} GROUP BY 1""")
def conversation_wear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How worn a line is by the others of its session within two hours.

    The fading sum parts into one of earlier and one of later lines, each a running sum over a range of time; a day of a
    session is scanned at once, with the lines of the band before and behind it. So no pairs of lines are made.
    """
    lines = session_lines(spark, sf_dir).select("id", "session_id", "said").withColumn("day", F.floor(F.col("said") / DAY))
    days = F.array_distinct(F.array(F.col("day"), F.floor((F.col("said") - BAND) / DAY), F.floor((F.col("said") + BAND) / DAY)))
    spread = lines.withColumn("block", F.explode(days)).withColumn("at", F.col("said") - F.col("block") * DAY)
    by_time = Window.partitionBy("session_id", "block").orderBy("at")
    upto, onward = by_time.rangeBetween(-BAND, 0), by_time.rangeBetween(0, BAND)
    same = Window.partitionBy("session_id", "block", "at")
    before = F.exp(-F.col("at") / TAU) * F.sum(F.exp(F.col("at") / TAU)).over(upto)
    behind = F.exp(F.col("at") / TAU) * F.sum(F.exp(-F.col("at") / TAU)).over(onward)
    near = F.count(F.lit(1)).over(by_time.rangeBetween(-BAND, BAND)) - 1
    worn = spread.select("id", "day", "block", near.alias("near"), (before + behind - F.count(F.lit(1)).over(same) - 1).alias("wear"))
    return worn.where("block = day").select("id", "near", F.round(F.abs("wear"), 6).alias("wear"))


@query(f"""WITH {SQL_W}, {_L}, e AS (SELECT session_id, max(said) AS last_said FROM l GROUP BY 1)
SELECT l.id FROM l JOIN e USING (session_id) WHERE said >= last_said - 10800 AND session_id IN (SELECT session_id FROM e WHERE last_said >= (SELECT max(said) FROM l) - {DAY})""")
def live_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines still in mind: the last three hours of sessions that went on in the last day; recall leaves them out."""
    lines = session_lines(spark, sf_dir).select("id", "session_id", "said")
    ends = lines.groupBy("session_id").agg(F.max("said").alias("last_said"))
    now = F.broadcast(ends.agg(F.max("last_said").alias("now")))  # one row
    live = ends.join(now).where(F.col("last_said") >= F.col("now") - DAY).select("session_id", "last_said")
    return lines.join(live, "session_id").where(F.col("said") >= F.col("last_said") - 10800).select("id")


@query(f"""WITH {SQL_F}, s AS (SELECT substr(sha1(subject_norm || chr(31) || relation_norm || chr(31) || {_NORM.format('object')} || chr(31) || coalesce(modality, 'stated') || chr(31)), 1, 16) AS key, id, created_at FROM f
WHERE subject_norm IS NOT NULL AND relation_norm IS NOT NULL) SELECT key, arg_min(id, (created_at, id)) AS first_id, count(*) AS sightings, CAST(0.25 * (count(*) - 1) AS DOUBLE) AS credit FROM s WHERE created_at IS NOT NULL GROUP BY 1""")
def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by what they say: the first one is kept, each later sighting adds a quarter of credit."""
    facts = clean_facts(spark, sf_dir).where("subject_norm is not null and relation_norm is not null and created_at is not null")
    key = sha_id(F.col("subject_norm"), F.col("relation_norm"), norm_entity(F.col("object")), F.coalesce("modality", F.lit("stated")))
    kept = facts.groupBy(key.alias("key")).agg(F.min(F.struct("created_at", "id")).alias("first"), F.count(F.lit(1)).alias("sightings"))
    return kept.select("key", F.col("first.id").alias("first_id"), "sightings", F.round(0.25 * (F.col("sightings") - 1), 2).alias("credit"))


_SELF, _YOU = r"(?i)\b(I|me|my|mine)\b", r"(?i)\b(you|your|yours)\b"
_ASCII = r"regexp_replace(coalesce(w.text, ''), '[^\x00-\x7F\PL]', '_', 'g')"  # engines differ on where words with other letters end
_GROUND = f"""{SQL_F}, {SQL_W}, g AS (SELECT s.fact_id, s.window_id, contains(lower(coalesce(w.text, '')), lower(f.subject)) AS named,
  {_NORM.format('w.speaker')} = f.subject_norm AND regexp_matches({_ASCII}, '{_SELF}') AS says_i, list_contains(string_split(coalesce(w.flags, ''), ' '), 'assistant') AND regexp_matches({_ASCII}, '{_YOU}') AS says_you
  FROM fact_sources s JOIN f ON f.id = s.fact_id JOIN w ON w.id = s.window_id WHERE f.subject IS NOT NULL)"""


@query(f"WITH {_GROUND} SELECT fact_id, count(*) AS sources, count(*) FILTER (named) AS named, count(*) FILTER (says_i) AS says_i, count(*) FILTER (says_you) AS says_you, coalesce(bool_or(named OR says_i OR says_you), false) AS grounded FROM g GROUP BY 1")
def fact_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a source of each statement names its subject, or is the subject's own words, or is said to it."""
    facts = clean_facts(spark, sf_dir).where("subject is not null").select(F.col("id").alias("fact_id"), "subject", "subject_norm")
    text, flags = F.coalesce("text", F.lit("")), F.split(F.coalesce("flags", F.lit("")), " ")
    plain = F.regexp_replace(text, r"[\p{L}&&[^\x00-\x7F]]", "_")
    windows = clean_windows(spark, sf_dir).select(
        F.col("id").alias("window_id"), F.lower(text).alias("low"), norm_entity(F.col("speaker")).alias("by"), plain.rlike(_SELF).alias("i"), (F.array_contains(flags, "assistant") & plain.rlike(_YOU)).alias("says_you")
    )
    rows = table(spark, sf_dir, "fact_sources").join(facts, "fact_id").join(windows, "window_id")
    rows = rows.select("fact_id", F.contains("low", F.lower("subject")).alias("named"), ((F.col("by") == F.col("subject_norm")) & F.col("i")).alias("says_i"), "says_you")
    grounded = F.coalesce(F.max(F.col("named") | F.col("says_i") | F.col("says_you")), F.lit(False))
    return rows.groupBy("fact_id").agg(F.count(F.lit(1)).alias("sources"), F.count_if("named").alias("named"), F.count_if("says_i").alias("says_i"), F.count_if("says_you").alias("says_you"), grounded.alias("grounded"))


@query(f"""WITH {SQL_F}, a AS (SELECT id, subject_norm, relation_norm, {_NORM.format('object')} AS o, valid_from FROM f WHERE status IN ('active', 'superseded') AND valid_from IS NOT NULL AND subject_norm IS NOT NULL AND relation_norm IS NOT NULL AND coalesce(modality, 'stated') = 'stated'),
n AS (SELECT *, lead(id) OVER s AS new_id, lead(o) OVER s AS new_o, lead(valid_from) OVER s AS new_from FROM a WINDOW s AS (PARTITION BY subject_norm, relation_norm ORDER BY valid_from, id)),
fs AS (SELECT fact_id, list(DISTINCT window_id) AS ws FROM fact_sources GROUP BY 1)
SELECT n.id AS old_id, new_id, coalesce(list_has_all(y.ws, x.ws), false) AS same_sources FROM n LEFT JOIN fs x ON x.fact_id = n.id LEFT JOIN fs y ON y.fact_id = new_id WHERE new_id IS NOT NULL AND new_o <> o AND new_from > valid_from""")
def supersession_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that the next one of their attribute may have ended: another object, later; and whether every source of
    the old one is one of the new one, which then proves nothing. Attributes are scanned in blocks of weeks."""
    kept = clean_facts(spark, sf_dir).where("status in ('active', 'superseded') and valid_from is not null and subject_norm is not null and relation_norm is not null and coalesce(modality, 'stated') = 'stated'")
    rows = kept.select("id", "subject_norm", "relation_norm", norm_entity(F.col("object")).alias("o"), "valid_from", F.floor(F.col("valid_from") / WEEK).alias("block"))
    minus = rows.select("*", F.struct("valid_from", "id").alias("at"))
    later = _next(minus, ["subject_norm", "relation_norm"])
    found = later.where("next is not null and next.o <> o and next.valid_from > valid_from").select(F.col("id").alias("old_id"), F.col("next.id").alias("new_id"))
    of = table(spark, sf_dir, "fact_sources").groupBy("fact_id").agg(F.collect_set("window_id").alias("ws"))
    found = found.join(of.select(F.col("fact_id").alias("old_id"), F.col("ws").alias("old_ws")), "old_id", "left").join(of.select(F.col("fact_id").alias("new_id"), F.col("ws").alias("new_ws")), "new_id", "left")
    return found.select("old_id", "new_id", F.coalesce(F.size(F.array_except("old_ws", "new_ws")) == 0, F.lit(False)).alias("same_sources"))


def _next(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``next``: valid_from, id and o of the row after by (valid_from, id). Rows of one time are put in order of id first."""
    ties = Window.partitionBy(*keys, "valid_from").orderBy("id")
    rows = rows.withColumn("tie", F.row_number().over(ties))
    inside = F.lead(F.struct("valid_from", "id", "o")).over(ties)
    firsts = rows.where("tie = 1")
    after = carry_next(firsts, keys, "block", "valid_from", F.struct("valid_from", "id", "o"), "after").select(*keys, "valid_from", "after")
    return rows.withColumn("inside", inside).join(after, [*keys, "valid_from"]).withColumn("next", F.coalesce("inside", "after"))


_NOW = 1750000000


@query(f"""WITH {SQL_F} SELECT id, CASE WHEN h_end < {_NOW} THEN 'overdue' WHEN h_start <= {_NOW} THEN 'passing' ELSE 'ahead' END AS notice, CAST(floor((coalesce(h_end, h_start) - {_NOW}) / {DAY}) AS BIGINT) AS days FROM f
WHERE modality = 'planned' AND status = 'active' AND h_start IS NOT NULL AND h_start < {_NOW} + 7 * {DAY} AND id NOT IN (SELECT fact_id FROM fact_sources s JOIN f n ON n.id = s.fact_id WHERE n.status = 'unconfirmed')""")
def due_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans that a sensor notices once: overdue, passing or ahead within a week, without those noticed already (unconfirmed)."""
    facts = clean_facts(spark, sf_dir)
    noticed = table(spark, sf_dir, "fact_sources").join(facts.where("status = 'unconfirmed'").select(F.col("id").alias("fact_id")), "fact_id", "left_semi").select(F.col("fact_id").alias("id")).distinct()
    plans = facts.where((F.col("modality") == "planned") & (F.col("status") == "active") & (F.col("h_start") < _NOW + 7 * DAY)).join(noticed, "id", "left_anti")
    notice = F.when(F.col("h_end") < _NOW, "overdue").when(F.col("h_start") <= _NOW, "passing").otherwise("ahead")
    return plans.select("id", notice.alias("notice"), F.floor((F.coalesce("h_end", "h_start") - _NOW) / DAY).alias("days"))


_CARD = f"""{SQL_A}, g AS (SELECT request_ref, min(coalesce(request_text, '')) AS request, count(*) AS steps, count(*) FILTER (coalesce(error, 0) = 1) AS failures, list_sort(list(DISTINCT tool) FILTER (tool IS NOT NULL)) AS tools,
  arg_max({_STATUS_SQL}, (said, id)) FILTER (said IS NOT NULL) AS last_status FROM a WHERE request_ref IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {_CARD} SELECT request_ref, left(request, 200) || ' -> ' || steps || ' steps with ' || coalesce(array_to_string(tools, ', '), '') || ' -> ' || coalesce(last_status, 'unknown') AS card,
  CASE WHEN failures = 0 THEN 'done' WHEN failures = steps THEN 'failed' WHEN last_status = 'ok' THEN 'done after errors' ELSE 'partly' END AS outcome FROM g""")
def task_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each request: what was asked, the steps and tools, how the last one ended, and the outcome."""
    at = F.when(F.col("said").isNotNull(), F.struct("said", "id"))
    cards = clean_actions(spark, sf_dir).where("request_ref is not null").withColumn("status", action_status()).groupBy("request_ref").agg(
        F.min(F.coalesce("request_text", F.lit(""))).alias("request"), F.count(F.lit(1)).alias("steps"), F.count_if(F.coalesce("error", F.lit(0)) == 1).alias("failures"),
        F.sort_array(F.collect_set("tool")).alias("tools"), F.max_by("status", at).alias("last_status"),
    )
    text = F.concat(F.substring("request", 1, 200), F.lit(" -> "), F.col("steps").cast("string"), F.lit(" steps with "), F.array_join("tools", ", "), F.lit(" -> "), F.coalesce("last_status", F.lit("unknown")))
    outcome = F.when(F.col("failures") == 0, "done").when(F.col("failures") == F.col("steps"), "failed").when(F.col("last_status") == "ok", "done after errors").otherwise("partly")
    return cards.select("request_ref", text.alias("card"), outcome.alias("outcome"))


@query(f"""WITH {SQL_W}, m AS (SELECT id, flags, CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'dropped' WHEN said IS NULL THEN 'event' WHEN said < 1740000000 THEN 'compacted' END AS mark, ascii(substr(id, 1, 1)) % 5 = 0 AS undone FROM w),
o AS (SELECT id, CASE WHEN mark IS NULL OR undone THEN coalesce(flags, '') ELSE trim(coalesce(flags, '') || ' ' || mark) END AS flags FROM m) SELECT flags, count(*) AS windows FROM o GROUP BY 1""")
def marked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags after windows were dropped, marked as events or compacted by operations, a fifth of which was undone."""
    windows = clean_windows(spark, sf_dir).select("id", F.coalesce("flags", F.lit("")).alias("flags"), "text", "said")
    mark = F.when(F.col("text").isNull() | (F.trim("text") == ""), "dropped").when(F.col("said").isNull(), "event").when(F.col("said") < 1740000000, "compacted")
    marks = windows.withColumn("mark", mark).where("mark is not null").withColumn("op", F.xxhash64("id").bitwiseAND(F.lit((1 << 61) - 1)))
    null = F.lit(None).cast("string")
    made = marks.select("op", F.lit("mark").alias("kind"), F.col("id").alias("key"), F.lit("flags").alias("field"), F.trim(F.concat("flags", F.lit(" "), "mark")).alias("value"), F.lit(None).cast("bigint").alias("undoes"))
    undone = marks.where(F.ascii(F.substring("id", 1, 1)) % 5 == 0).select((F.col("op") + (1 << 61)).alias("op"), F.lit("undo"), null, null, null, F.col("op"))
    operations = made.union(undone).to(spark.createDataFrame([], OPERATIONS).schema)
    return corrected(windows.select("id", "flags"), operations, "id", ["flags"]).groupBy("flags").agg(F.count(F.lit(1)).alias("windows"))


@query(f"""WITH {SQL_W}, {SQL_A}, {SQL_F}, u AS (SELECT 'line' AS kind, said AS t FROM w WHERE stream = 'conversation' UNION ALL SELECT CASE WHEN error = 1 THEN 'failed step' ELSE 'step' END, said FROM a UNION ALL SELECT 'fact', created_at FROM f)
SELECT CAST(floor(t / {DAY}) AS BIGINT) AS day, count(*) FILTER (kind = 'line') AS lines, count(*) FILTER (kind = 'step') AS steps, count(*) FILTER (kind = 'failed step') AS failed_steps, count(*) FILTER (kind = 'fact') AS facts FROM u WHERE t IS NOT NULL GROUP BY 1""")
def daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, steps, failed steps and stored facts of each day."""
    at = [F.col("said").alias("at")]
    lines = clean_windows(spark, sf_dir).where("stream = 'conversation'").select(F.lit("line").alias("kind"), *at)
    steps = clean_actions(spark, sf_dir).select(F.when(F.col("error") == 1, "failed step").otherwise("step").alias("kind"), *at)
    rows = lines.union(steps).union(clean_facts(spark, sf_dir).select(F.lit("fact"), "created_at")).where("at is not null")
    count = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    return rows.groupBy(F.floor(F.col("at") / DAY).alias("day")).agg(count("line", "lines"), count("step", "steps"), count("failed step", "failed_steps"), count("fact", "facts"))


@query("""WITH c AS (SELECT value > 15 AS a, event_type IN ('purchase', 'click') AS b FROM events), n AS (SELECT count(*) AS n, count(*) FILTER (a AND b) AS both_yes, count(*) FILTER (NOT a AND NOT b) AS both_no, count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (b AND NOT a) AS only_second FROM c)
SELECT *, round((both_yes + both_no) / n, 6) AS agreement, round(((both_yes + both_no) / n - e) / (1 - e), 6) AS kappa FROM n, (SELECT ((both_yes + only_first) * (both_yes + only_second) + (both_no + only_first) * (both_no + only_second)) / (n * n) AS e FROM n) WHERE n > 0""".replace("SELECT *,", "SELECT n, both_yes, both_no, only_first, only_second,"))
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two verdicts on the same cases agree: the table of four, the share, and the share beyond chance."""
    a, b = F.col("value") > 15, F.col("event_type").isin("purchase", "click")
    one = table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.count_if(a & b).alias("both_yes"), F.count_if(~a & ~b).alias("both_no"), F.count_if(a & ~b).alias("only_first"), F.count_if(b & ~a).alias("only_second")).where("n > 0")
    n, same = F.col("n"), (F.col("both_yes") + F.col("both_no")) / F.col("n")
    by_chance = ((F.col("both_yes") + F.col("only_first")) * (F.col("both_yes") + F.col("only_second")) + (F.col("both_no") + F.col("only_first")) * (F.col("both_no") + F.col("only_second"))) / (n * n)
    return one.withColumns({"agreement": F.round(same, 6), "kappa": F.round((same - by_chance) / (1 - by_chance), 6)})


@query("""SELECT event_type AS kind, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 THEN 'choice' ELSE 'yes or no' END AS mode, count(*) AS asked, count(*) FILTER (value > 15) AS injected, round(count(*) FILTER (value > 15) / count(*), 6) AS rate, round(avg(value), 6) AS mean_value, max(value) AS slowest
FROM events WHERE props IS NOT NULL GROUP BY 1, 2""")
def gate_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a gate lets pass, by kind of message and mode."""
    rows = table(spark, sf_dir, "events").where("props is not null")
    mode = F.when(F.get_json_object("props", "$.k").cast("int") >= 50, "choice").otherwise("yes or no")
    passed = F.count_if(F.col("value") > 15)
    return rows.groupBy(F.col("event_type").alias("kind"), mode.alias("mode")).agg(F.count(F.lit(1)).alias("asked"), passed.alias("injected"), F.round(passed / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("slowest"))


@query("SELECT user_id AS item, count(*) FILTER (event_type = 'purchase') AS helpful, count(*) FILTER (event_type = 'error') AS wrong, count(*) FILTER (event_type = 'purchase') - 2 * count(*) FILTER (event_type = 'error') AS credit FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1")
def feedback_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit of feedback: helpful adds one, wrong takes two."""
    rows = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')")
    counts = rows.groupBy(F.col("user_id").alias("item")).agg(F.count_if(F.col("event_type") == "purchase").alias("helpful"), F.count_if(F.col("event_type") == "error").alias("wrong"))
    return counts.select("item", "helpful", "wrong", (F.col("helpful") - 2 * F.col("wrong")).alias("credit"))


@query()
def dated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three dates that each line's words mean and that don't show a year already, and whether they are past at the end of the tables."""
    lines = session_lines(spark, sf_dir).select("id", "said", "text")
    found = spans_of(lines, ["id"]).where("type = 'time'").join(lines.select("id", "text"), "id")
    found = found.withColumn("phrase", F.expr("substring(text, start + 1, end - start)")).where(~F.col("phrase").rlike(r"\d{4}"))
    now = F.broadcast(lines.agg(F.max("said").alias("now")))  # one row
    first = found.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("start"))).where("rn <= 3")
    return first.join(now).select("id", "phrase", "value", (F.col("t_end") <= F.col("now")).alias("past"))
