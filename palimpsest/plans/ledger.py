"""Queries on event ledgers: association, decay, credit, rhythms, corrections, decisions and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.search import temperature_grid
from palimpsest.operators.segments import carry_last, carry_next, exact_median, ranked, running_sum, value_at
from palimpsest.plans.base import SQL_A, SQL_F, SQL_W, WEEK, clean_actions, clean_facts, clean_windows, session_lines
from palimpsest.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Seconds in which a raising fades to 1 / e, and how far back raisings count.
TAU = 6 * 3600


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in seconds and the block of time they are in."""
    rows = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return rows.withColumn("block", F.floor(F.col("t") / WEEK))


_E = "e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events), now AS (SELECT max(t) AS now FROM e)"


def _now(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows.agg(F.max("t").alias("now")))  # one row


@query(f"WITH {_E} SELECT user_id AS item, round(sum(exp(-(now - t) / {TAU})), 6) AS habituation, count(*) AS raisings FROM e, now WHERE t > now - {5 * TAU} AND t <= now GROUP BY 1")
def habituation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How worn each item is from being raised lately."""
    rows = events(spark, sf_dir)
    recent = rows.join(_now(rows)).where((F.col("t") > F.col("now") - 5 * TAU) & (F.col("t") <= F.col("now")))
    return recent.groupBy(F.col("user_id").alias("item")).agg(F.round(F.sum(F.exp(-(F.col("now") - F.col("t")) / TAU)), 6).alias("habituation"), F.count(F.lit(1)).alias("raisings"))


SPREAD = 7200


@query(f"""WITH {SQL_W}, {SQL_A}, l AS (SELECT id, session_id, said FROM w WHERE stream = 'conversation' AND said IS NOT NULL AND session_id IS NOT NULL)
SELECT l.id, count(*) AS near, round(sum(exp(-abs(a.said - l.said) / {TAU})), 6) AS spread FROM l JOIN a ON a.session_id = l.session_id AND abs(a.said - l.said) <= {SPREAD} GROUP BY 1""")
def session_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool steps within two hours of each line of their session: a band join on blocks as wide as the band."""
    lines = session_lines(spark, sf_dir).select("id", "session_id", "said").withColumn("slot", F.floor(F.col("said") / SPREAD))
    steps = clean_actions(spark, sf_dir).where("session_id is not null and said is not null").select("session_id", F.col("said").alias("at"))
    slot = F.floor(F.col("at") / SPREAD)
    steps = steps.select("session_id", "at", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    near = lines.join(steps, ["session_id", "slot"]).where(F.abs(F.col("at") - F.col("said")) <= SPREAD)
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("near"), F.round(F.sum(F.exp(-F.abs(F.col("at") - F.col("said")) / TAU)), 6).alias("spread"))


_REAL = ["purchase", "click"]


@query(f"""SELECT user_id AS item, round(coalesce(sum(value) FILTER (event_type IN ('purchase', 'click')), 0), 4) AS real, round(coalesce(sum(value) FILTER (event_type NOT IN ('purchase', 'click')), 0), 4) AS replay, count(*) AS entries FROM events GROUP BY 1""")
def credit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda real: F.round(F.coalesce(F.sum(F.when(F.col("event_type").isin(_REAL) == real, F.col("value"))), F.lit(0.0)), 4)
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item")).agg(part(True).alias("real"), part(False).alias("replay"), F.count(F.lit(1)).alias("entries"))


@query(f"""WITH {_E}, s AS (SELECT event_id, user_id, event_type, t, value / 50.0 AS score FROM e, now WHERE t > now - 86400), h AS (SELECT user_id, sum(exp(-(now - t) / {TAU})) AS hab FROM e, now WHERE t > now - {5 * TAU} GROUP BY 1),
b AS (SELECT * FROM s WHERE score >= (SELECT max(score) FROM s) - 0.1 * 5), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rn FROM b)
SELECT event_id, user_id, round(score * CASE WHEN event_type = 'error' THEN 0.6 ELSE 1.0 END / (1 + coalesce(hab, 0)), 6) AS activation FROM r LEFT JOIN h USING (user_id) WHERE rn <= 2 ORDER BY 3 DESC, 1 LIMIT 20""")
def association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes to mind: the day's items near the best score, two of a source, damped by wear and by bad credit."""
    rows = events(spark, sf_dir)
    worn = habituation_raw(rows)
    day = rows.join(_now(rows)).where(F.col("t") > F.col("now") - 86400).withColumn("score", F.col("value") / 50.0)
    best = F.broadcast(day.agg(F.max("score").alias("best")))  # one row
    band = day.join(best).where(F.col("score") >= F.col("best") - 0.5)
    kept = band.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "event_id"))).where("rn <= 2")
    weight = F.when(F.col("event_type") == "error", 0.6).otherwise(1.0)
    activation = F.col("score") * weight / (1 + F.coalesce("hab", F.lit(0.0)))
    return kept.join(worn, "user_id", "left").select("event_id", "user_id", F.round(activation, 6).alias("activation")).orderBy(F.desc("activation"), "event_id").limit(20)


def habituation_raw(rows: DataFrame) -> DataFrame:
    recent = rows.join(_now(rows)).where(F.col("t") > F.col("now") - 5 * TAU)
    return recent.groupBy("user_id").agg(F.sum(F.exp(-(F.col("now") - F.col("t")) / TAU)).alias("hab"))


@query("""WITH c AS (SELECT user_id AS item, count(*) FILTER (event_type = 'view') AS unused, count(*) FILTER (event_type = 'purchase' AND value > 80) AS used FROM events GROUP BY 1)
SELECT item, unused, -0.5 AS delta FROM c WHERE unused >= 3 AND used = 0""")
def decayed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items often brought up and never of use, which lose credit."""
    kind, value = F.col("event_type"), F.col("value")
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item")).agg(F.count_if(kind == "view").alias("unused"), F.count_if((kind == "purchase") & (value > 80)).alias("used"))
    return counts.where("unused >= 3 and used = 0").select("item", "unused", F.lit(-0.5).alias("delta"))


_GAPS = f"{_E}, g AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e)"


def with_gaps(rows: DataFrame) -> DataFrame:
    """Events with ``gap``, the seconds since the user's event before."""
    ordered = rows.withColumn("at", F.struct("t", "event_id"))
    return carry_last(ordered, ["user_id"], "block", "at", F.col("t"), "before").withColumn("gap", F.col("t") - F.col("before"))


@query(f"WITH {_GAPS} SELECT user_id, round(median(gap), 3) AS usual_gap, count(*) AS gaps FROM g WHERE gap >= 1800 GROUP BY 1 HAVING count(*) >= 3")
def usual_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual pause between conversations, of users with three or more."""
    found = exact_median(with_gaps(events(spark, sf_dir)).where("gap >= 1800"), ["user_id"], "gap", 3600)
    return found.where("n >= 3").select("user_id", F.round("median", 3).alias("usual_gap"), F.col("n").alias("gaps"))


@query(f"""WITH {_E}, d AS (SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS day, min(CAST(floor((t - floor(t / 86400) * 86400) / 60) AS BIGINT)) FILTER (t - floor(t / 86400) * 86400 >= 5 * 3600) AS first_minute FROM e GROUP BY 1, 2)
SELECT user_id, median(first_minute) AS minute, count(*) AS days FROM d WHERE first_minute <= 690 GROUP BY 1 HAVING count(*) >= 3""")
def usual_mornings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    day = F.floor(F.col("t") / 86400)
    second = F.col("t") - day * 86400
    first = rows.groupBy("user_id", day.alias("day")).agg(F.min(F.when(second >= 5 * 3600, F.floor(second / 60))).alias("first_minute"))
    return first.where("first_minute <= 690").groupBy("user_id").agg(F.median("first_minute").alias("minute"), F.count(F.lit(1)).alias("days")).where("days >= 3")


@query(f"""WITH {_GAPS}, u AS (SELECT user_id, median(gap) AS usual FROM g WHERE gap >= 1800 GROUP BY 1), q AS (SELECT g.user_id, g.gap, greatest(21600, least(2 * usual, 259200)) AS first_rung FROM g JOIN u USING (user_id) WHERE gap IS NOT NULL)
SELECT user_id, rung, count(*) AS times FROM (SELECT user_id, gap, unnest([first_rung, 86400, 259200]) AS seconds, unnest([1, 2, 3]) AS rung FROM q) WHERE gap >= seconds GROUP BY 1, 2""")
def quiet_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each user's silence reached each rung: twice the usual gap (6 hours to 3 days), one day, three days."""
    gaps = with_gaps(events(spark, sf_dir)).where("gap is not null").select("user_id", "gap")
    usual = exact_median(gaps.where("gap >= 1800"), ["user_id"], "gap", 3600, "usual")
    first = F.greatest(F.lit(21600.0), F.least(2 * F.col("usual"), F.lit(259200.0)))
    rungs = F.array(*(F.struct(F.lit(n).alias("rung"), s.alias("seconds")) for n, s in ((1, first), (2, F.lit(86400.0)), (3, F.lit(259200.0)))))
    reached = gaps.join(usual, "user_id").select("user_id", "gap", F.inline(rungs)).where("gap >= seconds")
    return reached.groupBy("user_id", "rung").agg(F.count(F.lit(1)).alias("times"))


@query(f"""WITH {_GAPS}, s AS (SELECT user_id, t, CASE WHEN gap IS NULL OR gap >= 1800 THEN 1 ELSE 0 END AS fresh FROM g), n AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS visit FROM s)
SELECT user_id, visit, count(*) AS events, round(max(t) - min(t), 3) AS seconds FROM n GROUP BY 1, 2""")
def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in visits that a pause of half an hour parts."""
    gaps = with_gaps(events(spark, sf_dir))
    fresh = (F.col("gap").isNull() | (F.col("gap") >= 1800)).cast("bigint")
    numbered = running_sum(gaps, ["user_id"], "block", ["t"], fresh, "visit")
    return numbered.groupBy("user_id", "visit").agg(F.count(F.lit(1)).alias("events"), F.round(F.max("t") - F.min("t"), 3).alias("seconds"))


@query(f"""WITH {_E}, o AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'signup'), m AS (SELECT user_id, t FROM e WHERE event_type = 'click'),
j AS (SELECT o.event_id, o.user_id, o.t, min(m.t) AS reply FROM o LEFT JOIN m ON m.user_id = o.user_id AND m.t > o.t AND m.t < o.t + 43200 GROUP BY 1, 2, 3)
SELECT event_id, user_id, CASE WHEN reply IS NULL THEN 'silence' ELSE 'reply' END AS outcome, round(coalesce(reply, t + 43200) - t, 3) AS wait FROM j""")
def reply_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first click within 12 hours of each signup, else silence: both in one order, the next click carried back."""
    rows = events(spark, sf_dir).where("event_type in ('signup', 'click')").withColumn("at", F.struct("t", "event_id"))
    numbered = ranked(rows, ["user_id"], "block", ["at"], "n")
    found = carry_next(numbered, ["user_id"], "block", "n", F.when(F.col("event_type") == "click", F.col("t")), "reply").where("event_type = 'signup'")
    heard = (F.col("reply") > F.col("t")) & (F.col("reply") < F.col("t") + 43200)
    wait = F.when(heard, F.col("reply") - F.col("t")).otherwise(43200.0)
    return found.select("event_id", "user_id", F.when(heard, "reply").otherwise("silence").alias("outcome"), F.round(wait, 3).alias("wait"))


@query(f"""WITH {_E} SELECT event_id, user_id, round(value * pow(0.75, CAST(json_extract(props, '$.k') AS INTEGER) % 4), 9) AS pull FROM e, now WHERE t >= now - 7200 * 12 AND value * pow(0.75, CAST(json_extract(props, '$.k') AS INTEGER) % 4) >= 4""")
def waiting_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the last day that still pull, fading by the length of the chain that brought them up."""
    rows = events(spark, sf_dir)
    depth = F.get_json_object("props", "$.k").cast("int") % 4
    pull = F.col("value") * F.pow(F.lit(0.75), depth)
    return rows.join(_now(rows)).where((F.col("t") >= F.col("now") - 7200 * 12) & (pull >= 4)).select("event_id", "user_id", F.round(pull, 9).alias("pull"))


_AGES = [(60, "just now"), (3600, "minutes"), (86400, "hours"), (604800, "days"), (2592000, "weeks")]


@query(f"WITH {_E} SELECT CASE {' '.join(f'''WHEN now - t < {s} THEN '{n}' ''' for s, n in _AGES)} ELSE 'months' END AS age, count(*) AS events, count(DISTINCT user_id) AS users FROM e, now GROUP BY 1")
def age_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    old = F.col("now") - F.col("t")
    age: Column = F.when(old < _AGES[0][0], _AGES[0][1])
    for seconds, name in _AGES[1:]:
        age = age.when(old < seconds, name)
    per_user = rows.join(_now(rows)).groupBy(age.otherwise("months").alias("age"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy("age").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("users"))


@query(f"""WITH {_E}, n AS (SELECT *, strftime(ts, '%H:%M') AS clock FROM e) SELECT clock >= '22:30' OR clock < '07:00' AS quiet, event_type, count(*) AS events FROM n GROUP BY 1, 2""")
def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.date_format("ts", "HH:mm")
    return table(spark, sf_dir, "events").groupBy(((clock >= "22:30") | (clock < "07:00")).alias("quiet"), "event_type").agg(F.count(F.lit(1)).alias("events"))


@query("""WITH o AS (SELECT event_id AS op, user_id AS item, event_type AS kind, value FROM events WHERE event_type <> 'error'), u AS (SELECT DISTINCT event_id - 1 AS op FROM events WHERE event_type = 'error'),
k AS (SELECT * FROM o WHERE op NOT IN (SELECT op FROM u)) SELECT item, max(op) AS last_op, arg_max(kind, op) AS state, count(*) AS standing FROM k GROUP BY 1""")
def journal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each item by the last operation that wasn't undone; an error undoes the operation before it."""
    rows = table(spark, sf_dir, "events")
    undone = rows.where("event_type = 'error'").select((F.col("event_id") - 1).alias("event_id")).distinct()
    kept = rows.where("event_type <> 'error'").join(undone, "event_id", "left_anti")
    return kept.groupBy(F.col("user_id").alias("item")).agg(F.max("event_id").alias("last_op"), F.max_by("event_type", "event_id").alias("state"), F.count(F.lit(1)).alias("standing"))


@query("""SELECT user_id % 50 AS job, event_type AS step, count(*) AS attempts, arg_max(CASE WHEN value > 5 THEN 'done' ELSE 'failed' END, event_id) AS status, count(*) FILTER (value <= 5) AS failures FROM events GROUP BY 1, 2""")
def job_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") > 5, "done").otherwise("failed")
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("job"), F.col("event_type").alias("step")).agg(
        F.count(F.lit(1)).alias("attempts"), F.max_by(status, F.col("event_id")).alias("status"), F.count_if(F.col("value") <= 5).alias("failures")
    )


@query(f"""WITH {SQL_W} SELECT lower(trim(regexp_replace(coalesce(speaker, '?'), '\\s*\\(.*\\)$', ''))) AS speaker, count(*) AS windows, count(DISTINCT speaker) AS labels, count(DISTINCT session_id) AS sessions, min(said) AS first_said, max(said) AS last_said FROM w WHERE stream = 'conversation' GROUP BY 1""")
def speaker_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.trim(F.regexp_replace(F.coalesce("speaker", F.lit("?")), r"\s*\(.*\)$", "")))
    return clean_windows(spark, sf_dir).where("stream = 'conversation'").groupBy(name.alias("speaker")).agg(
        F.count(F.lit(1)).alias("windows"), F.countDistinct("speaker").alias("labels"), F.countDistinct("session_id").alias("sessions"), F.min("said").alias("first_said"), F.max("said").alias("last_said")
    )


_TABLES = ["windows", "actions", "chunks", "facts", "fact_sources", "entities", "relations", "vectors", "documents", "events"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in _TABLES]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


@query(f"WITH {SQL_F} SELECT night_id, count(*) AS facts, count(DISTINCT subject_norm) AS subjects, count(*) FILTER (status = 'superseded') AS superseded, max(created_at) AS last_at FROM f GROUP BY 1")
def night_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_facts(spark, sf_dir).groupBy("night_id").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("subject_norm").alias("subjects"), F.count_if(F.col("status") == "superseded").alias("superseded"), F.max("created_at").alias("last_at"))


@query(f"""WITH {SQL_F}, {SQL_A}, q AS (SELECT 'plan' AS kind, id FROM f WHERE modality = 'planned' AND status = 'active' UNION ALL SELECT 'unconfirmed', id FROM f WHERE status = 'unconfirmed' UNION ALL SELECT 'failed step', id FROM a WHERE error = 1 UNION ALL SELECT 'dropped page', ref FROM (SELECT DISTINCT ref FROM chunks WHERE dropped = 1))
SELECT kind, count(*) AS waiting, min(id) AS first_id FROM q GROUP BY 1""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, steps = clean_facts(spark, sf_dir), clean_actions(spark, sf_dir)
    kind = F.array_compact(F.array(F.when((F.col("modality") == "planned") & (F.col("status") == "active"), "plan"), F.when(F.col("status") == "unconfirmed", "unconfirmed")))
    rows = facts.select(F.explode(kind).alias("kind"), "id").union(steps.where("error = 1").select(F.lit("failed step"), "id"))
    rows = rows.union(table(spark, sf_dir, "chunks").where("dropped = 1").select(F.lit("dropped page"), "ref").distinct())
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("waiting"), F.min("id").alias("first_id"))


_LOGITS = 5
_SOFT = f"""s AS (SELECT vec_id, label, [CAST(x AS DOUBLE) * 10 FOR x IN embedding[1:{_LOGITS}]] AS z FROM embeddings), x AS (SELECT vec_id, label, [exp(v - list_max(z)) FOR v IN z] AS e FROM s), p AS (SELECT vec_id, label, [v / list_sum(e) FOR v IN e] AS p FROM x)"""


def probabilities(rows: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    """``rows`` with ``p``: the softmax of the first logits at a temperature."""
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    z = F.transform(F.slice("embedding", 1, _LOGITS), lambda v: v.cast("double") * 10 / t)
    rows = rows.withColumn("z", z).withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    return rows.withColumn("p", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, b: a + b))).drop("z", "e")


@query(f"""WITH {_SOFT} SELECT vec_id, list_position(p, list_max(p)) AS choice, round(list_max(p), 6) AS p_choice, round((list_max(p) - 1.0 / {_LOGITS}) / (1 - 1.0 / {_LOGITS}), 6) AS confidence,
  round(list_sum([p[i] * i FOR i IN range(1, {_LOGITS + 1})]), 6) AS expected FROM p""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option, probability, confidence and expected score of each row's logits."""
    rows = probabilities(table(spark, sf_dir, "embeddings"))
    top = F.array_max("p")
    expected = F.aggregate(F.transform("p", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return rows.select("vec_id", F.array_position("p", top).alias("choice"), F.round(top, 6).alias("p_choice"), F.round((top - 1 / _LOGITS) / (1 - 1 / _LOGITS), 6).alias("confidence"), F.round(expected, 6).alias("expected"))


def _soft_sql(first: int, name: str) -> str:
    z = f"[CAST(x AS DOUBLE) * 10 FOR x IN embedding[{first}:{first + _LOGITS - 1}]]"
    return f"[exp(v - list_max({z})) / list_sum([exp(u - list_max({z})) FOR u IN {z}]) FOR v IN {z}] AS {name}"


@query(f"""WITH r AS (SELECT vec_id, {_soft_sql(1, 'p')}, {_soft_sql(1 + _LOGITS, 'shown')} FROM embeddings), s AS (SELECT vec_id, p, list_reverse(shown) AS q FROM r), m AS (SELECT *, [(p[i] + q[i]) / 2 FOR i IN range(1, {_LOGITS + 1})] AS mean FROM s)
SELECT vec_id, list_position(mean, list_max(mean)) AS choice, round(list_max(mean), 6) AS averaged, list_position(p, list_max(p)) <> list_position(q, list_max(q)) AS flip FROM m""")
def order_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of the options, the second with the options in opposite order: that one is put back into the first
    order, both are averaged, and they flip if they differ in their choice."""
    rows = table(spark, sf_dir, "embeddings")
    second = probabilities(rows.withColumn("embedding", F.slice("embedding", 1 + _LOGITS, _LOGITS))).select("vec_id", F.reverse("p").alias("q"))
    rows = probabilities(rows).select("vec_id", "p").join(second, "vec_id")
    rows = rows.withColumn("both", F.zip_with("p", "q", lambda a, b: (a + b) / 2))
    flip = F.array_position("p", F.array_max("p")) != F.array_position("q", F.array_max("q"))
    return rows.select("vec_id", F.array_position("both", F.array_max("both")).alias("choice"), F.round(F.array_max("both"), 6).alias("averaged"), flip.alias("flip"))


_GRID = temperature_grid()


@query(f"""WITH t AS (SELECT unnest(CAST({_GRID} AS DOUBLE[])) AS temperature), s AS (SELECT vec_id, label % {_LOGITS} + 1 AS gold, temperature, [CAST(x AS DOUBLE) * 10 / temperature FOR x IN embedding[1:{_LOGITS}]] AS z FROM embeddings, t),
x AS (SELECT temperature, gold, [exp(v - list_max(z)) FOR v IN z] AS e FROM s) SELECT temperature, round(avg(-ln(greatest(e[gold] / list_sum(e), 1e-12))), 6) AS nll, count(*) AS n FROM x GROUP BY 1""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss of the decisions over a grid of temperatures."""
    rows = table(spark, sf_dir, "embeddings").select("embedding", (F.col("label") % _LOGITS).alias("gold"), F.explode(F.array(*map(F.lit, _GRID))).alias("temperature"))
    scored = probabilities(rows, F.col("temperature"))
    loss = -F.log(F.greatest(F.get("p", F.col("gold")), F.lit(1e-12)))
    return scored.groupBy("temperature").agg(F.round(F.avg(loss), 6).alias("nll"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n, event_type FROM events)
SELECT event_type, max(n) AS n, round(median(value), 6) AS median, max(value) FILTER (rn = CAST(floor(0.9 * n) AS BIGINT) + 1) AS p90 FROM r GROUP BY 1""")
def latency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and the value at index int(0.9 n) of each kind of event."""
    n = F.col("n")
    places = {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "p90": F.floor(0.9 * n)}
    found = value_at(table(spark, sf_dir, "events"), ["event_type"], "value", 1.0, places)
    return found.select("event_type", "n", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), "p90")


_CUTS = [5, 10, 20, 30, 40]


@query(f"""WITH c AS (SELECT unnest({_CUTS}) AS threshold), r AS (SELECT value, event_type IN ('purchase', 'click') AS relevant FROM events)
SELECT threshold, count(*) FILTER (value >= threshold) AS kept, round(count(*) FILTER (value >= threshold AND relevant) / greatest(1, count(*) FILTER (value >= threshold)), 6) AS precision, round(count(*) FILTER (value >= threshold AND relevant) / greatest(1, count(*) FILTER (relevant)), 6) AS recall
FROM r, c GROUP BY 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of a score over thresholds, all counted in one pass."""
    rows = table(spark, sf_dir, "events").select("value", F.col("event_type").isin(_REAL).alias("relevant"))
    stats = [x for c in _CUTS for x in (F.count_if(F.col("value") >= c).alias(f"kept{c}"), F.count_if((F.col("value") >= c) & F.col("relevant")).alias(f"hit{c}"))]
    one = rows.agg(F.count_if("relevant").alias("all"), *stats)
    per = F.array(*(F.struct(F.lit(c).alias("threshold"), F.col(f"kept{c}").alias("kept"), F.col(f"hit{c}").alias("hit")) for c in _CUTS))
    return one.select("all", F.inline(per)).select("threshold", "kept", F.round(F.col("hit") / F.greatest(F.lit(1), "kept"), 6).alias("precision"), F.round(F.col("hit") / F.greatest(F.lit(1), "all"), 6).alias("recall"))


@query("""SELECT coalesce(event_type, 'all') AS category, count(*) AS n, round(avg(CASE WHEN value > 15 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.when(F.col("value") > 15, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy")).select(F.coalesce("event_type", F.lit("all")).alias("category"), "n", "accuracy")


@query("""WITH a AS (SELECT event_id // 2 AS question, value > 15 AS ok FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id // 2 AS question, value > 15 AS ok FROM events WHERE event_id % 2 = 1)
SELECT a.ok AS first_ok, b.ok AS second_ok, count(*) AS questions FROM a JOIN b USING (question) GROUP BY 1, 2""")
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by the verdicts of two arms (even and odd events): the table of agreement, won and lost."""
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2).alias("question"), (F.col("event_id") % 2 == 0).alias("first"), (F.col("value") > 15).alias("ok"))
    pairs = rows.groupBy("question").agg(F.max(F.when(F.col("first"), F.col("ok"))).alias("first_ok"), F.max(F.when(~F.col("first"), F.col("ok"))).alias("second_ok"))
    return pairs.where("first_ok is not null and second_ok is not null").groupBy("first_ok", "second_ok").agg(F.count(F.lit(1)).alias("questions"))


_AT = [1, 5, 10, 20, 50]


@query(f"""WITH q AS (SELECT embedding AS e, label FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT v.vec_id, v.label = q.label AS gold, row_number() OVER (ORDER BY round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 9) DESC, v.vec_id) AS rank FROM embeddings v, q)
SELECT k, count(*) FILTER (gold AND rank <= k) AS hits, min(rank) FILTER (gold) AS first_gold, bool_or(gold AND rank <= k) AS hit FROM s, (SELECT unnest({_AT}) AS k) GROUP BY k""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits at k of a vector query whose gold rows share its label. Only the best rows are ranked; the first gold row's rank is a count."""
    rows = table(spark, sf_dir, "embeddings")
    q = F.broadcast(rows.orderBy("vec_id").limit(1).select(F.col("embedding").alias("e"), F.col("label").alias("wanted")))
    product = F.aggregate(F.zip_with("embedding", "e", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    scored = rows.join(q).select("vec_id", (F.col("label") == F.col("wanted")).alias("gold"), F.struct(-F.round(product, 9), "vec_id").alias("at"))
    best = F.broadcast(scored.where("gold").agg(F.min("at").alias("best")))  # one row
    first = scored.join(best).agg((F.count_if(F.col("at") < F.col("best")) + 1).alias("first_gold"))
    top = scored.orderBy("at").limit(max(_AT))
    top = top.withColumn("rank", F.row_number().over(Window.orderBy("at")))  # at most 50 rows
    per = top.select(F.explode(F.array(*map(F.lit, _AT))).alias("k"), (F.col("gold") & (F.col("rank") <= F.col("k"))).alias("in_k"))
    return per.groupBy("k").agg(F.count_if("in_k").alias("hits"), F.max("in_k").alias("hit")).join(F.broadcast(first))


@query(f"""WITH {SQL_F} SELECT id, strftime(make_timestamp(CAST(valid_from AS BIGINT) * 1000000), '%Y-%m-%d') AS day, strftime(make_date(CAST((year(d) * 12 + month(d) + 2) // 12 AS INTEGER), CAST((year(d) * 12 + month(d) + 2) % 12 + 1 AS INTEGER), CAST(least(day(d), 28) AS INTEGER)), '%Y-%m-%d') AS due
FROM (SELECT id, valid_from, CAST(make_timestamp(CAST(valid_from AS BIGINT) * 1000000) AS DATE) AS d FROM f WHERE valid_from IS NOT NULL)""")
def due_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three months after each statement, never later than the 28th."""
    rows = clean_facts(spark, sf_dir).where("valid_from is not null").withColumn("d", F.timestamp_seconds("valid_from").cast("date"))
    months = F.year("d") * 12 + F.month("d") + 2
    due = F.make_date((F.floor(months / 12)).cast("int"), (months % 12 + 1).cast("int"), F.least(F.day("d"), F.lit(28)))
    return rows.select("id", F.date_format("d", "yyyy-MM-dd").alias("day"), F.date_format(due, "yyyy-MM-dd").alias("due"))


@query("""WITH r AS (SELECT doc_id, length(text) + 1 AS size, origin FROM documents WHERE text IS NOT NULL), c AS (SELECT *, sum(size) OVER (PARTITION BY origin ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM r),
o AS (SELECT origin, min(used) FILTER (used > 4000) AS over FROM c GROUP BY 1) SELECT origin, count(*) AS documents, count(*) FILTER (over IS NULL OR used < over) AS shown FROM c JOIN o USING (origin) GROUP BY 1""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each origin fit in 4000 characters, in order, up to the first that doesn't."""
    rows = table(spark, sf_dir, "documents").where("text is not null and origin is not null").select("doc_id", "origin", (F.length("text") + 1).alias("size")).withColumn("block", F.floor(F.col("doc_id") / 10000))
    used = running_sum(rows, ["origin"], "block", ["doc_id"], F.col("size"), "used")
    return used.groupBy("origin").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("used") <= 4000).alias("shown"))


@query(f"""WITH {SQL_W}, l AS (SELECT id, session_id, said, flags, text, row_number() OVER (PARTITION BY session_id ORDER BY length(text) DESC NULLS LAST, id) AS rn, list_contains(string_split(coalesce(flags, ''), ' '), 'assistant') AS own FROM w WHERE stream = 'conversation' AND session_id IS NOT NULL),
n AS (SELECT *, sum(CASE WHEN own THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS own_so_far FROM l WHERE text NOT LIKE '%?')
SELECT session_id, count(*) AS candidates, count(*) FILTER (NOT own OR own_so_far <= 2) AS selected FROM n GROUP BY 1""")
def selected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each session left when bare questions go and only the two best of the assistant stay: counts suffice."""
    lines = clean_windows(spark, sf_dir).where("stream = 'conversation' and session_id is not null").where(~F.col("text").endswith("?"))
    own = F.array_contains(F.split(F.coalesce("flags", F.lit("")), " "), "assistant")
    counts = lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(own).alias("own"))
    return counts.select("session_id", "candidates", (F.col("candidates") - F.col("own") + F.least("own", F.lit(2))).alias("selected"))


@query(f"""WITH {SQL_W} SELECT id, said, session_id FROM w WHERE stream = 'conversation' AND said < 1760000000 ORDER BY said DESC, id DESC LIMIT 50""")
def lines_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the newest lines before a time."""
    return clean_windows(spark, sf_dir).where("stream = 'conversation' and said < 1760000000").select("id", "said", "session_id").orderBy(F.desc("said"), F.desc("id")).limit(50)


@query(f"""WITH {SQL_W}, b AS (SELECT session_id, max(said) AS last_said FROM w WHERE stream = 'conversation' GROUP BY 1)
SELECT s.session_id, s.last_said, arg_max(w.text, (w.said, w.id)) FILTER (w.text IS NOT NULL) AS last_text FROM b s JOIN w ON w.session_id = s.session_id AND w.stream = 'conversation' AND w.said IS NOT NULL GROUP BY 1, 2""")
def last_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = session_lines(spark, sf_dir)
    at = F.when(F.col("text").isNotNull(), F.struct("said", "id"))
    return lines.groupBy("session_id").agg(F.max("said").alias("last_said"), F.max_by("text", at).alias("last_text"))
