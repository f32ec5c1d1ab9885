"""Conversations rebuilt from message rows (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import INVISIBLE, UNIT, is_blank, seconds
from palimpsest.operators.chains import resolve_chains
from palimpsest.operators.segments import carry_last
from palimpsest.session import cut
from palimpsest.sources.tables import table

#: Sessions are scanned for the message before in blocks of so many seconds.
BLOCK_SECONDS = 28 * 86400


def _label(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, rf"^{INVISIBLE}+|{INVISIBLE}+$", ""))


def expected_ids(ref: Column, n: Column) -> Column:
    """Ids of a message's rows at the positions 0 to n - 1."""
    one = lambda i: F.substring(F.sha1(F.concat(ref, F.lit(UNIT), i.cast("string"), F.lit(UNIT))), 1, 16)
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), one)


def messages(windows: DataFrame, speakers: DataFrame) -> DataFrame:
    """One row per message of a conversation: session_id, ref, said, assistant, blank, whole.

    ``whole``: its rows are exactly those of the positions from 0 on, told by their ids. Repeated ids count once; rows
    without ref or session count as broken messages of theirs, rows without session are left out.
    """
    labels = speakers.where("role = 'assistant'").agg(F.collect_set(_label(F.col("label"))).alias("labels"))  # a fixed dozen of rows
    rows = (
        windows.where("stream = 'conversation' and session_id is not null")
        .join(F.broadcast(labels))
        .select(
            "session_id", "ref", "id",
            seconds(F.col("said")).alias("said"),
            (
                F.array_contains(F.split(F.coalesce("flags", F.lit("")), r"\s+"), "assistant")
                | F.coalesce(F.array_contains("labels", _label(F.col("speaker"))), F.lit(False))
            ).alias("assistant"),
            is_blank(F.col("text")).alias("blank"),
        )
    )
    merged = [F.min("said").alias("said"), F.max("assistant").alias("assistant"), F.min("blank").alias("blank")]
    rows = rows.groupBy("session_id", "ref", "id").agg(*merged)
    digest = F.bit_xor(F.xxhash64("id"))
    found = rows.groupBy("session_id", "ref").agg(*merged, F.count("id").alias("n"), F.count(F.lit(1)).alias("rows"), digest.alias("digest"))
    zero = F.lit(0).cast("bigint")
    wanted = F.aggregate(expected_ids(F.col("ref"), F.col("n")), zero, lambda acc, i: acc.bitwiseXOR(F.xxhash64(i)))
    whole = F.when(F.col("ref").isNull() | (F.col("n") < F.col("rows")), False).otherwise(wanted == F.col("digest"))
    return found.select("session_id", "ref", "said", "assistant", "blank", whole.alias("whole"))


def linked_messages(found: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Messages that aren't blank, each with ``parent``, the one before it: session_id, ref, assistant, usable, node, parent.

    A message that is broken, without time, or blank though it is the assistant's can't be placed; it stands before all
    others of its session and is no node, so the first message behind it points at nothing. The order is scanned in blocks of time.
    """
    usable = F.col("said").isNotNull() & F.col("whole") & ~(F.col("assistant") & F.col("blank"))
    rows = found.withColumn("usable", usable).where("not blank or not usable").withColumn("node", F.xxhash64("session_id", "ref"))
    rows = rows.withColumn("block", F.when(F.col("usable"), F.floor(F.col("said") / block_seconds)).otherwise(F.lit(-(2**50))))
    rows = rows.withColumn("at", F.struct("usable", F.col("said"), F.coalesce("ref", F.lit("")).alias("ref")))
    return carry_last(rows, ["session_id"], "block", "at", F.col("node"), "parent").select("session_id", "ref", "assistant", "usable", "node", "parent")


def turns(windows: DataFrame, speakers: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """The messages of the kept sessions in order: session_id, turn_no, role, ref.

    Every message points at the one before it in its session (by time, then ref). Pointer jumping resolves all chains; a
    message whose chain ends at something that is no usable message is an orphan, and sessions with orphans or cycles
    are left out, as are those whose root isn't the user's or whose leaf isn't the assistant's. The path from the root
    to the leaf is the conversation: the turn is the depth. No session is gathered in one task.
    """
    linked = cut(linked_messages(cut(messages(windows, speakers)), block_seconds))
    chains = resolve_chains(linked.where("usable").select("node", "parent"))
    nodes = cut(linked.where("usable").join(chains, "node").select("session_id", "ref", "assistant", "depth", "status"))
    sessions = nodes.groupBy("session_id").agg(
        F.min(F.col("status") == "ok").alias("intact"), F.min_by("assistant", "depth").alias("first"), F.max_by("assistant", "depth").alias("last"), F.count_if(F.col("depth") == 0).alias("roots")
    )
    kept = sessions.where("intact and roots = 1 and not first and last").select("session_id")
    role = F.when(F.col("assistant"), "assistant").otherwise("user")
    return nodes.join(kept, "session_id", "left_semi").select("session_id", (F.col("depth") + 1).cast("bigint").alias("turn_no"), role.alias("role"), "ref")


def conversation_turns(windows: DataFrame, speakers: DataFrame) -> DataFrame:
    """As turns, with the text of each message: its rows joined by blanks in order of position."""
    ordered = turns(windows, speakers)
    rows = windows.where("stream = 'conversation'").select("ref", "id", "text").groupBy("ref", "id").agg(F.max("text").alias("text"))
    texts = rows.groupBy("ref").agg(F.map_from_entries(F.collect_list(F.struct("id", "text"))).alias("parts"))
    joined = ordered.join(texts, "ref").withColumn("ids", expected_ids(F.col("ref"), F.size("parts")))
    text = F.array_join(F.transform("ids", lambda i: F.element_at("parts", i)), " ")
    return joined.select("session_id", "turn_no", "role", "ref", text.alias("text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(table(spark, sf_dir, "windows"), table(spark, sf_dir, "speakers"))


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_turns(table(spark, sf_dir, "windows"), table(spark, sf_dir, "speakers"))


_BLANK = r"^[\s\x{00A0}\x{1680}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}\x{00AD}\x{180E}]*$"
_TURNS = rf"""
WITH r AS (
  SELECT id, any_value(session_id) AS session_id, any_value(ref) AS ref, min(CASE WHEN said > 1e11 THEN said / 1000 ELSE said END) AS said,
         bool_or(list_contains(string_split(coalesce(flags, ''), ' '), 'assistant')
                 OR coalesce(lower(trim(speaker)) IN (SELECT lower(trim(label)) FROM speakers WHERE role = 'assistant'), false)) AS asst,
         bool_and(text IS NULL OR regexp_matches(text, '{_BLANK}')) AS blank, max(text) AS text
  FROM windows WHERE stream = 'conversation' AND session_id IS NOT NULL GROUP BY id),
k AS (SELECT *, count(*) OVER (PARTITION BY ref) AS n FROM r),
pos AS (
  SELECT k.*, list_position([substr(sha1(ref || chr(31) || i || chr(31)), 1, 16) FOR i IN range(n)], id) - 1 AS p FROM k),
m AS (
  SELECT session_id, ref, min(said) AS said, bool_or(asst) AS asst, bool_and(blank) AS blank, bool_or(p IS NULL OR p < 0) AS gap,
         string_agg(text, ' ' ORDER BY p) AS text
  FROM pos GROUP BY 1, 2),
s AS (
  SELECT session_id FROM m GROUP BY 1
  HAVING NOT bool_or(said IS NULL OR gap OR (asst AND blank))
     AND NOT arg_min(asst, (said, ref)) FILTER (WHERE NOT blank) AND arg_max(asst, (said, ref)) FILTER (WHERE NOT blank)),
t AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY said, ref) AS turn_no,
         CASE WHEN asst THEN 'assistant' ELSE 'user' END AS role, ref, text
  FROM m WHERE NOT blank AND session_id IN (SELECT session_id FROM s))
"""

QUERIES = {"p5_found": p5_found, "p5_conversations": p5_conversations}
SQL = {
    "p5_found": _TURNS + "SELECT session_id, turn_no, role, ref FROM t",
    "p5_conversations": _TURNS + "SELECT session_id, turn_no, role, ref, text FROM t",
}
