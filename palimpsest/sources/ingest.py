"""From messages, tool payloads and pages to windows, and the sink that stores them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import sha_id
from palimpsest.operators.windows import window_texts
from palimpsest.plans.texts import redact

# How lines of a handoff between context windows begin and end.
HANDOFF_OPENS = (
    "[CONTEXT COMPACTION", "[CONTEXT SUMMARY]", "[END OF PRIOR CONTEXT", "Earlier turns were compacted into the summary below", "This is a handoff from a previous context window",
    "If no user message appears AFTER this summary", "Topic overlap with the summary does NOT mean", "## Historical Task Snapshot",
)
HANDOFF_SECTIONS = ("## Resolved Questions", "## Detailed Session Log", "## Pruned Skills")
HANDOFF_CLOSES, HANDOFF_HEADING = "--- END OF CONTEXT SUMMARY", r"^\s*\[PRIOR CONTEXT\b[^\]\n]*\]\s*$"
# Keys of a payload's entry that may hold its text, in order, and signs of an error in plain text.
TEXT_KEYS = ("content", "markdown", "text", "raw_content", "page_content", "body", "snapshot")
ERROR_SIGNS = r'(?i)^\s*\{\s*"error"|\bTraceback \(most recent call last\)|\berror:\s'
#: Characters of a page that are stored.
PAGE_CHARS = 60_000

_ENTRY = "struct<url: string, title: string, error: string, " + ", ".join(f"{k}: string" for k in TEXT_KEYS) + ">"


def without_handoff(text: Column) -> Column:
    """A message without the handoff in it: from a line that opens one to the line that closes it, or the end.

    Section headings open one only if it is closed further on. Null stays null.
    """
    lines = F.split(text, "\n", -1)
    starts = lambda line, marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.ltrim(line).startswith(m))
    last_close = F.size(lines) - F.coalesce(F.nullif(F.array_position(F.transform(F.reverse(lines), lambda x: x.contains(HANDOFF_CLOSES)), True), F.lit(0)), F.size(lines) + 1)
    marked = F.transform(
        lines,
        lambda line, i: F.struct(
            line.alias("line"),
            (starts(line, HANDOFF_OPENS) | (starts(line, HANDOFF_SECTIONS) & (i <= last_close))).alias("opens"),
            line.contains(HANDOFF_CLOSES).alias("closes"),
            ((i == 0) & line.rlike(HANDOFF_HEADING)).alias("heading"),
        ),
    )
    none = F.array().cast("array<string>")

    def read(state: Column, x: Column) -> Column:
        inside = state["inside"] | x["opens"]
        kept = F.when(inside | x["heading"], state["kept"]).otherwise(F.concat(state["kept"], F.array(x["line"])))
        return F.struct((inside & ~x["closes"]).alias("inside"), kept.alias("kept"))

    return F.aggregate(marked, F.struct(F.lit(False).alias("inside"), none.alias("kept")), read, lambda s: F.array_join(s["kept"], "\n"))


def tests_passed(text: Column) -> Column:
    """The line of a test run's counts and whether all passed: a struct of line and ok, null without one."""
    line = F.regexp_extract(text, r"((?:\d+ failed|\d+ passed|\d+ errors?)[^\n]*)", 1)
    return F.when(line != "", F.struct(F.substring(line, 1, 160).alias("line"), (~line.contains("failed") & ~line.contains("error")).alias("ok")))


def citations(text: Column) -> Column:
    """Notes that a text cites as [[knowledge/...]]."""
    return F.regexp_extract_all(text, F.lit(r"\[\[(knowledge/[^\]\s]+)\]\]"), 1)


def payload_pages(payloads: DataFrame, content: str = "content", fallback_url: Column | None = None) -> DataFrame:
    """Pages of web results: url, title, text, is_error; one row a page, or one for a payload that failed.

    A payload may stand in an envelope of tags. It is an object with results, a list or one object in JSON, or plain
    text; an entry's text is the first of TEXT_KEYS that isn't blank, and entries with an error or without text are left out.
    """
    nowhere = F.lit(None).cast("string") if fallback_url is None else fallback_url
    raw = F.coalesce(F.col(content), F.lit(""))
    wrapped = F.regexp_extract(raw, r"(?s)^\s*<([A-Za-z_]+)[^>]*>\s*(.*?)\s*</\1>\s*$", 2)
    rows = payloads.select(F.when(wrapped != "", wrapped).otherwise(raw).alias("body"), nowhere.alias("nowhere"))
    get = lambda path: F.get_json_object("body", path)
    is_list, is_object = F.col("body").rlike(r"(?s)^\s*\[") & get("$[0]").isNotNull(), F.col("body").rlike(r"(?s)^\s*\{") & get("$").isNotNull()
    failed = is_object & ((F.coalesce(get("$.success"), F.lit("")) == "false") | (get("$.error").isNotNull() & get("$.results").isNull()))
    entries = F.when(is_list, F.from_json("body", f"array<{_ENTRY}>")).when(is_object & get("$.results").isNotNull(), F.from_json(get("$.results"), f"array<{_ENTRY}>")).when(is_object, F.array(F.from_json("body", _ENTRY)))

    def page(e: Column) -> Column:
        text = F.coalesce(*(F.when(F.trim(e[k]) != "", e[k]) for k in TEXT_KEYS))
        return F.struct(F.coalesce(e["url"], F.col("nowhere")).alias("url"), F.coalesce(e["title"], F.lit("")).alias("title"), F.when(F.coalesce(e["error"], F.lit("")) == "", text).alias("text"), F.lit(False).alias("is_error"))

    plain = F.array(F.struct(F.col("nowhere").alias("url"), F.lit("").alias("title"), F.col("body").alias("text"), F.substring("body", 1, 400).rlike(ERROR_SIGNS).alias("is_error")))
    error = F.array(F.struct(F.col("nowhere").alias("url"), F.lit("").alias("title"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("is_error")))
    found = F.filter(F.transform(entries, page), lambda p: p["text"].isNotNull())
    pages = F.when(failed, error).when(is_list | is_object, F.when(F.size(found) > 0, found).otherwise(error)).otherwise(plain)
    return rows.select(F.inline(pages))


def windows_of(rows: DataFrame, text: str = "text") -> DataFrame:
    """Windows of messages or pages (ref, text and other columns, which are kept): position, id and text of each.

    Secrets and handoffs are taken out before the text is cut; empty texts give none.
    """
    clean = rows.withColumn(text, redact(without_handoff(F.coalesce(F.col(text), F.lit("")))))
    cut = clean.select(*(c for c in clean.columns if c != text), F.posexplode(window_texts(F.col(text))).alias("position", "text"))
    return cut.withColumn("id", sha_id(F.col("ref"), F.col("position")))


def message_windows(captured: DataFrame) -> DataFrame:
    """Windows of captured messages (of sources.messages): id, ref, session_id, speaker, said, text, flags, stream."""
    said = captured.where("role in ('user', 'assistant')").select("ref", "session_id", F.col("role").alias("speaker"), "said", "text")
    flags = F.when(F.col("speaker") == "assistant", "assistant").otherwise("")
    return windows_of(said).select("id", "ref", "session_id", "speaker", "said", "text", flags.alias("flags"), F.lit("conversation").alias("stream"))


def page_windows_of(pages: DataFrame, known: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """New pages (ref, url, title, text, content_hash) and their windows. ``pages``: url, title, text; ``known``: content_hash.

    Pages are redacted, cut off at PAGE_CHARS, and left out if their content is known; of equal contents one stays.
    """
    kept = pages.where("text is not null and trim(text) <> ''").select("url", "title", F.substring(redact(F.col("text")), 1, PAGE_CHARS).alias("text"))
    kept = kept.withColumn("content_hash", sha_id(F.col("text"), n=24)).join(known.select("content_hash").distinct(), "content_hash", "left_anti")
    one = kept.groupBy("content_hash").agg(F.min(F.struct(F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), "text")).alias("x")).select("content_hash", "x.*")
    new = one.withColumn("ref", F.concat(F.lit("url:"), "url", F.lit("#"), F.substring("content_hash", 1, 8)))
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1)
    windows = windows_of(new.select("ref", F.concat(F.lit("source:"), host).alias("speaker"), "text"))
    windows = windows.select("id", "ref", F.lit("").alias("session_id"), "speaker", F.lit(now).alias("said"), "text", F.lit("external").alias("flags"), F.lit("external").alias("stream"))
    return new.select("ref", "url", "title", "text", "content_hash"), windows


def append_windows(windows: DataFrame, path: str, stored: DataFrame | None = None) -> None:
    """Append windows to a folder of Parquet files, without those whose id is among the ``stored`` ones."""
    new = windows if stored is None else windows.join(stored.select("id").distinct(), "id", "left_anti")
    new.dropDuplicates(["id"]).write.mode("append").partitionBy("stream").parquet(path)
