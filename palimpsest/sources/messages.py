"""Chat messages and tool results as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import seconds, sha_id

PART = "struct<type: string, text: string>"
CALL = "struct<id: string, function: struct<name: string, arguments: string>>"
MESSAGES = f"session_id string, role string, content string, tool_calls array<{CALL}>, tool_call_id string, name string, timestamp string"


def read_messages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines of messages, as a table or as a stream of files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(MESSAGES).json(path)


def flat_content(content: Column) -> Column:
    """Text of a message whose content is a string or a JSON list of parts: text parts by line, images as [image]."""
    parts = F.from_json(content, f"array<{PART}>")
    image = F.lower(F.coalesce(content, F.lit(""))).contains("image")
    lines = F.transform(
        parts,
        lambda p: F.when(p["type"].isin("text", "input_text", "output_text"), p["text"]).when(p["type"].isin("image", "image_url", "input_image"), "[image]"),
    )
    joined = F.array_join(F.filter(lines, lambda x: x.isNotNull() & (x != "")), "\n")
    is_list = content.rlike(r"^\s*\[\s*\{") & (content.contains('"type"') | image)
    return F.when(is_list & parts.isNotNull(), joined).otherwise(F.coalesce(content, F.lit("")))


def said_at(timestamp: Column, default: Column) -> Column:
    """Epoch seconds of a number (seconds or milliseconds) or an ISO time; ``default`` if it is neither."""
    number = seconds(timestamp.try_cast("double"))
    moment = F.unix_micros(F.try_to_timestamp(F.regexp_replace(timestamp, "Z$", "+00:00"))) / 1e6
    return F.coalesce(number, moment, default)


def captured(messages: DataFrame, now: float, seen: DataFrame | None = None) -> DataFrame:
    """Messages once each, with their text, time, hash and ref. ``seen``: session_id, message_hash of those captured before.

    The same message in another session is another one. Messages without session or role count under empty ones.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = messages.withColumn("text", F.trim(flat_content(F.col("content")))).withColumn("session_id", empty("session_id"))
    calls = F.coalesce(F.to_json("tool_calls"), F.lit("[]"))
    rows = rows.withColumn("message_hash", sha_id(F.col("session_id"), empty("role"), F.col("text"), empty("tool_call_id"), calls))
    rows = rows.dropDuplicates(["session_id", "message_hash"])
    if seen is not None:
        rows = rows.join(seen.select("session_id", "message_hash"), ["session_id", "message_hash"], "left_anti")
    ref = F.concat_ws(":", F.lit("msg"), "session_id", F.substring("message_hash", 1, 12))
    return rows.withColumns({"said": said_at(F.col("timestamp"), F.lit(now)), "ref": ref})


def resolved_calls(messages: DataFrame) -> DataFrame:
    """Results of tools with the name and arguments of the call they answer: session_id, tool_call_id, tool, args, text."""
    calls = messages.where("tool_calls is not null").select("session_id", F.explode("tool_calls").alias("c"))
    calls = calls.select("session_id", F.col("c.id").alias("tool_call_id"), F.col("c.function.name").alias("tool"), F.col("c.function.arguments").alias("args")).dropDuplicates(["session_id", "tool_call_id"])
    results = messages.where("role = 'tool' and tool_call_id is not null").select("session_id", "tool_call_id", flat_content(F.col("content")).alias("text"), "name")
    joined = results.join(calls, ["session_id", "tool_call_id"], "left")
    return joined.select("session_id", "tool_call_id", F.coalesce("tool", "name").alias("tool"), F.coalesce("args", F.lit("{}")).alias("args"), "text")


RESULT = "struct<url: string, title: string, content: string, text: string, markdown: string, snippet: string, error: string>"


def web_results(payloads: DataFrame, content: str = "content") -> DataFrame:
    """Pages in JSON payloads (an object with results, a list, or one object): url, title, text, error; one row a page."""
    body = F.regexp_extract(F.col(content), r"(?s)(\{.*\}|\[.*\])", 1)
    many = F.from_json(F.get_json_object(body, "$.results"), f"array<{RESULT}>")
    listed = F.when(body.startswith("["), F.from_json(body, f"array<{RESULT}>"))
    one = F.when(body.startswith("{"), F.array(F.from_json(body, RESULT)))
    pages = payloads.select(F.explode(F.coalesce(many, listed, one)).alias("p"))
    text = F.coalesce(*(F.nullif(F.trim(F.col(f"p.{c}")), F.lit("")) for c in ("content", "text", "markdown", "snippet")))
    return pages.select("p.url", "p.title", text.alias("text"), F.col("p.error").alias("error"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files with an id by content, each content once."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.substring(F.sha2("content", 256), 1, 16).alias("id"), "path", "length", "modificationTime").groupBy("id").agg(F.min("path").alias("path"), F.max("length").alias("bytes"))
