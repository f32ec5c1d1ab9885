"""Clean views of the tables that the queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import seconds
from palimpsest.sources.tables import table

#: Seconds of a block of time that sessions are scanned in.
WEEK = 7 * 86400


_WINDOW_COLS = ["ref", "session_id", "speaker", "text", "flags", "stream"]


def clean_windows(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Windows, each id once, with times in seconds. Where rows of one id differ, the smallest value of a column holds."""
    cols = _WINDOW_COLS if columns is None else columns
    return table(spark, sf_dir, "windows").groupBy("id").agg(*(F.min(c).alias(c) for c in cols), F.min(seconds(F.col("said"))).alias("said"))


def clean_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "facts").dropDuplicates(["id"])


def clean_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "actions").dropDuplicates(["id"])


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed lines of conversations with the block of time they are in."""
    lines = clean_windows(spark, sf_dir).where("stream = 'conversation' and said is not null and session_id is not null")
    return lines.withColumn("block", F.floor(F.col("said") / WEEK))


SQL_W = f"""w AS (SELECT id, {', '.join(f'min({c}) AS {c}' for c in _WINDOW_COLS)}, min(CASE WHEN abs(said) > 1e11 THEN said / 1000 ELSE said END) AS said FROM windows GROUP BY id)"""
SQL_F = "f AS (SELECT DISTINCT ON (id) * FROM facts)"
SQL_A = "a AS (SELECT DISTINCT ON (id) * FROM actions)"
