"""Results appended as JSON lines, resumed by id, and nested evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def remaining(questions: DataFrame, done_path: str, key: str = "id") -> DataFrame:
    """Questions without a result yet. A folder that isn't there holds none."""
    spark = questions.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(done_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return questions
    done = spark.read.schema(questions.select(key).schema).json(done_path).select(key).distinct()
    return questions.join(done, key, "left_anti")


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


DIALOGUE = "id string, sessions array<struct<date: string, turns: array<struct<speaker: string, role: string, text: string, content: string>>>>, qa array<struct<question: string, category: string, evidence: array<string>>>"


def read_dialogues(spark: SparkSession, path: str, spacing: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Turns and questions of nested dialogue sets; turns of a session follow its date ``spacing`` seconds apart."""
    nested = spark.read.schema(DIALOGUE).json(path)
    sessions = nested.select("id", F.posexplode("sessions").alias("session", "s"))
    turns = sessions.select("id", "session", F.col("s.date").alias("date"), F.posexplode("s.turns").alias("turn", "t"))
    start = F.unix_timestamp(F.try_to_timestamp("date"))
    turns = turns.select("id", "session", "turn", F.coalesce("t.speaker", "t.role").alias("speaker"), F.coalesce("t.text", "t.content").alias("text"), (start + F.col("turn") * spacing).alias("said"))
    return turns, nested.select("id", F.posexplode("qa").alias("number", "q")).select("id", "number", "q.*")
