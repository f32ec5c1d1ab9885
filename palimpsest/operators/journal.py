"""Corrections as operations over rows that are never rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATIONS = "op bigint, kind string, key string, field string, value string, undoes bigint"


def standing(operations: DataFrame) -> DataFrame:
    """Operations that hold: neither undone nor undoings. An undoing can itself be undone; each counts once, whatever the order.

    ``operations``: op (unique), kind, key, field, value, undoes (the op it takes back, or null).
    """
    undoings = operations.where("undoes is not null")
    taken_back = undoings.select(F.col("undoes").alias("op")).distinct()
    effective = undoings.join(taken_back, "op", "left_anti").select(F.col("undoes").alias("op")).distinct()
    return operations.where("undoes is null").join(effective, "op", "left_anti")


def corrected(rows: DataFrame, operations: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``rows`` with the last standing value of each corrected field. A null value clears a field."""
    last = standing(operations).groupBy("key", "field").agg(F.max_by(F.struct("value"), "op").alias("new"))
    wide = last.groupBy(F.col("key").alias("_key")).pivot("field", fields).agg(F.first("new"))
    joined = rows.join(wide.select("_key", *(F.col(f).alias(f"_new_{f}") for f in fields)), F.col(key).cast("string") == F.col("_key"), "left")
    columns = [F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.value").cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns]
    return joined.select(*columns)


def relabelled(rows: DataFrame, column: str, old: str, new: str, key: str, first_op: int) -> DataFrame:
    """Operations that rename a label, one a row that has it; numbered from ``first_op`` by a hash of the key."""
    hit = rows.where(F.col(column) == old).select(F.col(key).cast("string").alias("key")).distinct()
    return hit.select((F.lit(first_op) + F.xxhash64("key").bitwiseAND(F.lit((1 << 40) - 1))).alias("op"), F.lit("relabel").alias("kind"), "key", F.lit(column).alias("field"), F.lit(new).alias("value"), F.lit(None).cast("bigint").alias("undoes"))
