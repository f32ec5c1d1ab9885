"""Queries of attribute history (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.history import attribute_history
from palimpsest.sources.tables import table


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_history(table(spark, sf_dir, "facts"), table(spark, sf_dir, "relations"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select(
        "subject_norm", "relation_norm",
        F.floor("valid_from").cast("bigint").alias("from_s"),
        F.coalesce(F.floor("valid_to").cast("bigint"), F.lit(0).cast("bigint")).alias("to_s"),
    )


def p1_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


_NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(object, ''), chr(32) || chr(9) || chr(10) || chr(13))),
  '^(the|a|an|my|our|his|her|their)\s+', ''), '[''’]s$', ''), '\s+', ' ', 'g'), '^[ .,:;"'']+|[ .,:;"'']+$', '', 'g')"""

_VERSIONS = f"""
WITH st AS (
  SELECT DISTINCT ON (id) id, subject_norm, relation_norm, valid_from, created_at, {_NORM} AS value,
         coalesce(modality, 'stated') = 'negated' AS negated
  FROM facts
  WHERE relation_norm IN (SELECT name FROM relations WHERE exclusive = 1) AND subject_norm IS NOT NULL AND valid_from IS NOT NULL
    AND coalesce(modality, 'stated') <> 'planned' AND coalesce(status, 'active') NOT IN ('retracted', 'cancelled', 'unconfirmed')),
one AS (
  SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY subject_norm, relation_norm, valid_from ORDER BY created_at DESC NULLS LAST, id DESC) = 1),
cur AS (
  SELECT *, last_value(CASE WHEN NOT negated THEN value END IGNORE NULLS) OVER (PARTITION BY subject_norm, relation_norm ORDER BY valid_from
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current FROM one),
kept AS (
  SELECT *, lag(value) OVER w AS pv, lag(negated) OVER w AS pn FROM cur WHERE NOT negated OR value = current
  WINDOW w AS (PARTITION BY subject_norm, relation_norm ORDER BY valid_from)),
edges AS (
  SELECT * FROM kept WHERE CASE WHEN negated THEN NOT pn ELSE pv IS NULL OR pn OR pv <> value END),
ended AS (
  SELECT *, lead(valid_from) OVER w AS valid_to, lead(id) OVER w AS superseded_by FROM edges
  WINDOW w AS (PARTITION BY subject_norm, relation_norm ORDER BY valid_from))
"""

QUERIES = {"p1_found": p1_found, "p1_history": p1_history}
SQL = {
    "p1_found": _VERSIONS + "SELECT subject_norm, relation_norm, CAST(floor(valid_from) AS BIGINT) AS from_s, coalesce(CAST(floor(valid_to) AS BIGINT), 0) AS to_s FROM ended WHERE NOT negated",
    "p1_history": _VERSIONS + "SELECT subject_norm, relation_norm, value, valid_from, valid_to, id, superseded_by, CASE WHEN valid_to IS NULL THEN 'active' ELSE 'superseded' END AS status FROM ended WHERE NOT negated",
}
