"""History of changing attributes, built from snapshots that are compared by Merkle trees."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import norm_entity
from palimpsest.operators.segments import carry_last, carry_next
from palimpsest.session import cut

#: Children of a node of the Merkle tree, and rows of a leaf.
FANOUT, LEAF_ROWS = 16, 64

UNCOUNTED = ("retracted", "cancelled", "unconfirmed")
ATTRIBUTE = ["subject_norm", "relation_norm"]


def tree_depth(rows: int, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS) -> int:
    """Levels below the root so that a leaf holds about ``leaf_rows`` rows, however many there are."""
    return max(1, math.ceil(math.log(max(rows, 1) / leaf_rows, fanout))) if rows > leaf_rows else 1


@dataclass(frozen=True)
class Snapshot:
    """Rows of unique keys in hash buckets (the leaves), and a digest of each leaf, made once and kept."""

    rows: DataFrame
    digests: DataFrame

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], values: list[str], depth: int, fanout: int = FANOUT) -> Snapshot:
        rows = cut(df.select(*keys, *values, F.pmod(F.xxhash64(*keys), F.lit(fanout**depth)).alias("_leaf")))
        columns = [*keys, *values]
        digests = rows.groupBy("_leaf").agg(F.bit_xor(F.xxhash64(*columns, F.lit(1))).alias("a"), F.bit_xor(F.xxhash64(F.lit(2), *columns)).alias("b"), F.count(F.lit(1)).alias("n"))
        return cls(rows, cut(digests))


def differing_leaves(old: Snapshot, new: Snapshot, depth: int, fanout: int = FANOUT) -> DataFrame:
    """Leaves whose digests differ, found from the root down: a level looks only below nodes that differ. A node's
    digest is that of the leaves below it."""
    side = lambda s, name: s.digests.select("_leaf", F.xxhash64("_leaf", "a", "b", "n").alias(name))
    both = side(old, "old").join(side(new, "new"), "_leaf", "full").select("_leaf", F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).alias("new"))
    both = cut(both)
    for level in range(depth):
        below = F.floor(F.col("_leaf") / fanout ** (depth - level)).alias("_node")
        nodes = both.groupBy(below).agg(F.bit_xor("old").alias("o"), F.bit_xor("new").alias("n")).where("o <> n").select("_node")
        if level == 0 and nodes.isEmpty():
            return both.where(F.lit(False)).select("_leaf")
        if level:
            both = both.withColumn("_node", below).join(nodes, "_node", "left_semi").drop("_node")
    return both.where("old <> new").select("_leaf")


def snapshot_changes(old: DataFrame | Snapshot, new: DataFrame | Snapshot, keys: list[str], values: list[str], fanout: int = FANOUT, depth: int | None = None) -> DataFrame:
    """Rows that differ between two snapshots: keys, the new values, and ``op`` (put or drop).

    Keys must be unique in each snapshot; null keys and values compare as values. Only rows of differing leaves are
    compared.
    """
    if depth is None:
        depth = tree_depth(max(x.count() for x in (old, new) if isinstance(x, DataFrame)), fanout)
    old, new = (x if isinstance(x, Snapshot) else Snapshot.of(x, keys, values, depth, fanout) for x in (old, new))
    leaves = differing_leaves(old, new, depth, fanout)
    digest = F.xxhash64(*values)
    a = old.rows.join(leaves, "_leaf", "left_semi").select("_leaf", *(F.col(k).alias(f"_{k}") for k in keys), digest.alias("_was"), F.lit(True).alias("_in_old"))
    b = new.rows.join(leaves, "_leaf", "left_semi").select("_leaf", *keys, *values, digest.alias("_is"), F.lit(True).alias("_in_new"))
    a = a.withColumnRenamed("_leaf", "__leaf")
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_leaf") == F.col("__leaf"))
    changed = b.join(a, same, "full").where("_in_new is null or _in_old is null or _was <> _is")
    return changed.select(
        *(F.when(F.col("_in_new"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys),
        *values,
        F.when(F.col("_in_new"), "put").otherwise("drop").alias("op"),
    )


def statements(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """Statements that count, one row per ``id``: attribute, valid_from, created_at, value, negated.

    Left out are relations that aren't exclusive, rows without subject, relation or valid_from, planned ones and those
    with a status of UNCOUNTED. A null created_at counts as the earliest.
    """
    exclusive = relations.where("exclusive = 1").select(F.col("name").alias("relation_norm")).distinct()
    kept = facts.where(
        F.col("subject_norm").isNotNull()
        & F.col("valid_from").isNotNull()
        & (F.coalesce("modality", F.lit("stated")) != "planned")
        & ~F.coalesce("status", F.lit("active")).isin(*UNCOUNTED)
    )
    return (
        kept.join(exclusive, "relation_norm", "left_semi")
        .select(
            "id", *ATTRIBUTE, "valid_from",
            F.coalesce("created_at", F.lit(float("-inf"))).alias("created_at"),
            norm_entity(F.col("object")).alias("value"),
            (F.coalesce("modality", F.lit("stated")) == "negated").alias("negated"),
        )
        .dropDuplicates(["id"])
    )


def as_known(rows: DataFrame, until: float | None) -> DataFrame:
    """The snapshot of what was stored by ``until``: per attribute and valid_from the statement stored last."""
    known = rows if until is None else rows.where(F.col("created_at") <= until)
    last = F.max_by(F.struct("value", "negated", "id"), F.struct("created_at", "id")).alias("last")
    return known.groupBy(*ATTRIBUTE, "valid_from").agg(last).select(*ATTRIBUTE, "valid_from", "last.*")


def change_log(rows: DataFrame, snapshots: int = 3, fanout: int = FANOUT) -> DataFrame:
    """Changes of each of ``snapshots`` periodic snapshots against the one before, with its number.

    The periods part the time of storing evenly; the first snapshot is compared with an empty one. Each snapshot's
    leaves are hashed once, and their number grows with the rows.
    """
    first = F.min(F.when(F.col("created_at") > float("-inf"), F.col("created_at")))
    low, high, n = rows.agg(first, F.max("created_at"), F.count(F.lit(1))).first()
    ends = [] if low is None else [low + (high - low) * (k + 1) / snapshots for k in range(snapshots - 1)]
    keys, values, depth = [*ATTRIBUTE, "valid_from"], ["value", "negated", "id"], tree_depth(n, fanout)
    logs, old = [], None
    for number, until in enumerate([*ends, None], 1):
        new = Snapshot.of(as_known(rows, until), keys, values, depth, fanout)
        changes = new.rows.drop("_leaf").withColumn("op", F.lit("put")) if old is None else snapshot_changes(old, new, keys, values, fanout, depth)
        logs.append(changes.withColumn("snapshot", F.lit(number)))
        old = new
    return reduce(DataFrame.unionByName, logs)


def versions(log: DataFrame, block_seconds: int = 7 * 86400) -> DataFrame:
    """Periods of each attribute's values from a change log: attribute, value, valid_from, valid_to, id, superseded_by, status.

    The last change of a statement holds. A version starts with a value that isn't the current one; it ends with the
    next other value or with a negated statement of its own value. Attributes are scanned in blocks of time, so one
    attribute may hold most rows.
    """
    last = F.max_by(F.struct("op", "value", "negated", "id"), "snapshot").alias("last")
    rows = log.groupBy(*ATTRIBUTE, "valid_from").agg(last).select(*ATTRIBUTE, "valid_from", "last.*").where("op = 'put'").drop("op")
    rows = rows.withColumn("block", F.floor(F.col("valid_from") / block_seconds))
    rows = carry_last(cut(rows), ATTRIBUTE, "block", "valid_from", F.when(~F.col("negated"), F.col("value")), "current")
    rows = cut(rows.where("not negated or value = current").drop("current"))
    rows = carry_last(rows, ATTRIBUTE, "block", "valid_from", F.struct("value", "negated"), "before")
    edges = rows.where(
        F.when(F.col("negated"), ~F.col("before.negated")).otherwise(
            F.col("before").isNull() | F.col("before.negated") | (F.col("before.value") != F.col("value"))
        )
    ).drop("before")
    edges = carry_next(cut(edges), ATTRIBUTE, "block", "valid_from", F.struct("valid_from", "id"), "end")
    return edges.where("not negated").select(
        *ATTRIBUTE, "value", "valid_from", F.col("end.valid_from").alias("valid_to"), "id", F.col("end.id").alias("superseded_by"),
        F.when(F.col("end").isNull(), "active").otherwise("superseded").alias("status"),
    )


def attribute_history(facts: DataFrame, relations: DataFrame, snapshots: int = 3) -> DataFrame:
    """All versions of the exclusive attributes in ``facts``. An empty table gives no rows.

    Rows of one id count once; ties of created_at go to the larger id; extra columns are ignored.
    """
    return versions(change_log(cut(statements(facts, relations)), snapshots))
