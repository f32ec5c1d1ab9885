"""Chains of parent pointers, resolved by pointer jumping."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import cut


def resolve_chains(nodes: DataFrame, node: str = "node", parent: str = "parent", weight: str | None = None) -> DataFrame:
    """Root and depth of each node: columns ``node``, ``root``, ``depth``, ``status`` (ok, orphan, cycle).

    Each round joins the nodes whose pointers are open with the table and doubles the length of these pointers, so a
    chain of n nodes takes log2(n) rounds and short ones soon cost nothing. ``depth`` is the summed ``weight`` of the ancestors (1 each by default). A parent that is no node
    makes its descendants orphans, rooted at the topmost node that exists. Nodes on a cycle or below one keep a null
    root and depth. Null nodes are left out, repeated ones count once (the smallest parent holds); an empty table gives
    no rows.
    """
    weighed = F.lit(1).cast("bigint") if weight is None else F.coalesce(F.col(weight).cast("bigint"), F.lit(0).cast("bigint"))
    first = nodes.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("up"), weighed.alias("w"))
    first = cut(first.groupBy("node").agg(F.min("up").alias("up"), F.max("w").alias("w")))
    above = first.select(F.col("node").alias("up"), F.col("w").alias("w_up"))
    state = first.join(above, "up", "left").select(
        "node",
        F.when(F.col("w_up").isNotNull(), F.col("up")).alias("up"),
        F.coalesce("w_up", F.lit(0).cast("bigint")).alias("depth"),
        F.when(F.col("w_up").isNotNull(), F.col("up")).otherwise(F.col("node")).alias("root"),
        (F.col("up").isNotNull() & F.col("w_up").isNull()).alias("orphan"),
    )
    state = cut(state)
    done, still = [state.where("up is null")], state.where("up is not null")
    open_nodes = still.count()
    for _ in range(math.ceil(math.log2(open_nodes + 1)) + 1 if open_nodes else 0):
        every = reduce(DataFrame.union, [*done, still])
        above = every.select(F.col("node").alias("up"), *(F.col(c).alias(f"{c}_up") for c in ("up", "depth", "root", "orphan")))
        step = cut(
            still.join(above, "up").select(
                "node",
                F.col("up_up").alias("up"),
                (F.col("depth") + F.col("depth_up")).alias("depth"),
                F.col("root_up").alias("root"),
                (F.col("orphan") | F.col("orphan_up")).alias("orphan"),
            )
        )
        done, still = [*done, step.where("up is null")], step.where("up is not null")
        if still.isEmpty():
            break
    found = reduce(DataFrame.union, done).select("node", "root", "depth", F.when(F.col("orphan"), "orphan").otherwise("ok").alias("status"))
    lost = still.select("node", F.lit(None).cast(still.schema["root"].dataType), F.lit(None).cast("bigint"), F.lit("cycle"))
    return found.union(lost)


def linked_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups of linked nodes: ``node``, ``root`` (the smallest node of the group).

    ``nodes``: node; ``edges``: a, b, in any direction. Each round a group takes over the smallest root next to any of its
    nodes, and every node then the root of its root, so a path of n nodes takes about log2(n) rounds. Edges with a null
    or an end that is no node, loops and repeated rows change nothing; an empty table gives no rows.
    """
    state = nodes.where("node is not null").select("node").distinct().withColumn("root", F.col("node"))
    ends = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = cut(ends.union(ends.select("b", "a")).distinct())
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "node")
        seen = state.join(near, "node", "left").withColumn("near", F.least("root", F.coalesce("near", "root")))
        taken = seen.groupBy("root").agg(F.min("near").alias("new"))
        moved = state.join(taken, "root").select("node", "root", "new")
        above = taken.select(F.col("root").alias("new"), F.col("new").alias("newer"))
        step = cut(moved.join(above, "new", "left").select("node", "root", F.least("new", F.coalesce("newer", "new")).alias("new")))
        state = step.select("node", F.col("new").alias("root"))
        if step.where("new <> root").isEmpty():
            return state
