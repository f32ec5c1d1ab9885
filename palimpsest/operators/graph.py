"""Communities of a weighted graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.segments import ranked
from palimpsest.session import cut


def communities(edges: DataFrame, rounds: int = 12, least: int = 3) -> DataFrame:
    """Communities by weighted label propagation: node, community, members.

    ``edges``: a, b, weight. In each round every node takes the label with the most weight among its neighbours and,
    with a small weight, itself; ties go to the smaller label; only half of the nodes (by a hash that changes with the
    round) move at once, so that pairs don't swap labels for ever. Communities below ``least`` members are -1, the
    others are numbered by size and then label from 0. Loops and edges with nulls are left out; repeated edges add up.
    A round is one join and two aggregations over the edges, whatever the degrees.
    """
    kept = edges.where("a is not null and b is not null and a <> b and weight > 0").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    both = cut(kept.union(kept.select("b", "a", "weight")).groupBy(F.col("a").alias("node"), F.col("b").alias("other")).agg(F.sum("weight").alias("weight")))
    own = both.groupBy("node").agg((F.max("weight") / 100).alias("weight"))
    labels = cut(both.select("node").distinct().withColumn("label", F.col("node")))
    for number in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "label", "weight")
        votes = votes.union(own.join(labels, "node").select("node", "label", "weight")).groupBy("node", "label").agg(F.sum("weight").alias("weight"))
        best = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.round("weight", 9), F.col("label"))).alias("best"))
        moves = F.pmod(F.xxhash64("node", F.lit(number)), F.lit(2)) == 0
        step = cut(labels.join(best, "node").withColumn("new", F.when(moves, F.col("best")).otherwise(F.col("label"))))
        labels, still = step.select("node", F.col("new").alias("label")), step.where("best <> label").isEmpty()
        if still:
            break
    sizes = cut(labels.groupBy("label").agg(F.count(F.lit(1)).alias("members")))
    larger = sizes.where(F.col("members") >= least).groupBy("members").agg(F.count(F.lit(1)).alias("n"))
    # communities are numbered within their size; the offsets of the sizes, a few numbers, are joined back
    kept = sizes.where(F.col("members") >= least).withColumn("_name", F.col("label").cast("string"))
    ordered = ranked(kept.withColumn("_block", F.substring("_name", 1, 2)), ["members"], "_block", ["_name"], "within")
    ordered = ordered.select("label", "members", (F.col("within") - 1).alias("within"))
    offsets = larger.alias("x").join(larger.alias("y"), F.col("y.members") > F.col("x.members"), "left").groupBy("x.members").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("offset"))
    named = ordered.join(offsets, "members").select("label", (F.col("within") + F.col("offset")).alias("community"))
    joined = labels.join(sizes, "label").join(named, "label", "left")
    return joined.select("node", F.coalesce("community", F.lit(-1)).cast("bigint").alias("community"), "members")
