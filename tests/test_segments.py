import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.segments import carry_last, carry_next, exact_median, ranked, running_sum


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), t, rng.choice([None, "x", "y", "z"])) for t in rng.sample(range(1000), 120)]
    return rows, spark.createDataFrame(rows, "k string, t bigint, v string").withColumn("block", F.floor(F.col("t") / 50))


def brute(rows, key, before):
    out = {}
    for k, t, _ in rows:
        near = [x for x in rows if x[0] == k and (x[1] < t if before else x[1] > t) and x[2] is not None]
        out[k, t] = (max if before else min)(near, key=lambda x: x[1])[2] if near else None
    return out


def test_carry_both_ways(data):
    rows, df = data
    last = {(r.k, r.t): r.o for r in carry_last(df, ["k"], "block", "t", F.col("v"), "o").collect()}
    assert last == brute(rows, "k", True)
    nxt = {(r.k, r.t): r.o for r in carry_next(df, ["k"], "block", "t", F.col("v"), "o").collect()}
    assert nxt == brute(rows, "k", False)


def test_rank_sum_and_median(data):
    rows, df = data
    got = {(r.k, r.t): (r["rank"], r.s) for r in running_sum(ranked(df, ["k"], "block", ["t"]), ["k"], "block", ["t"], F.col("t"), "s").collect()}
    for k, t, _ in rows:
        upto = [x[1] for x in rows if x[0] == k and x[1] <= t]
        assert got[k, t] == (len(upto), sum(upto))
    medians = {r.k: r.median for r in exact_median(df, ["k"], "t", 37).collect()}
    for k in "ab":
        values = sorted(x[1] for x in rows if x[0] == k)
        assert medians[k] == (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t bigint, v string, block bigint")
    assert carry_last(df, ["k"], "block", "t", F.col("v"), "o").count() == 0
    assert exact_median(df, ["k"], "t", 5).count() == 0
