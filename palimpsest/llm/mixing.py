"""One mixture of texts with target shares of tokens by source (problem 8)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import is_blank
from palimpsest.llm.tokens import token_count
from palimpsest.llm.truncation import norm_source
from palimpsest.session import cut
from palimpsest.sources.tables import table

#: Tokens of a block of a source's permutation; each block is summed on its own.
BLOCK_TOKENS = 2_000_000
#: How far, in half the sum of all differences, the registered mixture's shares may be off the targets.
MOST_OFF = 0.03
#: Wanted tokens of the registered mixture, as a share of the tokens that the sources with targets have.
SIZE_SHARE = 0.4
ROUNDS = 60


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent and normalised: 1 keeps them, 0 makes them equal."""
    raised = {s: p**exponent for s, p in shares.items() if p > 0}
    total = sum(raised.values())
    return {s: p / total for s, p in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def bisected(fits, low: float, high: float) -> float:
    """The lowest exponent from ``low`` to ``high`` that fits, if all above it do."""
    if fits(low):
        return low
    for _ in range(ROUNDS):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def largest_size(shares: dict[str, float], room: dict[str, float]) -> float:
    """Tokens of the largest mixture of these shares in which no source gives more than its room."""
    return min((room[s] / p for s, p in shares.items() if p > 0), default=0.0)


def off(shares: dict[str, float], targets: dict[str, float]) -> float:
    """Half the sum of the differences of two sets of shares."""
    return sum(abs(shares.get(s, 0) - p) for s, p in targets.items()) / 2


@dataclass(frozen=True)
class Weights:
    """Shares of a mixture, the exponent they come from, and its tokens."""

    shares: dict[str, float]
    exponent: float
    tokens: float


def weights(targets: dict[str, float], room: dict[str, float], size: float | None = None, wanted_entropy: float | None = None, most_off: float | None = None) -> Weights:
    """Shares of a mixture by one exponent.

    A share is proportional to target * (room share / target) ** (1 - exponent): 1 gives the targets, 0 the shares of
    what there is with all allowed repetitions. With ``size`` the exponent is bisected to the highest one whose mixture
    has that many tokens within the repetition limits, and with ``most_off`` not below the lowest one whose shares are at
    most so far from the targets; the mixture is then as large as the limits allow, up to ``size``. With neither it is 1.
    With ``wanted_entropy`` it is the room shares themselves that are raised to the exponent until their entropy is met.
    """
    targets = tempered({s: p for s, p in targets.items() if room.get(s, 0) > 0}, 1.0)
    if not targets:
        return Weights({}, 1.0, 0.0)
    there = tempered({s: room[s] for s in targets}, 1.0)
    if wanted_entropy is not None:
        exponent = bisected(lambda e: entropy(tempered(there, e)) <= wanted_entropy, 0.0, 16.0)
        shares = tempered(there, exponent)
        return Weights(shares, exponent, min(size or math.inf, largest_size(shares, room)))

    def mixed(exponent: float) -> dict[str, float]:
        return tempered({s: p * (there[s] / p) ** (1 - exponent) for s, p in targets.items()}, 1.0)

    by_size = 0.0 if size is None else 1.0 - bisected(lambda x: largest_size(mixed(1.0 - x), room) >= size, 0.0, 1.0)
    by_off = (size is None) * 1.0 if most_off is None else bisected(lambda e: off(mixed(e), targets) <= most_off, 0.0, 1.0)
    exponent = max(by_size, by_off)
    return Weights(mixed(exponent), exponent, min(size or math.inf, largest_size(mixed(exponent), room)))


def measured_texts(documents: DataFrame) -> DataFrame:
    """Distinct texts: source (normalised), doc_id, tokens. A text counts once, under its smallest doc_id; null and blank texts don't."""
    rows = documents.where(~is_blank(F.col("text"))).select("doc_id", norm_source(F.col("source")).alias("source"), "text")
    one = rows.groupBy(F.sha2("text", 256).alias("key")).agg(F.min(F.struct("doc_id", "source")).alias("x"), F.min_by("text", "doc_id").alias("text"))
    return one.select("x.source", "x.doc_id", token_count(F.col("text")).alias("tokens")).where("tokens > 0")


def planned(texts: DataFrame, targets: DataFrame, size: float | None, wanted_entropy: float | None, most_off: float | None, size_share: float | None = None) -> tuple[Weights, dict[str, int], dict[str, float]]:
    """Weights of the mixture, tokens there are and target shares, by source; a few rows on the driver."""
    wanted = targets.groupBy(norm_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("most"))
    plan = [x for x in wanted.collect() if x.share and x.share > 0 and x.most > 0]  # a fixed few
    sums = {x.source: x.tokens for x in texts.join(F.broadcast(wanted), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}  # at most a row a target
    room = {x.source: sums.get(x.source, 0) * x.most for x in plan}
    size = size if size_share is None else size_share * sum(sums.values())
    return weights({x.source: x.share for x in plan}, room, size, wanted_entropy, most_off), sums, {x.source: x.share for x in plan}


def mixture(documents: DataFrame, targets: DataFrame, size: float | None = None, wanted_entropy: float | None = None, most_off: float | None = None, size_share: float | None = None, seed: int = 7, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Texts of the mixture: source, doc_id, copy, tokens, place, exponent.

    ``targets``: source, target_share, max_repeats; ``size``, ``wanted_entropy`` and ``most_off`` as in weights;
    ``size_share`` gives the size as a share of the tokens there are. A
    source's texts are permuted by a hash in blocks; whole passes are repeated, and of a last one those texts are taken
    of which at least half is within the budget. ``place`` (0 to 1) is where the text stands in the mixture; ordering by
    it interleaves the sources evenly. Sources without texts or targets give nothing; a null max_repeats means 1.
    """
    texts = cut(measured_texts(documents))
    weighed, sums, _ = planned(texts, targets, size, wanted_entropy, most_off, size_share)
    spark = texts.sparkSession
    budget = spark.createDataFrame(
        [(s, p * weighed.tokens, int(sums[s]), max(1, -(-sums[s] // block_tokens))) for s, p in weighed.shares.items()], "source string, budget double, available bigint, blocks bigint"
    )
    rows = texts.join(F.broadcast(budget), "source").withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
    rows = cut(rows.withColumn("block", F.floor((F.shiftright("order", 32) + 2**31) * F.col("blocks") / 2**32)))
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))  # a row for each BLOCK_TOKENS
    inside = Window.partitionBy("source", "block").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("tokens").over(inside)).join(blocks, ["source", "block"])
    upto = F.col("upto") + F.col("offset")
    passes = F.floor(F.col("budget") / F.col("available") + 1e-9)
    rest = F.col("budget") - passes * F.col("available")
    copies = passes + ((upto - F.col("tokens") / 2 <= rest) & (rest > 0.5)).cast("int")
    rows = rows.withColumns({"copies": copies.cast("int"), "start": upto - F.col("tokens")}).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    place = F.least(((F.col("copy") - 1) * F.col("available") + F.col("start")) / F.col("budget"), F.lit(1.0))
    return rows.select("source", "doc_id", "copy", "tokens", F.round(place, 9).alias("place"), F.round(F.lit(float(weighed.exponent)), 6).alias("exponent"))


def mixture_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """By target source: its share wanted and reached, tokens, texts and most copies of one, and, equal in all rows, the
    exponent, the entropy of the shares reached and that of the wanted ones of sources with texts."""
    used = cut(mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("texts"), F.max("copy").alias("most_copies"), F.max("exponent").alias("exponent")))
    wanted = targets.groupBy(norm_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    joined = wanted.join(used, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    sums = joined.agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("held"), F.max("exponent").alias("exponent"))
    joined = joined.drop("exponent").join(F.broadcast(sums))  # one row
    reached = F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0))
    joined = joined.withColumns({"reached": reached, "held_share": F.when(F.col("tokens") > 0, F.col("target_share") / F.col("held"))})
    bits = joined.agg(F.sum(F.when(F.col("reached") > 0, -F.col("reached") * F.log("reached"))).alias("entropy"), F.sum(-F.col("held_share") * F.log("held_share")).alias("wanted_entropy"))
    return joined.join(F.broadcast(bits)).select(
        "source", "target_share", "max_repeats", "tokens", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round("reached", 6).alias("reached_share"), "exponent", F.round("entropy", 6).alias("entropy"), F.round("wanted_entropy", 6).alias("wanted_entropy"),
    )


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of SIZE_SHARE of the tokens there are. Its shares are the targets as long as the repetition limits let
    it; else the exponent gives way until the size is met, or the shares are MOST_OFF from the targets."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), most_off=MOST_OFF, size_share=SIZE_SHARE)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
