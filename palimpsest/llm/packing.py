"""Containers of a fixed capacity filled with texts (problem 7).

The histogram of lengths is fitted by repeat counts of combinations that fill a container almost whole (non-negative
least squares); the counts are rounded, and what is left of the histogram is fitted anew until little is left, which is
packed greedily, still as a histogram. Each item takes its place by its rank among those of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.tokens import token_count
from palimpsest.session import cut
from palimpsest.sources.tables import table

#: Lengths are rounded up to steps of 1 / UNITS of a container, so the histogram has at most UNITS entries.
UNITS = 1024
#: Partners tried for each length, and steps that a combination may leave free.
PARTNERS, WINDOW = 24, 2
ITERATIONS = 300
#: The histogram is fitted anew until this part of its steps is left, or so many times.
LEFT, FITS = 0.03, 12
#: Items of one length that are ranked in one part.
PART_ITEMS = 100_000


def combinations(histogram: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Shallow combinations of at most three lengths with their multiplicities: (lengths, times), each n x 3.

    ``histogram[u]`` counts items of u steps. A combination takes some of one length, fills up with a second, and the
    rest with one item of a third; it is kept if at most WINDOW steps stay free. 0 stands for no length.
    """
    units = len(histogram) - 1
    there = np.flatnonzero(histogram)
    if not len(there):
        return np.zeros((0, 3), int), np.zeros((0, 3), int)
    rng = np.random.default_rng(seed)
    weight = histogram[there] / histogram[there].sum()
    common = there[np.argsort(-weight, kind="stable")][: PARTNERS // 2]
    found = set()
    nearest = np.zeros(units + 1, int)  # the largest length there of at most so many steps
    for u in range(1, units + 1):
        nearest[u] = u if histogram[u] else nearest[u - 1]
    for a in there:
        partners = {*common, *rng.choice(there, PARTNERS // 2, p=weight)}
        times = units // a
        for k in sorted({1, 2, max(1, times // 2), max(1, times - 1), times}):
            rest = units - k * a
            if rest < 0:
                continue
            if rest <= WINDOW:
                found.add(((a, k), (0, 0), (0, 0)))
                continue
            for b in partners | {nearest[rest], nearest[rest // 2]}:
                m = rest // b if b else 0
                if not m or b == a:
                    continue
                for fewer in range(min(m, 3)):
                    left = rest - (m - fewer) * b
                    c = nearest[left] if left else 0
                    if left - c <= WINDOW and c not in (a, b):
                        found.add(((a, k), (b, m - fewer), (c, int(c > 0))))
    rows = np.array(sorted(found), int).reshape(-1, 3, 2)
    return rows[:, :, 0], rows[:, :, 1]


def repeat_counts(histogram: np.ndarray, lengths: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often to use each combination: non-negative least squares against the histogram by multiplicative steps,
    rounded down, held to the items there are, then topped up in order of the most items used."""
    if not len(lengths):
        return np.zeros(0, int)
    h = histogram.astype(float)
    x = np.full(len(lengths), max(1.0, h.sum() / max(1, len(lengths)) / 4))
    wanted = (h[lengths] * times).sum(1)
    for _ in range(ITERATIONS):
        used = np.bincount(lengths.ravel(), (times * x[:, None]).ravel(), len(h))
        x *= wanted / np.maximum((used[lengths] * times).sum(1), 1e-9)
    left, out = histogram.astype(int).copy(), np.zeros(len(lengths), int)
    for most in (np.floor(x).astype(int), np.full(len(x), histogram.sum() + 1)):
        for p in np.lexsort((np.arange(len(x)), -x)):
            keep = times[p] > 0
            n = min(int(most[p]), int((left[lengths[p][keep]] // times[p][keep]).min()))
            if n > 0:
                out[p] += n
                left[lengths[p][keep]] -= n * times[p][keep]
    return out


def greedy_combinations(histogram: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations, as (length, times) pairs, and their counts that use up a histogram: the longest item first, then
    the longest that fits. Each is repeated until a length runs out, so there are few."""
    left, units, out = histogram.astype(np.int64).copy(), len(histogram) - 1, []
    while left.any():
        room, taken = units, {}
        for u in np.flatnonzero(left)[::-1]:
            n = min(room // u, int(left[u]))
            if n:
                taken[int(u)] = int(n)
                room -= n * u
        repeats = min(int(left[u]) // n for u, n in taken.items())
        for u, n in taken.items():
            left[u] -= n * repeats
        out.append((list(taken.items()), repeats))
    return out


def fitted(histogram: np.ndarray) -> list[tuple[list[tuple[int, int]], int, bool]]:
    """Combinations that use up the histogram, their counts, and whether they come from the least squares."""
    left, units, out = histogram.astype(np.int64).copy(), np.arange(len(histogram)), []
    whole = (left * units).sum()
    for n in range(FITS):
        if (left * units).sum() <= LEFT * whole:
            break
        lengths, times = combinations(left, seed=7 + n)
        counts = repeat_counts(left, lengths, times)
        if not counts.any():
            break
        for p in np.flatnonzero(counts):
            pairs = [(int(u), int(k)) for u, k in zip(lengths[p], times[p], strict=True) if k]
            out.append((pairs, int(counts[p]), True))
            for u, k in pairs:
                left[u] -= k * counts[p]
    return out + [(pairs, n, False) for pairs, n in greedy_combinations(left)]


def places(combined: list[tuple[list[tuple[int, int]], int, bool]]) -> pd.DataFrame:
    """Ranges of ranks that the combinations take: units, first, stop, times, combination, by_squares."""
    rows, taken = [], {}
    for p, (pairs, count, by_squares) in enumerate(combined):
        for u, k in pairs:
            first = taken.get(u, 0)
            taken[u] = first + k * count
            rows.append((u, first, taken[u], k, p, by_squares))
    return pd.DataFrame(rows, columns=["units", "first", "stop", "times", "combination", "by_squares"])


def items_of(documents: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """Items of texts measured in ``tokens`` for each pack size: pack_name, capacity, doc_id, piece, tokens. A text above
    the capacity is cut into full pieces and a rest."""
    sizes = pack_sizes.where("capacity_tokens > 0").groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity"))
    rows = documents.where("tokens > 0").join(F.broadcast(sizes))  # a fixed few
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1)))
    return rows.select("pack_name", "capacity", "doc_id", "piece", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).cast("int").alias("tokens"))


_RANGES = "pack_name string, units int, first bigint, stop bigint, times int, combination int, by_squares boolean"


def _fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    histogram = np.zeros(min(UNITS, int(rows["capacity"].iloc[0])) + 1, np.int64)
    histogram[rows["units"]] = rows["n"]
    return places(fitted(histogram)).assign(pack_name=key[0])[["pack_name", "units", "first", "stop", "times", "combination", "by_squares"]]


def packed(items: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """``items`` (pack_name, capacity, doc_id, piece, tokens; tokens at most the capacity) with ``container``, unique
    in its pack, and ``by_squares``, whether its combination comes from the least squares.

    Items of one length are ranked in parts, so one length may hold most items. A pack's histogram has at most UNITS
    entries and is fitted in one task; the ranges that it gives, a few for each entry, go to all tasks.
    """
    units = F.ceil(F.col("tokens") * F.least(F.lit(UNITS), F.col("capacity")) / F.col("capacity")).cast("int")
    items = cut(items.withColumn("units", units))
    counts = items.groupBy("pack_name", "capacity", "units").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts)
    found = counts.groupBy("pack_name").applyInPandas(_fit, _RANGES).toPandas()  # a few for each entry of the histograms
    tables = {}
    for name, rows in found.groupby("pack_name"):
        rows = rows.sort_values(["units", "first"])
        tables[name] = (rows["units"].to_numpy(np.int64) * 2**44 + rows["first"].to_numpy(np.int64), *(rows[c].to_numpy() for c in ("first", "times", "combination", "by_squares")))

    parts = counts.select("pack_name", "units", F.ceil(F.col("n") / part_items).alias("parts"))
    parted = items.join(F.broadcast(parts), ["pack_name", "units"]).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")))
    sums = parted.groupBy("pack_name", "units", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("pack_name", "units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("pack_name", "units", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("pack_name", "units", "part").orderBy("doc_id", "piece")) - 1
    ranked = parted.withColumn("within", within).join(offsets, ["pack_name", "units", "part"])
    ranked = ranked.select("pack_name", "doc_id", "piece", "tokens", "units", (F.col("within") + F.col("offset")).alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, rows in frame.groupby("pack_name"):
                keys, first, times, combination, by_squares = tables[name]
                rank = rows["rank"].to_numpy(np.int64)
                at = np.searchsorted(keys, rows["units"].to_numpy(np.int64) * 2**44 + rank, "right") - 1
                number = (rank - first[at]) // times[at]
                named = [f"{c}:{n}" for c, n in zip(combination[at], number, strict=True)]
                out.append(rows.assign(container=named, by_squares=by_squares[at])[["pack_name", "container", "doc_id", "piece", "tokens", "by_squares"]])
            yield pd.concat(out) if out else pd.DataFrame({c: [] for c in ("pack_name", "container", "doc_id", "piece", "tokens", "by_squares")})

    return ranked.mapInPandas(place, "pack_name string, container string, doc_id bigint, piece int, tokens int, by_squares boolean")


def containers(documents: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """All texts in containers of each pack size: pack_name, container, doc_id, piece, tokens, by_squares.

    Null, empty and token-free texts aren't items. Copies of a text are items of their own. Pack sizes that are null or
    not above 0 don't count; of several sizes of one name the largest does; without any there are no rows.
    """
    measured = cut(documents.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), token_count(F.col("text")).alias("tokens")))
    return packed(items_of(measured, pack_sizes))


def fill_report(filled: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """Containers, tokens and share of the room used by pack size, beside the fewest containers there could be, and the
    share of the tokens that the least squares placed."""
    one = filled.groupBy("pack_name", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"), F.sum(F.when(F.col("by_squares"), F.col("tokens")).otherwise(0)).alias("by_squares"))
    used = one.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("items").alias("items"), F.sum("by_squares").alias("by_squares"))
    used = used.join(F.broadcast(pack_sizes.groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))), "pack_name")
    return used.select(
        "pack_name", "items", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"), F.round(F.col("by_squares") / F.col("tokens"), 6).alias("by_squares"),
    )


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p7_containers(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
SQL: dict[str, str] = {}
