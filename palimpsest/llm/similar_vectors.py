"""Most similar vectors of every vector, by a permutation index (problem 6).

Pivots order a space: near vectors see them in nearly the same order. Each vector is posted under its nearest pivots;
the vectors that share postings are ranked by the footrule distance of their pivot orders, and the best are compared by
cosine. Groups too small for an index are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import cut
from palimpsest.sources.tables import table

K = 10
#: A group has PIVOTS times the root of its size as pivots, at least PIVOTS_LEAST, drawn from at most SAMPLE vectors (by a
#: hash of the id, evenly over the group) or, for more pivots, from as many vectors.
PIVOTS, PIVOTS_LEAST, SAMPLE = 2, 16, 4096
#: Pivots of a vector's order, those it is posted under, and those a query looks under.
ORDER, POSTED, LOOKED = 24, 8, 12
#: Of each posting list this share, the nearest by footrule, is compared by cosine, but at least and at most so many for each wanted neighbour.
NEAR_SHARE, NEAR_LEAST, NEAR_MOST = 0.5, 2, 48
#: Postings and queries of a list compared in one task; longer lists are cut into blocks on both sides.
BLOCK = 4096
#: Smaller groups are compared whole.
EXACT_BELOW = 256


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors that take part: rid, grp (kind and model), vec.

    Of each (kind, model, item_id) only the largest rid; not if its vec is null, all zeros, holds a null or NaN or has
    another length than most of its model, or than the number in the model's name says.
    """
    last = vectors.where("rid is not null").groupBy("kind", "model", "item_id").agg(F.max_by(F.struct("rid", "vec"), "rid").alias("last")).select("kind", "model", "last.*")
    named = F.regexp_extract("model", r"(\d+)$", 1)
    rows = last.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
    rows = rows.withColumn("size", F.size("vec"))
    usual = rows.groupBy("model", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("model").agg(F.max_by("size", F.struct("n", "size")).alias("usual"))
    rows = rows.join(F.broadcast(usual), rows["model"].eqNullSafe(usual["model"])).drop(usual["model"])  # a row a model
    wanted = F.when(named != "", named.cast("int")).otherwise(F.col("usual"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    rows = rows.where(F.col("size") == wanted).withColumn("norm", norm).where("norm > 0")
    grp = F.concat_ws("|", F.coalesce("kind", F.lit("")), F.coalesce("model", F.lit("")))
    return rows.select("rid", grp.alias("grp"), "vec")


def _unit(vectors) -> np.ndarray:
    """Vectors as rows of length 1."""
    x = np.stack(vectors).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def fit_pivots(rows: DataFrame) -> dict[str, np.ndarray]:
    """Pivots of each group, drawn from a sample of it: about twice the root of its size."""
    sizes = {x.grp: x.n for x in rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a kind and model
    pivots = {}
    for grp, n in sizes.items():
        if n < EXACT_BELOW:
            continue
        wanted = int(max(PIVOTS_LEAST, PIVOTS * np.sqrt(n)))
        most = max(SAMPLE, wanted)
        share = F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.1 * most / n)) + 1
        sample = _unit([x.vec for x in rows.where((F.col("grp") == grp) & share).orderBy(F.xxhash64("rid"), "rid").limit(most).select("vec").collect()])
        rng = np.random.default_rng(7)
        pivots[grp] = sample[rng.choice(len(sample), min(wanted, len(sample)), replace=False)]
    return pivots


def _orders(vec: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    near = vec @ pivots.T
    some = np.argpartition(-near, ORDER - 1, axis=1)[:, :ORDER] if len(pivots) > ORDER else np.tile(np.arange(len(pivots)), (len(vec), 1))
    some.sort(axis=1)  # ties go to the smaller pivot
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


def footrule(query: np.ndarray, rows: np.ndarray, pivots: int) -> np.ndarray:
    """Distances of pivot orders, each pair of a query and a row: summed shifts of the pivots' places; a pivot that
    isn't in an order counts as at its end."""
    places = np.full((len(rows), pivots), ORDER, np.int8)
    np.put_along_axis(places, rows, np.arange(rows.shape[1], dtype=np.int8)[None, :].repeat(len(rows), 0), 1)
    places = np.ascontiguousarray(places.T)
    out = np.zeros((len(query), len(rows)), np.int16)
    for place in range(query.shape[1]):
        out += np.abs(places[query[:, place]] - np.int8(place))
    return out


def _top(scores: np.ndarray, rids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k columns of each row by score and then smaller rid, the row's own rid left out: (row, column)."""
    scores = np.where(rids[None, :] == own[:, None], -np.inf, scores)
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    rows, columns = np.nonzero((scores >= least) & np.isfinite(scores))  # with all that tie for the last place
    order = np.lexsort((rids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


def nearest_by_footrule(orders: np.ndarray, index: np.ndarray, pivots: int, k: int) -> np.ndarray:
    """For each query order which rows of a posting list are compared: those nearest by footrule, ties included."""
    keep = int(min(NEAR_MOST * k, max(NEAR_LEAST * k, NEAR_SHARE * len(index))))
    far = footrule(orders, index, pivots)
    if len(index) <= keep:
        return np.ones(far.shape, bool)
    return far <= np.partition(far, keep - 1, axis=1)[:, keep - 1 : keep]


def neighbours(vectors: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """The ``k`` most similar vectors of each usable one, of the same kind and model: rid, other, score.

    By cosine, rounded to 9 digits, and then smaller rid; all others if there are fewer. Copies count as any vector.
    Every vector is posted; lists of any length are compared in blocks of postings and of queries.
    """
    rows = cut(usable(vectors))
    spark = rows.sparkSession
    pivots = fit_pivots(rows)
    shared = spark.sparkContext.broadcast(pivots)  # about twice the root of a group's size
    columns = ["grp", "post", "query", "rid", "vec", "order"]

    def order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for grp, part in frame.groupby("grp"):
                known = shared.value.get(grp)
                orders = [[-1]] * len(part) if known is None else list(_orders(_unit(part["vec"].to_numpy()), known).astype(np.int32))
                yield part.assign(order=orders)[["grp", "rid", "vec", "order"]]

    ordered = cut(rows.mapInPandas(order, "grp string, rid bigint, vec array<float>, order array<int>"))
    under = lambda most, query: F.transform(F.slice("order", 1, most), lambda p: F.struct(F.lit(query).alias("query"), p.alias("post")))
    posts = ordered.select("grp", "rid", "vec", "order", F.inline(F.concat(under(POSTED, False), under(LOOKED, True)))).select(*columns)
    parts = lambda of: F.greatest(F.ceil(F.count_if(of) / block), F.lit(1)).cast("int")
    sizes = posts.groupBy("grp", "post").agg(parts(~F.col("query")).alias("ni"), parts(F.col("query")).alias("nj"))
    posts = posts.join(F.broadcast(sizes), ["grp", "post"])  # a row a pivot
    own = F.pmod(F.xxhash64("rid"), F.when(F.col("query"), F.col("nj")).otherwise(F.col("ni"))).cast("int")
    every = F.sequence(F.lit(0), F.when(F.col("query"), F.col("ni")).otherwise(F.col("nj")) - 1)
    posts = posts.select(*columns, own.alias("own"), F.explode(every).alias("all"))
    posts = posts.select(*columns, F.when(F.col("query"), F.col("all")).otherwise(F.col("own")).alias("i"), F.when(F.col("query"), F.col("own")).otherwise(F.col("all")).alias("j"))

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        index, asked = frame[~frame["query"]], frame[frame["query"]]
        found = {"rid": [], "other": [], "score": []}
        if len(index) and len(asked):
            rids, vec = index["rid"].to_numpy(), _unit(index["vec"].to_numpy())
            exact = key[0] not in shared.value
            orders = None if exact else np.stack(index["order"].to_numpy()).astype(np.int64)
            for at in range(0, len(asked), 256):
                some = asked.iloc[at : at + 256]
                own = some["rid"].to_numpy()
                score = np.round(_unit(some["vec"].to_numpy()) @ vec.T, 9)
                if not exact:
                    near = nearest_by_footrule(np.stack(some["order"].to_numpy()).astype(np.int64), orders, len(shared.value[key[0]]), k)
                    score = np.where(near, score, -np.inf)
                r, c = _top(score, rids, own, k)
                found["rid"].append(own[r])
                found["other"].append(rids[c])
                found["score"].append(score[r, c])
        return pd.DataFrame({name: np.concatenate(x) if x else [] for name, x in found.items()}).astype({"rid": "int64", "other": "int64", "score": "float64"})

    near = posts.groupBy("grp", "post", "i", "j").applyInPandas(compare, "rid bigint, other bigint, score double").distinct()
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "other"))), 1, k)
    return near.groupBy("rid").agg(best.alias("best")).select("rid", F.explode("best").alias("x")).select("rid", F.col("x.other").alias("other"), (-F.col("x.s")).alias("score"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours(table(spark, sf_dir, "vectors"))
    return near.select(F.least("rid", "other").alias("rid_a"), F.greatest("rid", "other").alias("rid_b")).distinct()


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours(table(spark, sf_dir, "vectors"))
    return near.select("rid", "other", F.round("score", 6).alias("score"))


QUERIES = {"p6_found": p6_found, "p6_neighbours": p6_neighbours}
SQL: dict[str, str] = {}
