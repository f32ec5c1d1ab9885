"""Keyword and vector search, and their fusion."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.words import QUERY_STOP

# Letters with marks, and the letters without: what decomposes into a Latin letter and marks.
_MARKED = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii() and d[0].islower()}
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def query_terms(text: str, most: int = 24) -> list[str]:
    """Terms of a keyword query: as terms_of, of more than one character and no stop words, each once."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    words = [w for w in "".join(c if c.isalnum() else " " for c in plain).split() if len(w) > 1 and w not in QUERY_STOP]
    return list(dict.fromkeys(words))[:most]


def terms_of(text: Column) -> Column:
    """Words of a text: runs of letters and digits of any script, in lower case and without the marks of Latin letters."""
    plain = F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{M}+", ""), "".join(_MARKED), "".join(_MARKED.values()))
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25(corpus: DataFrame, query: str, item: str = "id", text: str = "text") -> DataFrame:
    """Scores of the items that hold a query term: item, bm25. Corpus statistics cover all rows; an empty query gives none.

    Only the query's terms leave the map side: each row sends its own length once and its few counts.
    """
    terms = query_terms(query)
    rows = corpus.select(F.col(item).alias("item"), terms_of(F.col(text)).alias("words")).withColumn("length", F.size("words"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))  # one row
    if not terms:
        return rows.where(F.lit(False)).select("item", F.lit(0.0).alias("bm25"))

    def count(term: str) -> Column:
        return F.struct(F.lit(term).alias("term"), F.size(F.filter("words", lambda w: w == term)).alias("tf"))

    counts = F.array(*map(count, terms))
    hits = rows.select("item", "length", F.explode(F.filter(counts, lambda c: c["tf"] > 0)).alias("c")).select("item", "length", "c.term", "c.tf")
    seen = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a query term
    scored = hits.join(F.broadcast(seen), "term").join(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy("item").agg(F.sum(part).alias("bm25"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def length(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def latest_vectors(vectors: DataFrame) -> DataFrame:
    """Of each (kind, model, item_id) the vector with the largest rid, unless it is null or all zeros."""
    last = vectors.groupBy("kind", "model", "item_id").agg(F.max_by(F.struct("rid", "vec"), "rid").alias("last")).select("kind", "model", "item_id", "last.*")
    return last.where(F.col("vec").isNotNull()).withColumn("norm", length(F.col("vec"))).where("norm > 0")


def similar_to(rows: DataFrame, query: DataFrame) -> DataFrame:
    """``rows`` (vec, norm) with ``sim``, the cosine to the one vector of ``query`` (vec, norm); other lengths are left out."""
    q = query.select(F.col("vec").alias("q_vec"), F.col("norm").alias("q_norm")).limit(1)
    joined = rows.join(F.broadcast(q)).where(F.size("vec") == F.size("q_vec"))
    return joined.withColumn("sim", dot(F.col("vec"), F.col("q_vec")) / (F.col("norm") * F.col("q_norm"))).drop("q_vec", "q_norm")


def fused(vector_hits: DataFrame, keyword_hits: DataFrame, weight: float = 0.05) -> DataFrame:
    """Union of two sets of hits: item, sim, bm25, score = sim + weight * bm25 / best bm25. A missing part counts as 0."""
    best = keyword_hits.agg(F.max("bm25").alias("best"))  # one row
    both = vector_hits.select("item", "sim").join(keyword_hits.select("item", "bm25"), "item", "full").join(F.broadcast(best))
    sim, graded = F.coalesce("sim", F.lit(0.0)), F.coalesce(F.col("bm25") / F.col("best"), F.lit(0.0))
    return both.select("item", sim.alias("sim"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), (sim + weight * graded).alias("score"))


def temperature_grid(low: float = 0.25, high: float = 4.0, steps: int = 8) -> list[float]:
    return [round(math.exp(math.log(low) + (math.log(high) - math.log(low)) * i / (steps - 1)), 6) for i in range(steps)]
