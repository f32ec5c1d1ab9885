"""One object for the common calls on a folder of tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.history import attribute_history
from palimpsest.operators.recall import candidates, ranked_items
from palimpsest.operators.search import bm25, latest_vectors
from palimpsest.operators.spans import overlaps, scope_bound, spans_of, time_scope
from palimpsest.plans import hybrid, ledger, memory, texts
from palimpsest.plans.base import clean_facts, clean_windows
from palimpsest.session import small
from palimpsest.sources.tables import table


class Memory:
    """Reads of a memory's tables; every method gives a DataFrame and none changes a table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def recall(self, query: str, k: int = 20) -> DataFrame:
        """The best windows by keywords: id, bm25, speaker, said, text."""
        hits = bm25(clean_windows(self.spark, self.folder), query).orderBy(F.desc("bm25"), "item").limit(k)
        return clean_windows(self.spark, self.folder).join(F.broadcast(hits), F.col("id") == F.col("item")).select("id", "bm25", "speaker", "said", "text")

    def ask(self, question: str, vector: list[float], now: float, k: int = 20, live_session: str | None = None) -> DataFrame:
        """The best windows for a question and its vector, all circumstances counted: id, score, speaker, said, text."""
        rows = self.table("vectors").where((F.col("kind") == "window") & (F.size("vec") == len(vector)))
        vectors = latest_vectors(rows).select(F.col("item_id").alias("item"), "vec", "norm")
        asked = self.spark.createDataFrame([(list(map(float, vector)), math.sqrt(sum(x * x for x in vector)))], "vec array<double>, norm double")
        windows = self.table("windows")
        found = candidates(windows, vectors, question, asked, hybrid.last_night(windows), k, scope=time_scope(question, now), live_session=live_session)
        best = small(ranked_items(found, k, hybrid.W.steps).select("id", "score"))
        return clean_windows(self.spark, self.folder).join(F.broadcast(best), "id").select("id", "score", "speaker", "said", "text")

    def facts(self, words: str = "", status: str | None = "active", since: float | None = None) -> DataFrame:
        """Facts that hold every word in subject, relation or object."""
        rows = clean_facts(self.spark, self.folder)
        for word in words.split():
            rows = rows.where(F.concat_ws(" ", "subject", "relation", "object").ilike(f"%{word}%"))
        if status:
            rows = rows.where(F.col("status") == status)
        return rows if since is None else rows.where(F.coalesce("h_start", "valid_from") >= since)

    def scope(self, phrase: str, now: float) -> tuple[float, float] | None:
        """The interval of the times named in a phrase, read as a question's: from the first start to the last end."""
        found = time_scope(phrase, now)
        return found and found[:2]

    def said_in(self, phrase: str, now: float) -> DataFrame:
        """Windows said in the time that a phrase names; all if it names none."""
        windows, scope = clean_windows(self.spark, self.folder), self.scope(phrase, now)
        return windows if scope is None else windows.where((F.col("said") >= scope[0]) & (F.col("said") < scope[1]))

    def about(self, phrase: str, now: float) -> DataFrame:
        """Windows said in the time that a phrase names, or that speak of it; all if it names none."""
        windows, scope = clean_windows(self.spark, self.folder), self.scope(phrase, now)
        if scope is None:
            return windows
        speaking = spans_of(windows, ["id"]).where(overlaps(F.col("t_start"), F.col("t_end"), scope)).select("id")
        said = windows.where((F.col("said") >= scope[0]) & (F.col("said") < scope[1])).select("id")
        return windows.join(speaking.union(said).distinct(), "id", "left_semi")

    def between(self, start: str, end: str, now: float) -> DataFrame:
        """Windows said from one bound to another, each an ISO time or a phrase; an empty one doesn't bound."""
        first, last = scope_bound(start, now), scope_bound(end, now, end=True)
        windows = clean_windows(self.spark, self.folder)
        windows = windows if first is None else windows.where(F.col("said") >= first)
        return windows if last is None else windows.where(F.col("said") < last)

    def history(self) -> DataFrame:
        return attribute_history(self.table("facts"), self.table("relations"))

    def report(self) -> dict[str, DataFrame]:
        """The overview's parts by name."""
        wanted = {"counts": ledger.table_counts, "speakers": ledger.speaker_overview, "nights": ledger.night_report, "review": ledger.review_queue, "runs": memory.task_runs, "provenance": texts.provenance}
        return {name: f(self.spark, self.folder) for name, f in wanted.items()}
