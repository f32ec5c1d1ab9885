"""Texts cut off before their end (problem 9).

Evidence by prefixes: the whole text is a strict prefix of a longer text; or its last words are a strict prefix of what
goes on elsewhere (word sequences of the corpus, completed inside the word or by a next word) and hardly ever end a
sentence or line. Besides: its length is one at which far more texts of its source end than at the lengths around; a
fence or brace is left open; or it ends in a broken character.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import cut
from palimpsest.sources.tables import table

#: A text is cut if its last words end a sentence or line in less than this share of their occurrences.
END_SHARE = 0.12
#: Occurrences that the shorter sequence counts for beside the longer one.
BACKOFF = 3.0
#: A length is a limit if at least so many texts of a source have it, and so many times the mean of the lengths around.
LIMIT_LEAST, LIMIT_TIMES, LIMIT_AROUND = 8, 10.0, 50
#: A last sentence of at most so many words, or dots behind it, may be whole though its words mostly go on elsewhere; then only the last word counts.
SHORT = 4
FLUSH = 400_000

#: Letters of the shortest prefix that is hashed; the others have two, four, eight ... times as many. Shorter texts are no prefixes of others.
PREFIX = 8

_WORD = re.compile(r"(\w+)(\W*)")
_MARKS = re.compile(r"\n|\S")
_DIGITS = re.compile(r"\d+")
_JOIN = frozenset(("and", "und", "et", "y"))
_TERMINAL = r"[.!?)\]}\"»”`:;]"
_SHOWS_NOTHING = " \t\n\r\x0b\x0c\u00a0…�"


_gaps: dict[str, str] = {}


def _gap(gap: str) -> str:
    """What stands between two words: W blanks only, E an end, N another mark, L a full stop that a small letter behind it undoes."""
    marks = _MARKS.findall(gap)
    if not marks:
        return "W"
    if marks[0] in ".!?…":
        if marks[0] != ".":
            return "E"
        return "L" if len(marks) == 1 else "E" if marks[1] == "\n" or not marks[1].islower() else "N"
    return "E" if marks[0] == "\n" else "N"


def _words(text: str) -> list[tuple[str, str]]:
    """(word, what follows) - follows: E end of a sentence or line, F end of the text, M a word, N anything else."""
    found = _WORD.findall(text)
    words = [w.lower() for w, _ in found]
    words = [_DIGITS.sub("0", w) if not w.isalpha() else w for w in words]
    out, last = [], len(found) - 1
    for i, (_, gap) in enumerate(found):
        kind = _gaps.get(gap)
        if kind is None:
            kind = _gap(gap)
            if len(gap) <= 4 and len(_gaps) < 100_000:
                _gaps[gap] = kind
        if kind == "W":
            kind = "F" if i == last else "N" if found[i + 1][0] in _JOIN else "M"
        elif kind == "L":
            kind = "N" if i < last and found[i + 1][0][0].islower() else "E"
        out.append((words[i], kind))
    return out


def _in_context(words: list[tuple[str, str]]) -> Iterator[tuple[str, str, str, str]]:
    """(two words before, word, what follows); ^ stands before the first word behind a sentence, line or mark."""
    a, b = "", "^"
    for word, follows in words:
        yield a, b, word, follows
        a, b = (b, word) if follows == "M" else ("", "^")


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        columns = [[k[j] for k in keys] for j in range(4)]
        batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array([counts[k] for k in keys], pa.int64())], ["w1", "w2", "word", "follows", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(_in_context(_words(text)))
        if len(counts) > FLUSH:
            yield flush()
    yield flush()


def _last_words(text: str) -> list[tuple[str, str]]:
    """Words of the end of a text that holds its whole last sentence or line and the three words before its last one."""
    size = 400
    while size < len(text):
        words = _words(text[-size:])
        if len(words) > 6 and any(follows != "M" for _, follows in words[1:-4]):
            return words[1:]
        size *= 4
    return _words(text)


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last three words of each stem, and how many words its last sentence or line has."""
    for batch in batches:
        words = [_last_words(t) for t in batch.column(1).to_pylist()]
        found = [([("", "^", "", "")] + list(_in_context(x)))[-1][:3] for x in words]
        units = [next((n for n, (_, follows) in enumerate(reversed(x[:-1]), 1) if follows != "M"), len(x)) for x in words]
        columns = [batch.column(0), *(pa.array([x[j] for x in found], pa.string()) for j in range(3)), pa.array(units, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "w1", "w2", "frag", "unit"])


def stem(text: Column) -> Column:
    """The text without blanks, dots of omission and broken characters at its end; a lone full stop stays."""
    trimmed = F.rtrim(text, F.lit(_SHOWS_NOTHING))
    return F.when(trimmed.endswith("..."), F.rtrim(text, F.lit(_SHOWS_NOTHING + "."))).otherwise(trimmed)


def _ends(text: Column) -> Column:
    return F.right(text, F.lit(1)).rlike(_TERMINAL)


def _key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 24)


def longer_copies(stems: DataFrame) -> DataFrame:
    """For each stem that a longer one begins with: key and ``follows``, the next characters of the longer one.

    ``stems``: stem, key. Prefixes of PREFIX, twice, four times ... as many letters are hashed. A stem meets those that
    share the longest of these that it has; where there are longer ones, these also hash their prefixes of just the lengths
    that shorter stems there have, and meet them by that hash. Only hashes move; the digest of the prefix decides.
    """
    size = F.length("stem")
    most = F.floor(F.log2(size / PREFIX)).cast("int")
    levels = F.transform(F.sequence(F.lit(0), F.col("most")), lambda k: F.struct(k.alias("level"), F.xxhash64(F.substring("stem", F.lit(1), F.pow(F.lit(2), k).cast("int") * PREFIX)).alias("prefix")))
    hashed = stems.where(size >= PREFIX).withColumn("most", most).select("key", size.alias("size"), "most", F.inline(levels))
    hashed = cut(hashed)
    own = F.when(F.col("most") == F.col("level"), F.col("size"))
    met = hashed.groupBy("level", "prefix").agg(F.collect_set(own).alias("lengths"), F.max("size").alias("longest"))
    met = met.where("size(lengths) > 0").withColumn("lengths", F.filter("lengths", lambda n: n < F.col("longest"))).where("size(lengths) > 0")
    asked = hashed.join(met, ["level", "prefix"]).select("key", F.filter("lengths", lambda n: n < F.col("size")).alias("lengths")).where("size(lengths) > 0")
    asked = asked.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("lengths"))).alias("lengths"))
    longer = stems.join(asked, "key").select("stem", F.explode("lengths").alias("size"))
    longer = longer.select(_key(F.expr("substring(stem, 1, size)")).alias("key"), F.expr("substring(stem, size + 1, 40)").alias("follows"))
    return longer.join(stems.select("key"), "key", "left_semi").distinct()


def end_shares(texts: DataFrame, tails: DataFrame) -> DataFrame:
    """How often each tail's last words end a sentence or line: key, unit, share, word_share, more, ended.

    ``texts``: distinct stems; ``tails``: key, w1, w2, frag, unit. ``more``: occurrences that go on, in the word or behind it; ``ended``: times the last three words end a sentence or line.
    ``word_share`` is of the last word alone.
    The share of the last three words is drawn to that of two, and that to one word's, as if seen BACKOFF times.
    """
    grams = texts.select("stem").mapInArrow(_gram_counts, "w1 string, w2 string, word string, follows string, n bigint")
    grams = cut(grams.groupBy("w1", "w2", "word").agg(*(F.sum(F.when(F.col("follows") == f, F.col("n")).otherwise(0)).alias(f) for f in "EFM"), F.sum("n").alias("n")))
    contexts = {3: ["w1", "w2"], 2: ["w2"], 1: []}
    out = tails
    for order, ctx in contexts.items():
        counted = grams
        if ctx:
            counted = counted.join(tails.select(*ctx).distinct(), ctx, "left_semi")
        counted = counted.groupBy(*ctx, "word").agg(*(F.sum(c).alias(c) for c in ("E", "F", "M", "n")))
        starts = counted.withColumn("frag", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.col("word").substr(F.lit(1), k))))
        whole = F.col("frag") == F.col("word")
        starts = starts.groupBy(*ctx, "frag").agg(
            F.sum(F.when(whole, F.col("E")).otherwise(0)).alias(f"e{order}"),
            F.sum(F.when(whole, F.col("F")).otherwise(0)).alias(f"f{order}"),
            F.sum(F.when(whole, F.col("M")).otherwise(F.col("n"))).alias(f"m{order}"),
        )
        out = out.join(starts, [*ctx, "frag"], "left")
    share, more, shares = F.lit(0.5), F.lit(0), {}
    for order in (1, 2, 3):
        e, f, m = (F.coalesce(f"{x}{order}", F.lit(0)) for x in "efm")
        ended = e + F.greatest(f - 1, F.lit(0))  # its own end proves nothing
        share = (ended + BACKOFF * share) / (ended + m + BACKOFF)
        more = m + more
        shares[order] = share
    return out.select("key", "unit", shares[3].alias("share"), shares[1].alias("word_share"), more.alias("more"), F.coalesce("e3", F.lit(0)).alias("ended"))


def limits(docs: DataFrame, length: str) -> DataFrame:
    """(source, ``length``) pairs at which texts of a source were cut by a limit: far more than around, and mostly without an end."""
    texts = docs.groupBy("source", length, "key").agg(F.max("unended").alias("unended"))
    counts = texts.groupBy("source", length).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("unended").cast("int")).alias("unended"))
    near = counts.withColumn("near", F.floor(F.col(length) / LIMIT_AROUND))
    around = near.groupBy("source", "near").agg((F.sum("n")).alias("all"))
    near = near.where(F.col("n") >= LIMIT_LEAST).join(around, ["source", "near"])
    mean = (F.col("all") - F.col("n")) / (LIMIT_AROUND - 1)
    return near.where((F.col("n") >= LIMIT_TIMES * mean) & (F.col(length) > LIMIT_AROUND) & (F.col("unended") >= 0.5)).select("source", length)


def norm_source(source: Column) -> Column:
    """Source in lower case with single underscores; null and blank give 'unknown'."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(source, F.lit("")))), r"[^\p{L}\p{N}]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def truncated(documents: DataFrame) -> DataFrame:
    """One row per document with ``cut``: doc_id, source (normalised), cut, evidence (null if it isn't cut).

    Null and empty texts aren't cut. Copies of a text are judged once and alike; doc_id isn't assumed to be unique.
    """
    docs = documents.select("doc_id", norm_source(F.col("source")).alias("source"), "text").withColumn("stem", stem(F.coalesce("text", F.lit(""))))
    docs = docs.withColumns({"key": _key(F.col("stem")), "chars": F.length("text"), "bytes": F.octet_length("text")})
    shown = F.rtrim(F.col("text"), F.lit(" \t\n\r"))
    dots = shown.endswith("…") | shown.endswith("...")
    last_line = F.substring_index("stem", "\n", -1)
    fences = F.length("stem") - F.length(F.replace("stem", F.lit("```"), F.lit("``")))
    fence = ((fences % 2 == 1) & ~dots & ~F.col("stem").endswith("```")) | (last_line.startswith("{") & ~last_line.endswith("}"))
    slim = cut(docs.select("doc_id", "source", "key", "chars", "bytes", fence.alias("unclosed"), (~_ends(F.col("stem")) & (F.length("stem") > 0)).alias("unended"), F.col("text").endswith("�").alias("broken"), dots.alias("dots"), last_line.rlike(r"^\s*(?:[-*•]|\d+[.)])\s").alias("item")))
    stems = cut(docs.where(F.length("stem") > 0).groupBy("stem").agg(F.first("key").alias("key")))
    longer = longer_copies(stems)
    goes_on = longer.join(stems, "key").select(
        "key",
        (
            (F.right("stem", F.lit(1)).rlike(r"\w") & F.col("follows").rlike(r"^\w"))
            | (~_ends(F.col("stem")) & ~F.col("follows").rlike(r"^(?:\n|[\s.…!?]*$)"))
        ).alias("goes_on"),
    )
    open_stems = stems.where(~_ends(F.col("stem")))
    tails = cut(open_stems.select("key", "stem").mapInArrow(_tails, "key string, w1 string, w2 string, frag string, unit int"))
    shares = end_shares(stems, tails)
    chars = cut(limits(slim, "chars"))
    octets = limits(slim.join(chars, ["source", "chars"], "left_anti"), "bytes")  # else a mark of omission would make a limit in bytes of one in characters
    judged = (
        slim.join(goes_on, "key", "left")
        .join(shares, "key", "left")
        .join(chars.withColumn("at_chars", F.lit(True)), ["source", "chars"], "left")
        .join(octets.withColumn("at_bytes", F.lit(True)), ["source", "bytes"], "left")
    )
    share = F.when(F.col("dots") | (F.col("unit") <= SHORT), F.greatest("share", "word_share")).otherwise(F.col("share"))
    item = F.col("item") & (F.col("ended") >= 2)  # an item of a list that others hold too
    broken_off = F.col("unended") & ~item & (share < END_SHARE) & (F.col("more") > 0)
    by_copy = F.coalesce("goes_on", F.lit(False))
    limit = F.coalesce("at_chars", "at_bytes", F.lit(False))
    evidence = F.when(by_copy, "longer copy").when(F.coalesce(broken_off, F.lit(False)), "words go on").when(limit, "length").when(F.col("unclosed"), "left open").when(F.coalesce("broken", F.lit(False)), "broken character")
    same = judged.groupBy("key").agg(F.min(evidence).alias("evidence"))
    return slim.select("doc_id", "source", "key").join(same, "key").select("doc_id", "source", F.col("evidence").isNotNull().alias("cut"), "evidence")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cut ones and their share by source."""
    found = truncated(table(spark, sf_dir, "documents"))
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"))


def p9_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut documents by what tells them."""
    return truncated(table(spark, sf_dir, "documents")).where("cut").groupBy("evidence").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_rates": p9_rates, "p9_evidence": p9_evidence}
SQL: dict[str, str] = {}
