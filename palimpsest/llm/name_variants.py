"""Variant spellings of one person or organisation (problem 4).

A name is two words: given and family name of a person, stem and trade of a firm. Similar words are found by tries that
Levenshtein automata walk. A name points at the best supported name whose words, in either order, are its own or better
supported neighbours of its own, and linked names are a group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import norm_entity
from palimpsest.llm.names import GIVEN, LEGAL_FORMS, SHORT_FORMS
from palimpsest.operators.chains import linked_groups
from palimpsest.session import cut
from palimpsest.sources.tables import table

#: Most edits (a swap of neighbours is one) between similar words, and over both words of a name.
WORD_EDITS, NAME_EDITS = 2, 3
#: Two words are both in use, and no variants of each other, if the rarer one stands with this share of the number of
#: different words that the other stands with, but at least with LEAST of them.
USE_SHARE, LEAST = 0.2, 3
#: A word in this share of the firms' names, mostly not the first, is a trade; so there are at most 1 / TRADE_SHARE for each word of a name.
TRADE_SHARE = 0.004
#: Most words of a shard on either side; a larger one is walked in blocks.
BLOCK_WORDS = 2000
#: Marks the trade of a firm, so that it is no person's name.
TRADE = "~"

_ACCENTS = ("àáâãäåāăąçćčďđèéêëēėęěğìíîïīįıłñńňòóôõöøōőŕřśšşťţùúûüūůűųýÿžźżœæßþ", "aaaaaaaaacccddeeeeeeeegiiiiiiilnnnoooooooorrsssttuuuuuuuuyyzzzoasp")
_TITLES = frozenset("mr mrs ms miss dr prof sir herr frau mme mlle sr sra srta".split())
_FOLDS = str.maketrans("ywzcq", "ivskk")
_DOUBLE = re.compile(r"(.)\1+")


def plain(name: str) -> str:
    return (name or "").lower().translate(str.maketrans(*_ACCENTS))


def fold(word: str) -> str:
    """Letters that are often taken for each other made equal; no word gets longer or shorter by it."""
    return word.translate(_FOLDS)


def forms_of(word: str) -> set[str]:
    """The folded word, and with pairs of letters that are taken for one, and double ones, drawn together."""
    folded = fold(word)
    return {folded, _DOUBLE.sub(r"\1", folded.replace("ph", "f").replace("rn", "m"))}


def bound(length: int) -> int:
    """Edits allowed between a word of so many letters and a longer one; shorter words than three only equal themselves."""
    return 0 if length < 3 else 1 if length < 6 else WORD_EDITS


class Automaton:
    """Levenshtein automaton of a word for at most ``most`` edits, swaps of neighbours included.

    A state holds, for each number of edits, the set of the word's places that can be reached with them, and the places
    from which a swap is half done; sets are bits of an integer. The state after a letter that leads nowhere is None.
    """

    def __init__(self, word: str, most: int):
        self.end, self.most = 1 << len(word), most
        self.masks: dict[str, int] = {}
        for i, c in enumerate(word, 1):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.start = ([(1 << (k + 1)) - 1 for k in range(most + 1)], [0] * (most + 1))

    def step(self, state: tuple[list[int], list[int]], letter: str) -> tuple[list[int], list[int]] | None:
        mask, (reached, halves) = self.masks.get(letter, 0), state
        now, swaps = [(reached[0] << 1) & mask], [0]
        for k in range(1, self.most + 1):
            before = reached[k - 1]
            now.append(((reached[k] << 1) & mask) | before | (before << 1) | (now[k - 1] << 1) | (halves[k] & (mask << 1)))
            swaps.append((before << 2) & mask)
        return (now, swaps) if now[-1] or swaps[-1] else None

    def edits(self, state: tuple[list[int], list[int]]) -> int | None:
        return next((k for k, places in enumerate(state[0]) if places & self.end), None)


def edits_between(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours counting one; most + 1 if there are more."""
    automaton = Automaton(a, most)
    state = automaton.start
    for letter in b:
        state = automaton.step(state, letter)
        if state is None:
            return most + 1
    found = automaton.edits(state)
    return most + 1 if found is None else found


def trie(words: list[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = word
    return root


def within(root: dict, word: str, most: int) -> Iterator[tuple[str, int]]:
    """Words of a trie at most ``most`` edits from ``word``; a branch that the automaton can't follow isn't walked."""
    automaton = Automaton(word, most)
    stack = [(root, automaton.start)]
    while stack:
        node, state = stack.pop()
        for c, child in node.items():
            if c == "":
                edits = automaton.edits(state)
                if edits is not None:
                    yield child, edits
            elif (new := automaton.step(state, c)) is not None:
                stack.append((child, new))


def _cuts(length: int, most: int) -> list[tuple[int, int]]:
    """Start and length of a word's segments, one more than the edits allowed: one of them survives any such edits."""
    size, more = divmod(length, most + 1)
    lengths = [size + (i >= most + 1 - more) for i in range(most + 1)]
    return [(sum(lengths[:i]), n) for i, n in enumerate(lengths)]


def shard_keys(word: str) -> set[str]:
    """Shards that hold a word: its segments by place and length of the word. A swap over the border of two segments
    breaks both, so they are also taken from the word with that swap undone."""
    most = bound(len(word))
    if not most:
        return set()
    cuts = _cuts(len(word), most)
    keys = {f"{len(word)}:{i}:{word[a : a + n]}" for i, (a, n) in enumerate(cuts)}
    for i, (b, _) in enumerate(cuts[1:], 1):
        turned = word[: b - 1] + word[b] + word[b - 1] + word[b + 1 :]
        keys |= {f"{len(word)}:{j}:{turned[cuts[j][0] : cuts[j][0] + cuts[j][1]]}" for j in (i - 1, i)}
    return keys


def asked_keys(word: str) -> set[str]:
    """Shards in which a word looks for words of its own length or less: its substrings where a surviving segment can be."""
    keys = set()
    for length in range(max(3, len(word) - WORD_EDITS), len(word) + 1):
        most, more = bound(length), len(word) - length
        if not most or more > most:
            continue
        for i, (at, n) in enumerate(_cuts(length, most)):
            low, high = max(0, at - i, at + more - (most - i)), min(len(word) - n, at + i, at + more + (most - i))
            keys |= {f"{length}:{i}:{word[a : a + n]}" for a in range(low, high + 1)}
    return keys


def similar_words(words: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Pairs of different ``word`` values that are similar as written or folded: word < other, edits (1 to WORD_EDITS).

    Words are sharded by the segments of their folded form; a shard's words make a trie, which the automata of the
    words that may be similar walk. Shards without such words aren't built, larger ones than ``block`` are walked in
    blocks. Letters that folding made equal count one edit in all. Nulls, empty words and repeated ones give nothing.
    """

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = {(key, word, form, side) for word in frame["word"] for form in forms_of(word) for side, keys in ((True, shard_keys(form)), (False, asked_keys(form))) for key in keys}
            yield pd.DataFrame(list(rows), columns=["key", "word", "form", "indexed"])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()

        def shard(rows: list[tuple]) -> Iterator[tuple[str, str, int]]:
            owners: dict[str, list[str]] = {}
            for *_, word, form, indexed in rows:
                if indexed:
                    owners.setdefault(form, []).append(word)
            root = trie(list(owners))
            for *_, word, form, indexed in rows:
                if indexed:
                    continue
                for found, edits in within(root, form, WORD_EDITS):
                    if len(found) > len(form) or edits > bound(len(found)):
                        continue
                    for other in owners[found]:
                        pair = (word, other) if word < other else (other, word)
                        if word == other or (*pair, edits) in seen:
                            continue
                        seen.add((*pair, edits))
                        cost = min(edits_between(*pair, WORD_EDITS), edits + ((word, other) != (form, found)))
                        if cost <= WORD_EDITS:
                            yield *pair, cost

        rows = (row for frame in frames for row in frame[["key", "i", "j", "word", "form", "indexed"]].itertuples(index=False, name=None))
        out: list[tuple] = []
        for _, group in groupby(rows, key=lambda r: r[:3]):
            out += shard(list(group))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["word", "other", "edits"])
                out.clear()
                seen.clear()
        yield pd.DataFrame(out, columns=["word", "other", "edits"])

    spark = words.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = words.where("word <> ''").select("word").distinct()
    rows = cut(distinct.mapInPandas(spread, "key string, word string, form string, indexed boolean"))
    sizes = rows.groupBy("key").agg(F.count_if("indexed").alias("held"), F.count_if(~F.col("indexed")).alias("asked"), F.min("word").alias("a"), F.max("word").alias("b"))
    sizes = sizes.where("held > 0 and asked > 0 and a <> b").select("key", F.ceil(F.col("held") / block).cast("int").alias("ni"), F.ceil(F.col("asked") / block).cast("int").alias("nj"))
    placed = rows.join(sizes, "key")
    own = F.pmod(F.xxhash64("word", "form"), F.when(F.col("indexed"), F.col("ni")).otherwise(F.col("nj"))).cast("int")
    every = F.sequence(F.lit(0), F.when(F.col("indexed"), F.col("nj")).otherwise(F.col("ni")) - 1)
    placed = placed.select("key", "word", "form", "indexed", own.alias("own"), F.explode(every).alias("other"))
    placed = placed.select("key", F.when(F.col("indexed"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("indexed"), F.col("other")).otherwise(F.col("own")).alias("j"), "word", "form", "indexed")
    shards = placed.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return shards.mapInPandas(walk, "word string, other string, edits int").groupBy("word", "other").agg(F.min("edits").alias("edits"))


def _tokens(name: str) -> tuple[list[str], str | None, bool]:
    """Words of a name (family name behind given name where a comma turned them), its legal form, and whether a place follows."""
    s = re.sub(r"['’]s$", "", plain(name).strip())
    s, place = re.sub(r"\([^)]*\)", " ", s), "(" in s
    s = re.sub(r"\bs\.\s?a\b\.?", "sa", s).replace("&", " and ")
    s = re.sub(r"^(?:the|a|an)\s+", "", s.strip())
    turned = s.split(",")
    if len(turned) == 2 and turned[1].strip().rstrip(".") not in LEGAL_FORMS:
        s = f"{turned[1]} {turned[0]}"
    words = [w.strip(".,;:\"'") for w in s.split()]
    words = [w for w in words if w and w not in _TITLES]
    legal = next((LEGAL_FORMS[w] for w in reversed(words[1:]) if w in LEGAL_FORMS), None)
    return [w for i, w in enumerate(words) if i == 0 or w not in LEGAL_FORMS], legal, place


def shortens(short: str, word: str) -> bool:
    """Whether a word may be short for another: the same first letter, and its letters in order in the other."""
    letters = iter(word)
    return 2 < len(short) < len(word) and short[0] == word[0] and all(c in letters for c in short)


def likeness(short: str, word: str) -> int:
    """Letters that two words begin with in common."""
    return len(commonprefix((short, word)))


def trade_forms(counts: dict[str, int]) -> dict[str, str]:
    """Each trade's full form: a more frequent trade that it may be short for or is a variant of, the likest one, or itself."""
    out = {}
    for word, n in counts.items():
        better = [w for w, m in counts.items() if m > n and (shortens(word, w) or edits_between(fold(word), fold(w), bound(min(len(word), len(w)))) <= bound(min(len(word), len(w))))]
        out[word] = max(better, key=lambda w: (likeness(word, w), counts[w], w), default=word)
    for word in sorted(counts, key=lambda w: -counts[w]):  # a short form may be short for a variant
        out[word] = out[out[word]]
    return out


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for id_, source, name, kind, weight in frame.itertuples(index=False):
            words, legal, place = _tokens(name)
            rows.append((id_, source, kind, weight, words, legal, bool(legal) or place or kind == "org"))
        yield pd.DataFrame(rows, columns=["id", "source", "type", "weight", "words", "legal", "firm"])


class Trades:
    """The known trades; ``of`` gives a word's trade in its full form, misspelt and shortened ones included."""

    def __init__(self, forms: dict[str, str]):
        self.forms, self.known = forms, dict(forms)
        self.by_fold: dict[str, set[str]] = {}
        for word, full in forms.items():
            self.by_fold.setdefault(fold(word), set()).add(full)
        self.root = trie(list(self.by_fold))

    def of(self, word: str) -> str | None:
        if word not in self.known:
            folded = fold(word)
            near = {full for w, edits in within(self.root, folded, WORD_EDITS) if edits <= bound(min(len(w), len(folded))) for full in self.by_fold[w]}
            short = {full for full in self.forms.values() if shortens(word, full)}
            most = max((likeness(word, full) for full in short), default=0)
            near = near or {full for full in short if likeness(word, full) == most}
            self.known[word] = near.pop() if len(near) == 1 else None
        return self.known[word]


def two_words(words: list[str], firm: bool, kind: str | None, trades: Trades) -> tuple[str, str, str]:
    """A name's two words, the smaller one first, and the words between them.

    Of a firm: its first word that is no trade and, behind TRADE, the others, trades in their full form. Of a person:
    the first and the last word, or a word and an initial. A name of one word has an empty other one.
    """
    if firm or (kind != "person" and any(w in trades.forms for w in words)):
        known = [(w, trades.of(w)) for w in words if w != "and"]
        at = next((i for i, (_, t) in enumerate(known) if t is None), 0)
        return (known[at][0], TRADE + " ".join(t or w for i, (w, t) in enumerate(known) if i != at), "") if known else ("", "", "")
    full = [w for w in words if len(w) > 1]
    if len(full) >= 2:
        return *sorted((full[0], full[-1])), " ".join(full[1:-1])
    if not full:
        return "", "", ""
    return *sorted((full[0], next((w for w in words if len(w) == 1), ""))), ""


def named(entities: DataFrame, facts: DataFrame | None) -> DataFrame:
    """Names and aliases of entities in two words: id, source (name or alias), a, b (a < b, or a the stem and b the
    trade), legal, weight. The weight is one more than the facts that name the entity as subject or object; without
    ``facts`` the stored count stands in. Places and unusable names are left out."""
    rows = entities.where("id is not null").select("id", "name", "type", F.coalesce("fact_count", F.lit(0)).cast("bigint").alias("stored"), F.coalesce("aliases", F.lit("")).alias("aliases"))
    if facts is None:
        rows = rows.withColumn("weight", F.col("stored") + 1)
    else:
        ends = facts.select(F.explode(F.array(norm_entity(F.col("subject")), norm_entity(F.col("object")))).alias("id"))
        counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(counts, "id", "left").withColumn("weight", F.coalesce("n", F.lit(0)) + 1)
    spelled = F.concat(F.array(F.struct(F.lit("name").alias("source"), F.col("name").alias("spelling"))), F.transform(F.split("aliases", r"\|"), lambda x: F.struct(F.lit("alias").alias("source"), x.alias("spelling"))))
    names = rows.where("coalesce(type, '') <> 'place'").select("id", "type", "weight", F.inline(spelled)).where("trim(spelling) <> ''")
    schema = "id string, source string, type string, weight bigint, words array<string>, legal string, firm boolean"
    parsed = cut(names.select("id", "source", "spelling", "type", "weight").mapInPandas(_parse, schema))
    firms = parsed.where("firm and source = 'name'")
    seen = firms.select(F.posexplode("words").alias("at", "word")).groupBy("word").agg(F.avg((F.col("at") == 0).cast("int")).alias("first"), F.count(F.lit(1)).alias("n"))
    often = max(LEAST, firms.count() * TRADE_SHARE)
    common = seen.where((F.col("n") >= often) & (F.col("first") <= 0.5) & (F.col("word") != "and") & (F.length("word") > 2)).select("word", "n")
    forms = trade_forms({r.word: r.n for r in common.collect()})  # bounded by TRADE_SHARE

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trades = Trades(forms)
        for frame in frames:
            found = [two_words(list(words), firm, kind, trades) for words, firm, kind in zip(frame["words"], frame["firm"], frame["type"], strict=True)]
            out = pd.DataFrame(found, columns=["a", "b", "middle"], dtype=object)
            yield pd.concat([frame[["id", "source", "legal", "weight"]].reset_index(drop=True), out], axis=1)

    return parsed.mapInPandas(part, "id string, source string, legal string, weight bigint, a string, b string, middle string").where("a <> '' or b <> ''")


def _node(a: str = "a", b: str = "b"):
    return F.concat_ws("\t", F.least(a, b), F.greatest(a, b))


def usage(nodes: DataFrame) -> DataFrame:
    """With how many different words each word stands: word, n. ``nodes`` has each pair once, so nothing is distinct anew."""
    return nodes.select(F.explode(F.array("a", "b")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def better_words(words: DataFrame) -> DataFrame:
    """What a word may be a variant of: word, other, edits. ``words``: word, n (with how many others it stands).

    The other one stands with more words, or with as many and comes first; two that are both in use are no variants.
    Short forms of given names lead to the full ones at no cost, and a word to itself.
    """
    spark = words.sparkSession
    names = spark.createDataFrame([(w,) for w in sorted({*GIVEN, *SHORT_FORMS})], "word string").withColumn("given", F.lit(True))
    short = [(s, f, 0) for s, forms in SHORT_FORMS.items() for f in forms]
    words = cut(words.join(F.broadcast(names), "word", "left"))
    near = similar_words(words.where(F.length("word") > 1))
    near = near.join(words.select("word", "n", "given"), "word").join(words.select(F.col("word").alias("other"), F.col("n").alias("m"), F.col("given").alias("given2")), "other")
    both = (F.least("n", "m") >= F.greatest(F.lit(LEAST), F.greatest("n", "m") * USE_SHARE)) | (F.coalesce("given", F.lit(False)) & F.coalesce("given2", F.lit(False)))
    up = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("word")))
    near = near.where(~both).select(F.when(up, F.col("word")).otherwise(F.col("other")).alias("word"), F.when(up, F.col("other")).otherwise(F.col("word")).alias("other"), "edits")
    formal = spark.createDataFrame(short, "word string, other string, edits int")
    return near.union(formal).union(words.select("word", F.col("word"), F.lit(0))).groupBy("word", "other").agg(F.min("edits").alias("edits"))


def same_names(entities: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Groups of entities: id, group. Entities without a usable name aren't given; one that is alone is its own group.

    A person's middle names don't count, unless the same first and last word stand around several different ones. An
    initial, or a name of one word, joins the only group that it can mean. An alias counts if it shares a word with the
    name or is another entity's name. Null and repeated rows, ties and empty tables have the same result in any order.
    """
    names = cut(named(entities, facts).distinct())
    middles = names.where("middle <> ''").groupBy("a", "b").agg(F.min("middle").alias("m1"), F.max("middle").alias("m2")).where("m1 <> m2").select("a", "b", F.lit(True).alias("several"))
    names = names.join(middles, ["a", "b"], "left").withColumn("a", F.when(F.col("several") & (F.col("middle") != ""), F.concat_ws(" ", "a", "middle")).otherwise(F.col("a")))
    names = cut(names.select("id", "source", "weight", "legal", "a", "b", _node().alias("node")))
    own, alias = names.where("source = 'name'"), names.where("source = 'alias'")
    known = own.select("id", F.col("node").alias("own"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    shares = F.arrays_overlap(F.filter(F.array("a", "b"), lambda w: F.length(w) > 1), F.array("a1", "b1"))
    full = lambda a, b: (F.length(a) > 1) & (F.length(b) > 1)
    alias = alias.join(known, "id").where((F.col("node") != F.col("own")) & full("a", "b"))
    alias = alias.join(own.select("node").distinct().withColumn("real", F.lit(True)), "node", "left").where(shares | F.col("real"))
    alias = cut(alias.select("own", "node", "a", "b", (~full("a1", "b1")).alias("initial")).distinct())
    nodes = own.groupBy("node", "a", "b").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("rows"), F.collect_set("legal").alias("legal"))
    extra = alias.select("node", "a", "b").distinct().join(nodes.select("node"), "node", "left_anti").select("*", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.array().cast("array<string>"))
    nodes = cut(nodes.union(extra))
    better = cut(better_words(usage(nodes)))

    whole = nodes.where(full("a", "b"))
    to = lambda c: better.select(F.col("word").alias(c), F.col("other").alias(f"{c}2"), F.col("edits").alias(f"{c}_edits"))
    keys = whole.join(to("a"), "a").join(to("b"), "b").where(F.col("a_edits") + F.col("b_edits") <= NAME_EDITS)
    keys = keys.select("node", _node("a2", "b2").alias("key"), (F.col("a_edits") + F.col("b_edits")).alias("edits"), "weight", "rows", "legal")
    keys = cut(keys.groupBy("node", "key").agg(F.min("edits").alias("edits"), F.first("weight").alias("weight"), F.first("rows").alias("rows"), F.first("legal").alias("legal")))
    first = keys.groupBy("key").agg(F.min_by("node", F.struct(-F.col("weight"), F.col("node"))).alias("heaviest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    real = nodes.select(F.col("node").alias("key"), F.col("weight").alias("w2"), F.col("rows").alias("rows2"), F.col("legal").alias("legal2"))
    found = keys.where("node <> key").join(first, "key", "left").join(real, "key", "left")
    unlike = (F.size("legal") > 0) & (F.size("legal2") > 0) & ~F.arrays_overlap("legal", "legal2")
    found = found.where((F.col("edits") == 0) | ~F.coalesce(unlike | ((F.col("edits") >= 2) & (F.least("rows", "rows2") >= LEAST)), F.lit(False)))
    parent = F.when(F.col("w2").isNotNull(), F.col("key")).when(F.col("heaviest") != F.col("node"), F.col("heaviest"))
    found = found.select("node", parent.alias("parent"), F.when(F.col("w2").isNull(), 10).otherwise(0) + F.col("edits"), F.coalesce("w2", F.lit(0)).alias("w2")).toDF("node", "parent", "cost", "w2").where("parent is not null")
    linked = alias.select(F.col("own").alias("a"), F.col("node").alias("b"))
    best = found.groupBy("node").agg(F.min_by("parent", F.struct("cost", -F.col("w2"), "parent")).alias("parent"))
    roots = cut(linked_groups(nodes.select("node"), best.select("node", "parent").toDF("a", "b").union(linked)))

    placed = whole.join(roots, "node").select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("x"), "root").select("x.*", "root")
    placed = placed.select("word", F.explode(F.array(F.substring("other", 1, 1), F.lit(""))).alias("letter"), "root").groupBy("word", "letter").agg(F.min("root").alias("root"), F.max("root").alias("last"))
    short = nodes.where(~full("a", "b")).join(alias.where("initial").select(F.col("own").alias("node")).distinct(), "node", "left_anti")
    word, letter = F.when(F.length("a") > 1, F.col("a")).otherwise(F.col("b")), F.when(F.length("a") > 1, F.col("b")).otherwise(F.col("a"))
    short = short.select("node", word.alias("own_word"), letter.alias("letter"))
    ways = better.union(better.select("other", "word", "edits")).distinct().select(F.col("word").alias("own_word"), F.col("other").alias("word"), "edits")
    meant = short.join(ways, "own_word").join(placed, ["word", "letter"]).groupBy("node", "edits").agg(F.min("root").alias("root"), F.max("last").alias("last"))
    meant = meant.groupBy("node").agg(F.min_by(F.struct("root", "last"), "edits").alias("m")).where("m.root = m.last").select("node", F.col("m.root").alias("meant"))
    groups = roots.join(meant, "node", "left").select("node", F.coalesce("meant", "root").alias("group"))
    return own.select("id", "node").join(groups, "node").groupBy("id").agg(F.min("group").alias("group"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of each group; a group is the spellings of one name, so its pairs are what is asked for."""
    groups = cut(same_names(table(spark, sf_dir, "entities"), table(spark, sf_dir, "facts")))
    a, b = groups.select("group", F.col("id").alias("id_a")), groups.select("group", F.col("id").alias("id_b"))
    return a.join(b, "group").where("id_a < id_b").select("id_a", "id_b")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = same_names(table(spark, sf_dir, "entities"), table(spark, sf_dir, "facts"))
    size = groups.groupBy("group").agg(F.count(F.lit(1)).alias("spellings"))
    return groups.join(size, "group").select("id", "group", "spellings")


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
SQL: dict[str, str] = {}
