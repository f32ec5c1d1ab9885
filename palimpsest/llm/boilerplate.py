"""Main content of web pages, told from their sites' wrappers (problem 3).

A page is a stream of line tokens. The streams of one host are aligned one after another; mismatches become optional
tokens, repeated groups and text slots of a union-free expression, the host's wrapper. Each page is matched against it:
what recurs at its place in the wrapper is the site's own text, and the article is what fills the slots below the
headline. Hosts with few pages borrow the support that a token has in the wrappers of the other hosts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import is_blank
from palimpsest.session import cut
from palimpsest.sources.tables import table

#: Pages aligned in one task; a larger host is inferred in blocks whose supports are added up.
BLOCK_PAGES = 48
#: A host with so many pages has a wrapper of its own; what recurs at its place is the site's from this share of the pages on.
#: A token that is rarely a site's elsewhere (such as a heading or common advice) needs the larger share.
OWN_PAGES, OWN_SHARE, SURE_SHARE, RARE_SHARE = 4, 0.3, 0.6, 0.2
#: A token is a site's anywhere if it has this mean share in the hosts of MANY_PAGES, or holds a slot and is on SLOT_HOSTS hosts.
MANY_PAGES, MEAN_SHARE, SLOT_HOSTS = 6, 0.22, 3
#: Words of a heading inside an article; longer lines without an end are titles of other pages.
HEADING_WORDS = 3
#: A node of the wrapper is fixed at its place from this share of the pages on. Nodes that one page alone had are slots after so many more.
FIXED_SHARE, PRUNE_EVERY = 0.5, 8
#: A token is at home where this part of its occurrences is, above, in or below the text slot; elsewhere it is text.
HOME_SHARE = 0.05
#: Longest group whose immediate repetition is a repeated group.
GROUP_LINES = 3
#: Parts that the rows of one host or token are spread over in joins.
SALTS = 8

_BULLET = r"^(?:[*•>#·–-]+|\d{1,2}[.)])\s+"
SLOT = "⟨text⟩"


def host_of(url: Column, ref: Column) -> Column:
    """Host in lower case without www and port, from the url or from the ref that holds it."""
    whole = F.coalesce(url, F.regexp_replace(ref, "^url:", ""))
    return F.regexp_replace(F.lower(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def line_token(line: Column) -> Column:
    """A line as a token: lower case, without bullet and with single blanks."""
    s = F.trim(F.regexp_replace(F.lower(line), r"[\s\p{Z}]+", " "))
    return F.regexp_replace(s, _BULLET, "")


def pages_of(chunks: DataFrame) -> DataFrame:
    """One row per ref: ref, host, title, text, pages (of the host), block. Of a page read again the last read counts."""
    rows = chunks.where("ref is not null and text is not null")
    read = F.struct("text", "title", "url")
    order = F.struct(F.coalesce("fetched_at", F.lit(0.0)), F.col("text"), F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")))
    pages = rows.groupBy("ref").agg(F.max_by(read, order).alias("x"), F.max("title").alias("any_title"), F.max("url").alias("any_url"))
    pages = pages.select("ref", F.coalesce("x.title", "any_title").alias("title"), "x.text", host_of(F.coalesce("x.url", "any_url"), F.col("ref")).alias("host"))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pages = pages.withColumn("salt", F.pmod(F.xxhash64("ref"), F.lit(SALTS)).cast("int")).join(sizes, ["host", "salt"]).drop("salt")
    return pages.withColumn("block", F.pmod(F.xxhash64("ref", F.lit(1)), F.ceil(F.col("pages") / BLOCK_PAGES)))


def page_lines(pages: DataFrame) -> DataFrame:
    """Lines of pages that aren't blank: ref, host, title, pages, block, line_no, line, bullet, token (text).

    In a token numbers are 0 and the host is {h}; long text behind a short label or before a short link is a slot.
    """
    lines = pages.select("ref", "host", "title", "pages", "block", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(~is_blank(F.col("line")))
    lines = lines.withColumn("line", F.regexp_replace("line", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    lines = lines.withColumn("bullet", F.col("line").rlike(_BULLET))
    lines = lines.withColumn("token", line_token(F.col("line")))
    lines = lines.withColumn("token", F.when(F.length("host") > 3, F.expr("replace(replace(token, host, '{h}'), 'www.{h}', '{h}')")).otherwise(F.col("token")))
    lines = lines.withColumn("token", F.regexp_replace("token", r"\d+", "0"))
    long = F.size(F.split("token", " ")) > 6
    label = F.regexp_extract("token", r"^((?:[^\s:]+ ){0,3}[^\s:]+ ?: )\S", 1)
    link = F.regexp_extract("token", r"(… ?(?:\S+ ){0,2}\S+)$", 1)
    return lines.withColumn("token", F.when(long & (link != ""), F.concat(F.lit(SLOT), link)).when(long & (label != ""), F.concat(label, F.lit(SLOT))).otherwise(F.col("token")))


def without_repeats(tokens: list) -> list[tuple[object, int, int]]:
    """(token, times, line) of a stream in which a group that follows itself at once stands only once."""
    out, at = [], 0
    while at < len(tokens):
        for size in range(1, GROUP_LINES + 1):
            times = 1
            while tokens[at : at + size] == tokens[at + times * size : at + (times + 1) * size] and at + times * size < len(tokens):
                times += 1
            if times > 1:
                break
        size = size if times > 1 else 1
        out += [(tokens[at + i], times, at + i) for i in range(size)]
        at += size * times
    return out


class Wrapper:
    """Union-free expression of a host's pages: fixed and optional tokens, repeated groups, and text slots between them."""

    def __init__(self, pages: list[list]):
        self.pages = len(pages)
        streams = [without_repeats(p) for p in pages]
        nodes: list[list] = []  # token, support, last page, most times in a row
        for number, stream in enumerate(streams):
            nodes = self._with(nodes, stream, number)
            if number % PRUNE_EVERY == PRUNE_EVERY - 1:
                nodes = [n for n in nodes if n[1] > 1 or n[2] > number - PRUNE_EVERY]
        self.fixed = [n for n in nodes if n[1] >= max(2, FIXED_SHARE * self.pages)]
        matched = [self._match(p) for p in pages]
        often = Counter(t for p in pages for t in set(p))
        free = Counter(gap for p, m in zip(pages, matched, strict=True) for t, (node, gap) in zip(p, m, strict=True) if node is None and often[t] < max(2, OWN_SHARE * self.pages))
        self.slot = max(free, key=lambda g: (free[g], -g), default=0)  # the slot that most of the pages' own lines fill
        self.places = [[self._region(node, gap) for node, gap in m] for m in matched]
        self.inside: dict[int, Counter] = defaultdict(Counter)
        for p, where in zip(pages, self.places, strict=True):
            self.inside.update({r: self.inside[r] + Counter({t for t, x in zip(p, where, strict=True) if x == r}) for r in set(where)})

    def _with(self, nodes: list[list], stream: list[tuple], number: int) -> list[list]:
        """The nodes after one more page: aligned ones gain support, the page's others go in at their place."""
        out: list[list] = []
        for _, a, b, c, d in SequenceMatcher(None, [n[0] for n in nodes], [t for t, *_ in stream], autojunk=False).get_opcodes():
            same = b - a == d - c and [n[0] for n in nodes[a:b]] == [t for t, *_ in stream[c:d]]
            for node, (_, times, _) in zip(nodes[a:b], stream[c:d] if same else [(0, 0, 0)] * (b - a), strict=True):
                out.append([node[0], node[1] + same, number if same else node[2], max(node[3], times)])
            out += [] if same else [[t, 1, number, times] for t, times, _ in stream[c:d]]
        return out

    def _match(self, page: list) -> list[tuple[int | None, int]]:
        """For each line its fixed node, if it stands for one, and the last fixed node up to it."""
        stream = without_repeats(page)
        node: dict[int, int] = {}
        for i, j, n in SequenceMatcher(None, [x[0] for x in self.fixed], [t for t, *_ in stream], autojunk=False).get_matching_blocks():
            node.update({stream[j + k][2]: i + k for k in range(n)})
        out, last, group = [], -1, {}
        for token, times, line in stream:
            if times > 1 and line in node:
                group[token] = node[line]
        for line, token in enumerate(page):
            found = node.get(line, group.get(token) if out and out[-1][0] is not None else None)
            last = found if found is not None and found > last else last
            out.append((found, last))
        return out

    def _region(self, node: int | None, gap: int) -> int:
        """0 above the text slot, 1 in it, 2 below."""
        if node is not None:
            return 0 if node <= self.slot else 2
        return 0 if gap < self.slot else 1 if gap == self.slot else 2

    def expression(self) -> str:
        """Tokens, (optional)?, (repeated)+ and slots, a slot with the tokens that recur in it: [text a? b?]."""
        often = sorted(str(t) for t, n in self.inside[1].items() if n >= max(2, OWN_SHARE * self.pages))
        slot = "[" + " ".join(["text", *(f"{t}?" for t in often)]) + "]"
        parts = [slot] if self.slot < 0 and self.pages else []  # above all fixed tokens
        for i, (token, support, _, times) in enumerate(self.fixed):
            parts.append(f"({token}){'+' if times > 1 else '?'}" if times > 1 or support < self.pages else str(token))
            if i == self.slot:
                parts.append(slot)
        return " ".join(parts)


def placed_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (host, block, ref, line_no, token as a number) matched against their wrapper: host, ref, line_no, token,
    region (0 above the text slot, 1 in it, 2 below), first (the token's first line of the page in that region)."""

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ref", "line_no"])
        wrapper = Wrapper([x.tolist() for _, x in rows.groupby("ref", sort=False)["token"]])
        rows = rows.assign(region=[r for where in wrapper.places for r in where])
        return rows.assign(first=~rows.duplicated(["ref", "region", "token"]))[["host", "ref", "line_no", "token", "region", "first"]]

    return lines.groupBy("host", "block").applyInPandas(place, "host string, ref string, line_no int, token bigint, region int, first boolean")


def article_lines(chunks: DataFrame) -> DataFrame:
    """Lines of the articles: ref, line_no, line. Pages without text, without a headline or with nothing
    but their site's text below it have none. Null urls and titles, repeated reads and empty tables are allowed."""
    lines = cut(page_lines(pages_of(chunks)).withColumn("id", F.xxhash64("token")))
    several = lines.select("host", "block", "pages", "ref", "line_no", F.col("id").alias("token"))
    placed = cut(placed_lines(several.where(f"pages >= {OWN_PAGES}").drop("pages")).union(several.where(f"pages < {OWN_PAGES}").select("host", "ref", "line_no", "token", F.lit(1), F.lit(True))))
    sizes = lines.groupBy("host").agg(F.max("pages").alias("pages"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64("ref"), F.lit(SALTS)).cast("int")
    support = cut(placed.groupBy("host", "region", "token").agg(F.count_if("first").alias("support")).join(sizes, "host"))
    anywhere = support.groupBy("host", "token").agg(F.least(F.sum("support") / F.max("pages"), F.lit(1.0)).alias("share"), F.sum("support").alias("all"), F.max("pages").alias("pages"))
    anywhere = cut(anywhere)
    shared = anywhere.groupBy("token").agg(F.avg(F.when(F.col("pages") >= MANY_PAGES, F.col("share"))).alias("mean_share"), F.count(F.lit(1)).alias("hosts"))
    shared = shared.where(f"mean_share >= {MEAN_SHARE} or hosts >= {SLOT_HOSTS}").withColumn("salt", salts)
    own = support.where(f"pages >= {OWN_PAGES} and support > 1").join(anywhere.where("all > 1").select("host", "token", "share", "all"), ["host", "token"])
    own = own.where(F.col("support") >= HOME_SHARE * F.col("all")).select("host", "region", "token", "share", salts.alias("salt"))
    bare = F.regexp_replace(F.lower(F.trim("title")), r"\s+[-–|]\s+\S*\.\S+$", "")
    titles = lines.groupBy("ref").agg(F.first("title").alias("title")).select(F.xxhash64(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"\d+", "0")).alias("token")).where("token is not null").distinct()
    judged = placed.withColumn("salt", salt).join(own, ["host", "region", "token", "salt"], "left").join(shared, ["token", "salt"], "left").select("ref", "line_no", "share", "mean_share", "hosts")
    lines = lines.drop("block").join(judged, ["ref", "line_no"]).join(titles.withColumnRenamed("token", "id").withColumn("is_title", F.lit(True)), "id", "left")
    is_title = F.coalesce("is_title", F.lit(False))
    ended = F.col("line").rlike(r"[.!?]$")
    words = F.size(F.split("token", " "))
    slotted = F.col("token").rlike(rf"0|\{{h\}}|{SLOT}|^\S+ ?: ") & (~ended | F.col("token").contains(SLOT)) & (F.coalesce("hosts", F.lit(0)) >= SLOT_HOSTS) & ~F.col("bullet")
    rare = (F.coalesce("hosts", F.lit(0)) >= SLOT_HOSTS) & (F.coalesce("mean_share", F.lit(0.0)) < RARE_SHARE)
    path = F.col("line").rlike(r"^(?:[^|»>/]{1,24}\s*[|»>/]\s*)+[^|»>/]{1,24}$") & ~F.col("bullet") & ~ended
    at_home = (F.col("pages") < OWN_PAGES) | F.col("share").isNotNull()
    borrowed = at_home & (F.coalesce("mean_share", F.lit(0.0)) >= MEAN_SHARE)
    recurs = F.coalesce("share", F.lit(0.0)) >= F.when(rare, SURE_SHARE).otherwise(OWN_SHARE)
    of_site = ~is_title & (path | recurs | borrowed | slotted)
    own_title = F.lower(F.regexp_replace(F.regexp_replace("title", r"\s+[-–|]\s+\S*\.\S+\s*$", ""), r"\s+", " "))
    says_title = F.lower(F.regexp_replace("line", r"\s+", " ")) == F.trim(own_title)
    capital = F.col("line").rlike(r"^[\p{Lu}\d¿¡]")
    title_like = ~F.col("bullet") & ~ended & capital & (is_title | (words > HEADING_WORDS))
    lines = lines.select("ref", "line_no", "line", "title", of_site.alias("of_site"), says_title.alias("says_title"), title_like.alias("title_like"))
    page = Window.partitionBy("ref")
    first = F.min(F.when(F.col("says_title"), F.col("line_no"))).over(page)
    guess = F.min(F.when(F.col("title").isNull() & F.col("title_like") & ~F.col("of_site"), F.col("line_no"))).over(page)
    lines = lines.withColumn("head", F.coalesce(first, guess))
    below = (F.col("line_no") > F.col("head")) & ~F.col("of_site") & ~F.col("title_like")
    headed = lines.withColumn("text", F.max(below).over(page)).where("text and line_no >= head")
    return headed.where((F.col("line_no") == F.col("head")) | (~F.col("of_site") & ~F.col("title_like"))).select("ref", "line_no", "line")


def wrappers(chunks: DataFrame) -> DataFrame:
    """The wrapper of each host with OWN_PAGES or more, by block: host, block, pages, expression."""

    def infer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ref", "line_no"])
        wrapper = Wrapper([list(x) for _, x in rows.groupby("ref", sort=False)["token"]])
        return pd.DataFrame({"host": [key[0]], "block": [int(key[1])], "pages": [wrapper.pages], "expression": [wrapper.expression()]})

    lines = page_lines(pages_of(chunks)).where(f"pages >= {OWN_PAGES}").select("host", "block", "ref", "line_no", "token")
    return lines.groupBy("host", "block").applyInPandas(infer, "host string, block bigint, pages bigint, expression string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_lines(table(spark, sf_dir, "chunks")).select("ref", F.col("line_no").cast("bigint").alias("line_no"))


def p3_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page's article."""
    found = article_lines(table(spark, sf_dir, "chunks"))
    rows = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return found.groupBy("ref").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))


def p3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers(table(spark, sf_dir, "chunks"))


QUERIES = {"p3_found": p3_found, "p3_articles": p3_articles, "p3_wrappers": p3_wrappers}
SQL: dict[str, str] = {}
