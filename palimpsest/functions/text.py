"""Text and identity functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = chr(31)
#: Articles and possessives that don't count in a name.
ARTICLES = ("the", "a", "an", "my", "our", "his", "her", "their")
#: Character class of everything that shows nothing: white space, separators, zero-width and soft hyphen.
INVISIBLE = r"[\s\p{Z}­᠎​-‏⁠﻿]"


def sha_id(*parts: Column, n: int = 16) -> Column:
    """First ``n`` hex digits of SHA-1 over the parts, each followed by the unit separator; null if a part is."""
    pieces = [x for p in parts for x in (p.cast("string"), F.lit(UNIT))]
    return F.substring(F.sha1(F.concat(*pieces)), 1, n)


def norm_entity(name: Column) -> Column:
    """Entity id of a spelling: lower case, no leading article, no trailing possessive, single blanks, no outer
    punctuation. Null gives the empty string."""
    s = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", ""))
    s = F.regexp_replace(s, rf"^({'|'.join(ARTICLES)})\s+", "")
    s = F.regexp_replace(s, r"['’]s$", "")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.regexp_replace(s, r"^[ .,:;\"']+|[ .,:;\"']+$", "")


def norm_relation(relation: Column) -> Column:
    """Relation without copulas; the trimmed lower-case text if nothing else is in it."""
    s = F.lower(F.trim(F.coalesce(relation, F.lit(""))))
    bare = F.trim(F.regexp_replace(s, r"\b(is|are|was|were|has been|have been|will be|am)\b\s*", ""))
    bare = F.regexp_replace(bare, r"\s+", " ")
    return F.when(bare == "", F.coalesce(relation, F.lit(""))).otherwise(bare)


def is_blank(text: Column) -> Column:
    """Null, or nothing visible in it."""
    return text.isNull() | text.rlike(rf"^{INVISIBLE}*$")


def seconds(said: Column) -> Column:
    """Epoch seconds of a time that may be in milliseconds."""
    return F.when(F.abs(said) > 1e11, said / 1000).otherwise(said)
