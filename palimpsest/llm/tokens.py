"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder and file of the tokenizer (ranks of a byte-level BPE); both are parameters.
FOLDER, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: how the public tokenizer cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters encoded at once; longer texts are cut at a blank, which no token spans but at its start.
CHUNK = 20_000

_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _count(encoding, text: str) -> int:
    n = at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > CHUNK:
            blank = text.rfind(" ", at + CHUNK // 2, at + CHUNK)
            stop = blank if blank > at and not text[blank - 1].isspace() else at + CHUNK
        n += len(encoding.encode_ordinary(text[at:stop]))
        at = stop
    return n


def token_count(text: Column, folder: str = FOLDER, ranks: str = RANKS) -> Column:
    """Tokens of each text; 0 for null and empty ones."""
    path = f"{folder}/{ranks}"

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = encoder(path)
        for batch in batches:
            yield pd.Series([_count(encoding, t) if t else 0 for t in batch], dtype="int64")

    return count(text)
