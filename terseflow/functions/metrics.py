"""Sizes of texts and what a reduction saves."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terseflow.semantics import bytes_of, words_of

#: A file of BPE ranks (base64 token, blank, rank). Without one tokens are approximated, and token_backend() says so.
RANKS_ENV = "TERSEFLOW_BPE_RANKS"
_PIECE = re.compile(r"'(?:[sdmt]|ll|ve|re)|[^\W\d_]+|\d{1,3}|[^\w\s]+|\s+", re.I)
_encoders: dict = {}


def token_backend(ranks: str | None = None) -> str:
    ranks = ranks or os.environ.get(RANKS_ENV)
    return f"ranks:{os.path.basename(ranks)}" if ranks else "approximate"


def approximate_tokens(text: str) -> int:
    """Deterministic estimate: a word counts one token for each started 6 letters beyond the first 7 bytes, blanks join the next word."""
    total = 0
    for m in _PIECE.finditer(text):
        piece = m[0]
        if piece.isspace():
            total += "\n" in piece
        elif piece[0].isalpha():
            size = len(piece.encode())
            total += 1 + max(0, size - 7 + 5) // 6
        else:
            total += 1 if piece[0].isdigit() else (len(piece.encode()) + 2) // 3
    return total


def _encoder(ranks: str):  # noqa: ANN202
    if ranks not in _encoders:
        import base64

        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        pattern = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
        _encoders[ranks] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[ranks]


def token_counts(text: Column, ranks: str | None = None) -> Column:
    """Tokens of a text by the given ranks, else approximated."""
    ranks = ranks or os.environ.get(RANKS_ENV)

    @F.pandas_udf(T.LongType())
    def count(column: pd.Series) -> pd.Series:
        if ranks:
            one = _encoder(ranks)
            return column.map(lambda t: None if t is None else len(one.encode_ordinary(t))).astype("Int64")
        return column.map(lambda t: None if t is None else approximate_tokens(t)).astype("Int64")

    return count(text)


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def with_stats(frame: DataFrame, input_col: str, output_col: str, name: str = "stats") -> DataFrame:
    """Adds the sizes of both columns as a struct. Tokens are counted once for each column."""
    tokens_in, tokens_out = token_counts(F.col(input_col)), token_counts(F.col(output_col))
    parts = {
        "inputBytes": bytes_of(F.col(input_col)),
        "outputBytes": bytes_of(F.col(output_col)),
        "inputWords": word_count(F.col(input_col)),
        "outputWords": word_count(F.col(output_col)),
        "inputApproxTokens": tokens_in,
        "outputApproxTokens": tokens_out,
    }
    return frame.withColumn(name, F.struct(*[c.alias(k) for k, c in parts.items()]))


def reduction_percent(before: Column, after: Column) -> Column:
    """Saved share in percent; null where there was nothing."""
    return F.when(before > 0, (before - after) * F.lit(100.0) / before)


def truncated(payload: Column, limit: int = 16 << 10) -> Column:
    """At most `limit` bytes, and how many are left out; a character that the limit cuts is left out whole."""
    size = bytes_of(payload)
    head = F.make_valid_utf8(F.substring(F.encode(payload, "utf-8"), 1, limit).cast("string"))
    clean = F.regexp_replace(head, "\ufffd+$", "")
    note = F.concat(F.lit("\n... [truncated "), (size - limit).cast("string"), F.lit(" bytes] ..."))
    return F.when((F.lit(limit) <= 0) | (size <= limit), payload).otherwise(F.concat(clean, note))
