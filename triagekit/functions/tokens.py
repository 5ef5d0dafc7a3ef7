"""Tokenisation and chunking as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_urls

# Fixed values.
# A token is a run of letters/digits or a single other non-space character.
# Whitespace is spelled out so Java and RE2 engines agree on it.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0B\f\r]"
CHUNK_SIZE = 512


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text) -> Column:
    """Lower-cased tokens of the text (array<string>), whole text."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def clean_tokens(text) -> Column:
    """Tokens after URL removal — the embedding pipeline's preprocessing."""
    return tokenize(strip_urls(F.coalesce(_c(text), F.lit(""))))


def n_chunks(n_tokens, size: int = CHUNK_SIZE) -> Column:
    """Number of chunks: ceil(n / size); 0 tokens give no chunk."""
    n = _c(n_tokens)
    return F.when(n <= 0, F.lit(0)).otherwise(F.ceil(n / F.lit(size))).cast("int")


def chunk_array(arr, size: int = CHUNK_SIZE) -> Column:
    """Split an array into consecutive runs of ``size`` (last may be shorter)."""
    a = _c(arr)
    k = n_chunks(F.size(a), size)
    # k = 0 yields an empty array: sequence(0, -1) counts down, so guard it.
    return F.filter(
        F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))),
                    lambda i: F.slice(a, i * size + 1, size)),
        lambda c: F.size(c) > 0)
