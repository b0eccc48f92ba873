"""Tokens, estimates and identifiers as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words to tokens.
TOKEN_FACTOR = 1.3


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, with `value` evaluated once a row.

    Catalyst may inline an expression into a lambda that uses it, which would evaluate it for every element; a lambda
    variable is never inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lexical_tokens(text: Column) -> Column:
    """Maximal runs of a-z0-9 in the lower-cased text; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for a null text."""
    return F.coalesce(F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), F.lit(0))


def token_estimate(text: Column) -> Column:
    """0 for a text without characters or a null, otherwise at least 1: the whole part of 1.3 times its words."""
    estimate = F.greatest(F.lit(1), F.floor(word_count(text) * F.lit(TOKEN_FACTOR)).cast("int"))
    return F.when(F.length(text) > 0, estimate).otherwise(F.lit(0))


def span_id(owner: Column, start: Column, end: Column, prefix: str = "") -> Column:
    """Stable 16-digit id of a span of a text."""
    parts = ([F.lit(prefix)] if prefix else []) + [owner, start.cast("string"), end.cast("string")]
    return F.substring(F.sha1(F.concat_ws(":", *parts)), 1, 16)
