"""JSON texts: canonical form, digests, equality, tolerant reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    """A JSON text with its objects' keys in order, at every depth, and without spaces; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def digest(text: Column) -> Column:
    """SHA-256 of a JSON text's canonical form, so texts that say the same have one digest; null if it isn't JSON."""
    return F.sha2(canonical(text), 256)


def same(a: Column, b: Column) -> Column:
    """Whether two JSON texts say the same, numbers compared as they are written; null equals null, and texts that aren't JSON nothing."""
    left, right = canonical(a), canonical(b)
    return F.when(a.isNull() & b.isNull(), True).otherwise(F.coalesce(left == right, F.lit(False)))


def parsed(text: Column, default: str = "null") -> Column:
    """A JSON text as a variant; the default, a JSON text too, where it is null, empty or broken."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit(default)))
