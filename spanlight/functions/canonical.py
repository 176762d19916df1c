"""Canonical JSON: one text for one value, whatever the order of its keys and fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(*columns: Column | str) -> Column:
    """The columns as one JSON object with keys sorted at every depth, of structs and maps alike; nulls are kept.

    A variant holds its objects' fields in the order of their names, so writing one
    is all it takes.
    """
    return F.to_json(F.to_variant_object(F.struct(*columns)))


def canonical_text(json: Column) -> Column:
    """A JSON text without white space between tokens, its keys sorted at every depth, numbers in one form (1.50 as 1.5). Malformed texts and repeated keys are an error."""
    return F.to_json(F.parse_json(json))


def content_id(*columns: Column | str, digits: int = 64) -> Column:
    """The first hex digits of SHA-256 over the canonical JSON: equal for equal content."""
    return F.substring(F.sha2(canonical(*columns), 256), 1, digits)
