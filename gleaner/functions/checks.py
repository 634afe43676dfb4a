"""Assertions inside a plan: rows that cannot be completed end the job instead of vanishing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(value: Column, what: str, key: Column) -> Column:
    """``value``, which a left join brought; null is an error that names the key."""
    message = F.concat(F.lit(f"unknown {what}: "), F.coalesce(key.cast("string"), F.lit("null")))
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(message))


def same_width(query: Column, vector: Column, key: Column) -> Column:
    """``vector`` if it is as wide as ``query``; otherwise an error with both widths."""
    message = F.concat(
        F.lit("embedding dimension mismatch: query "), F.size(query).cast("string"),
        F.lit(", chunk "), key.cast("string"), F.lit(" "), F.size(vector).cast("string"),
    )
    return F.when(F.size(query) == F.size(vector), vector).otherwise(F.raise_error(message))
