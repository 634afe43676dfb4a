"""Retrieval metrics over arrays of retrieved and gold document ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is_gold(retrieved: Column, gold: Column) -> Column:
    return F.transform(retrieved, lambda d: F.array_contains(gold, d))


def hit(retrieved: Column, gold: Column) -> Column:
    return F.coalesce(F.arrays_overlap(retrieved, gold), F.lit(False))


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    first = F.array_position(_is_gold(retrieved, gold), True)
    return F.when(first > 0, 1.0 / first).otherwise(F.lit(0.0))


def context_precision(retrieved: Column, gold: Column) -> Column:
    """Share of retrieved positions that hold a gold document; repeats count again."""
    hits = F.size(F.filter(_is_gold(retrieved, gold), lambda g: g))
    return F.when(F.size(retrieved) == 0, F.lit(0.0)).otherwise(hits / F.size(retrieved))


def context_recall(retrieved: Column, gold: Column) -> Column:
    """Distinct gold documents found over the length of the gold list as given."""
    found = F.size(F.array_intersect(retrieved, gold))
    return F.when(F.size(gold) == 0, F.lit(0.0)).otherwise(found / F.size(gold))


def all_metrics(retrieved: Column, gold: Column) -> list[Column]:
    return [
        hit(retrieved, gold).alias("hit"),
        reciprocal_rank(retrieved, gold).alias("reciprocal_rank"),
        context_precision(retrieved, gold).alias("context_precision"),
        context_recall(retrieved, gold).alias("context_recall"),
    ]
