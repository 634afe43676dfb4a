"""Failure labels as decision lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.metrics import context_precision, hit, reciprocal_rank

# The label names.
MISSING_EVIDENCE = "missing_evidence"
LOW_RANK_EVIDENCE = "low_rank_evidence"
DISTRACTOR_EVIDENCE = "distractor_evidence"
UNANSWERABLE = "unanswerable_query"
NO_FAILURE = "no_failure"
UNSUPPORTED_ANSWER = "unsupported_answer"
CITATION_MISMATCH = "citation_mismatch"


@dataclass(frozen=True)
class RetrievalThresholds:
    low_rank: int = 3
    distractor_precision: float = 0.5


@dataclass(frozen=True)
class AnswerThresholds:
    faithfulness: float = 0.5
    citation_support: float = 0.5


def failure_label(
    retrieved: Column, gold: Column, expected: Column,
    thresholds: RetrievalThresholds = RetrievalThresholds(),
) -> Column:
    """First rule that applies, from no gold at all to noisy context."""
    late = reciprocal_rank(retrieved, gold) < 1.0 / thresholds.low_rank
    noisy = context_precision(retrieved, gold) < thresholds.distractor_precision
    return (
        F.when((F.size(gold) == 0) & (expected == UNANSWERABLE), UNANSWERABLE)
        .when(F.size(gold) == 0, NO_FAILURE)
        .when(~hit(retrieved, gold), MISSING_EVIDENCE)
        .when(late, LOW_RANK_EVIDENCE)
        .when(noisy, DISTRACTOR_EVIDENCE)
        .otherwise(NO_FAILURE)
    )


def answer_label(
    faithfulness: Column, citation_support: Column,
    thresholds: AnswerThresholds = AnswerThresholds(),
) -> Column:
    return (
        F.when(faithfulness < thresholds.faithfulness, UNSUPPORTED_ANSWER)
        .when(citation_support < thresholds.citation_support, CITATION_MISMATCH)
        .otherwise(NO_FAILURE)
    )


def is_fixed(before: Column, after: Column) -> Column:
    return (before != NO_FAILURE) & (after == NO_FAILURE)


def is_moved(before: Column, after: Column) -> Column:
    return (before != NO_FAILURE) & (after != NO_FAILURE) & (before != after)


def outcome(before: Column, after: Column, expected: Column) -> Column:
    return (
        F.when(is_fixed(before, after), "FIXED").when(is_moved(before, after), "MOVED")
        .when(before == expected, "CONFIRMED").otherwise("UNCHANGED")
    )
