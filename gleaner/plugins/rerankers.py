"""Second-pass scorers: each adds ``post_score`` to (query_id, question, chunk_id, text, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import broadcast_if_small

# The pinned default model.
DEFAULT_RERANKER_MODEL = "cross-encoder/ms-marco-MiniLM-L-6-v2"
DEFAULT_RERANKER_REVISION = "c5ee24cb16019beea0893ab7796b1df96625c6b8"


class Reranker:
    name = "custom"

    def score(self, candidates: DataFrame) -> DataFrame:
        raise NotImplementedError


class KeepOrder(Reranker):
    """Leaves scores and ranks as they are."""

    name = "fake"

    def score(self, candidates: DataFrame) -> DataFrame:
        return candidates.withColumn("post_score", F.col("score").cast("double"))


class ScoreTable(Reranker):
    """Scores from a (chunk_id, post_score) table; chunks it lacks score zero."""

    name = "fake"

    def __init__(self, scores: DataFrame) -> None:
        self.scores = scores

    def score(self, candidates: DataFrame) -> DataFrame:
        table = broadcast_if_small(self.scores.select("chunk_id", "post_score"))
        return candidates.join(table, "chunk_id", "left").withColumn(
            "post_score", F.coalesce(F.col("post_score").cast("double"), F.lit(0.0))
        )


class ColumnScore(Reranker):
    """Scores from an expression over the candidate's columns."""

    def __init__(self, expression: Column, name: str = "expression") -> None:
        self.expression = expression
        self.name = name

    def score(self, candidates: DataFrame) -> DataFrame:
        return candidates.withColumn("post_score", self.expression.cast("double"))


class CrossEncoderReranker(Reranker):
    """Joint (question, text) model, loaded once per Python worker."""

    name = "cross-encoder"

    def __init__(
        self, model_name: str | None = None, *, revision: str | None = None,
        local_files_only: bool = False,
    ) -> None:
        self.model_name = model_name or DEFAULT_RERANKER_MODEL
        pinned = DEFAULT_RERANKER_REVISION if self.model_name == DEFAULT_RERANKER_MODEL else None
        self.revision = revision or pinned
        self.local_files_only = local_files_only

    def score(self, candidates: DataFrame) -> DataFrame:
        model_name, revision, local = self.model_name, self.revision, self.local_files_only

        @F.pandas_udf("double")
        def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            from sentence_transformers import CrossEncoder

            model = CrossEncoder(model_name, revision=revision, local_files_only=local)
            for questions, texts in batches:
                yield pd.Series(model.predict(list(zip(questions, texts)))).astype(float)

        return candidates.withColumn("post_score", predict("question", "text"))
