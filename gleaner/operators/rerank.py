"""Reranking: audit, final slice and rank movements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.plugins.rerankers import KeepOrder, Reranker


def rerank_audit(candidates: DataFrame, reranker: Reranker) -> DataFrame:
    """Every candidate with its rank and score before and after.

    ``candidates`` has (query_id, chunk_id, score, rank) plus what the reranker
    reads. A higher score wins; ties keep the earlier rank.
    """
    scored = reranker.score(candidates)
    order = W.partitionBy("query_id").orderBy(F.desc("post_score"), "rank")
    post_rank = (
        F.col("rank") if isinstance(reranker, KeepOrder) else F.row_number().over(order)
    )
    return scored.select(
        "query_id", "chunk_id",
        F.col("rank").cast("int").alias("pre_rank"), post_rank.cast("int").alias("post_rank"),
        F.col("score").alias("pre_score"), "post_score",
    )


def apply_rerank(candidates: DataFrame, reranker: Reranker, top_k: int) -> DataFrame:
    """The best ``top_k`` after reranking, with score and rank replaced."""
    if top_k < 0:
        raise ValueError(f"top_k must be >= 0, got {top_k}")
    scored = reranker.score(candidates)
    order = W.partitionBy("query_id").orderBy(F.desc("post_score"), "rank")
    post_rank = (
        F.col("rank") if isinstance(reranker, KeepOrder) else F.row_number().over(order)
    )
    return (
        scored.withColumn("post_rank", post_rank)
        .where(F.col("post_rank") <= top_k)
        .withColumn("pre_rerank_rank", F.col("rank").cast("int"))
        .withColumn("pre_rerank_score", F.col("score"))
        .withColumn("rank", F.col("post_rank").cast("int"))
        .withColumn("score", F.col("post_score"))
        .drop("post_rank", "post_score")
    )


def explain_rerank(audit: DataFrame, final_top_k: int) -> DataFrame:
    """How far each candidate moved; null rank and distance for the dropped ones."""
    if final_top_k < 0:
        raise ValueError("final_top_k must be non-negative")
    kept = F.col("post_rank") <= final_top_k
    delta = F.col("pre_rank") - F.col("post_rank")
    return audit.select(
        "query_id", "chunk_id", "pre_rank",
        F.when(kept, F.col("post_rank")).alias("final_rank"),
        "pre_score", F.col("post_score").alias("reranker_score"),
        F.when(kept, delta).alias("rank_delta"),
        F.when(~kept, "dropped").when(delta > 0, "moved_up").when(delta < 0, "moved_down")
        .otherwise("stayed").alias("outcome"),
    )
