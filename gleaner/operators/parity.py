"""Are two exact rankings the same, up to near-equal scores?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tie_groups(scores: Column, tolerance: float) -> Column:
    """Group number of every score of a ranked list.

    A score opens a group when it is further than ``tolerance`` from the first score
    of the open group, not from its neighbour.
    """
    start = F.struct(
        F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("group"),
        F.array().cast("array<int>").alias("groups"),
    )

    def step(s: Column, score: Column) -> Column:
        opens = s["anchor"].isNull() | (F.abs(score - s["anchor"]) > tolerance)
        group = F.when(opens, s["group"] + 1).otherwise(s["group"])
        return F.struct(
            F.when(opens, score).otherwise(s["anchor"]).alias("anchor"), group.alias("group"),
            F.concat(s["groups"], F.array(group)).alias("groups"),
        )

    return F.aggregate(scores, start, step, lambda s: s["groups"])


def grouped_ranking(ranked: DataFrame, tolerance: float) -> DataFrame:
    """(query_id, chunk_id, rank, score, tie_group); a list is as long as its top k."""
    lists = ranked.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("items")
    )
    groups = tie_groups(F.transform("items", lambda i: i["score"]), tolerance)
    paired = F.zip_with("items", groups, lambda i, g: F.struct(
        i["chunk_id"].alias("chunk_id"), i["rank"].alias("rank"), i["score"].alias("score"),
        g.alias("tie_group"),
    ))
    return lists.select("query_id", F.inline(paired))


def compare_rankings(left: DataFrame, right: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Per query and chunk: ranks and scores on both sides and whether they agree."""
    if tolerance < 0:
        raise ValueError("tolerance must be non-negative")
    sides = [
        grouped_ranking(df, tolerance).select(
            "query_id", "chunk_id", F.col("rank").alias(f"{side}_rank"),
            F.col("score").alias(f"{side}_score"), F.col("tie_group").alias(f"{side}_group"),
        )
        for side, df in (("left", left), ("right", right))
    ]
    agree = (
        (F.col("left_group") == F.col("right_group"))
        & (F.abs(F.col("left_score") - F.col("right_score")) <= tolerance)
    )
    return sides[0].join(sides[1], ["query_id", "chunk_id"], "full_outer").select(
        "query_id", "chunk_id", "left_rank", "right_rank", "left_score", "right_score",
        F.coalesce(agree, F.lit(False)).alias("equivalent"),
    )


def parity_verdict(items: DataFrame) -> DataFrame:
    """One row per query: do all of its chunks agree?

    Equal group numbers for every chunk of both lists mean equal groups.
    """
    return items.groupBy("query_id").agg(
        F.every("equivalent").alias("equivalent"), F.count("*").alias("items")
    )
