"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators.lexical import tie_key

# Fixed value: the usual fusion constant.
RRF_K = 60


def reciprocal_rank_fusion(
    lists: list[DataFrame], top_k: int, k: int = RRF_K, source_names: list[str] | None = None,
    key: str = "chunk_id",
) -> DataFrame:
    """(query_id, <key>, score, rank, sources) from lists of (query_id, <key>, score, rank).

    Ties keep the order in which a chunk is first seen, list by list. ``sources``
    holds every contribution in list order.
    """
    if top_k < 0:
        raise ValueError(f"top_k must be non-negative, got {top_k}")
    names = source_names or [f"source_{i + 1}" for i in range(len(lists))]
    if len(names) != len(lists):
        raise ValueError("source_names must match results_lists")
    tagged = [
        ranked.select(
            "query_id", key,
            F.struct(
                F.lit(i).alias("source_no"), F.col("rank").cast("int").alias("rank"),
                F.lit(name).alias("source"), F.col("score").cast("double").alias("score"),
                (1.0 / (F.lit(k) + F.col("rank"))).alias("contribution"),
            ).alias("hit"),
        )
        for i, (name, ranked) in enumerate(zip(names, lists))
    ]
    # A chunk has one hit per list, so a group is never longer than the number of lists.
    fused = (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("query_id", key)
        .agg(F.array_sort(F.collect_list("hit")).alias("hits"))
        .withColumn("score", F.aggregate(
            "hits", F.lit(0.0), lambda total, hit: total + hit["contribution"]
        ))
    )
    first_seen = F.struct(F.col("hits")[0]["source_no"], F.col("hits")[0]["rank"])
    order = W.partitionBy("query_id").orderBy(F.desc(tie_key(F.col("score"))), first_seen)
    sources = F.transform("hits", lambda h: F.struct(
        h["source"].alias("source"), h["rank"].alias("rank"), h["score"].alias("score"),
        h["contribution"].alias("contribution"),
    ))
    return (
        fused.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
        .select("query_id", key, "score", "rank", sources.alias("sources"))
    )


def source_components(sources: str = "sources", score: str = "score") -> Column:
    """The fused score and every source's score and rank, from the provenance of a fused row."""
    def entry(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.cast("double").alias("value"))

    parts = F.transform(sources, lambda s: F.array(
        entry(F.concat(s["source"], F.lit("_score")), s["score"]),
        entry(F.concat(s["source"], F.lit("_rank")), s["rank"]),
    ))
    fused = F.array(entry(F.lit("rrf_score"), F.col(score)))
    return F.map_from_entries(F.concat(fused, F.flatten(parts)))


def score_components(results: DataFrame, *sources: tuple[str, DataFrame]) -> DataFrame:
    """``results`` with a map of the scores and ranks each source gave a chunk."""
    out = results
    entries = [F.struct(F.lit("rrf_score").alias("key"), F.col("score").alias("value"))]
    for name, ranked in sources:
        out = out.join(
            ranked.select(
                "query_id", "chunk_id", F.col("score").alias(f"{name}_score"),
                F.col("rank").cast("double").alias(f"{name}_rank"),
            ),
            ["query_id", "chunk_id"], "left",
        )
        entries += [
            F.struct(F.lit(f"{name}_{part}").alias("key"), F.col(f"{name}_{part}").alias("value"))
            for part in ("score", "rank")
        ]
    known = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return out.select(*results.columns, F.map_from_entries(known).alias("score_components"))
