"""Context packing under a token budget, and what is built from the packed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.prompts import assemble_prompt, context_block
from gleaner.functions.text import let, preview
from gleaner.plugins.counters import CharCounter

# Fixed value: tokens kept free for the text around the context.
PROMPT_OVERHEAD = 100


def _fold(blocks: Column, budget: Column, question_tokens: Column) -> Column:
    """Take blocks in order while they fit; a block that does not fit is skipped."""
    unlimited = budget == 0
    start = F.struct(
        (budget - PROMPT_OVERHEAD - question_tokens).alias("left"),
        F.array().cast("array<string>").alias("selected"),
        F.array().cast("array<string>").alias("omitted"),
        F.lit(0).alias("estimated_tokens"),
    )

    def step(s: Column, b: Column) -> Column:
        fits = unlimited | (s["left"] >= b["tokens"])
        one = F.array(b["chunk_id"])
        return F.struct(
            F.when(fits, s["left"] - b["tokens"]).otherwise(s["left"]).alias("left"),
            F.when(fits, F.concat(s["selected"], one)).otherwise(s["selected"]).alias("selected"),
            F.when(fits, s["omitted"]).otherwise(F.concat(s["omitted"], one)).alias("omitted"),
            (s["estimated_tokens"] + F.when(fits, b["tokens"]).otherwise(0))
            .alias("estimated_tokens"),
        )

    return F.aggregate(blocks, start, step)


def result_blocks(results: DataFrame, counter=None) -> DataFrame:
    """One row per query with its blocks in rank order; a block list is at most k long."""
    counter = counter or CharCounter()
    block = context_block(F.col("chunk_id"), F.col("title"), F.col("path"), F.col("text"))
    return (
        results.withColumn("block", block)
        .withColumn("tokens", counter.count(F.col("block")))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            "rank", "chunk_id", "doc_id", "title", "path", "text", "block", "tokens"
        ))).alias("blocks"))
    )


def pack_context(
    results: DataFrame, questions: DataFrame, budget: int | str, counter=None
) -> DataFrame:
    """(query_id, question, packed blocks, selected, omitted, estimated_tokens, budget, counter).

    ``budget`` is a number or the name of a column of ``questions``; zero means no
    limit. Questions without results keep a row with empty lists.
    """
    if isinstance(budget, int) and budget < 0:
        raise ValueError(f"context_budget must be >= 0, got {budget!r}")
    counter = counter or CharCounter()
    limit = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    blocks = F.coalesce(F.col("blocks"), F.array().cast(_block_type()))
    packed = _fold(blocks, limit, counter.count(F.col("question")))
    return (
        questions.join(result_blocks(results, counter), "query_id", "left")
        .withColumn("blocks", blocks)
        .withColumn("p", packed)
        .select(
            *[c for c in questions.columns if c != budget],
            F.filter("blocks", lambda b: F.array_contains("p.selected", b["chunk_id"]))
            .alias("blocks"),
            F.col("p.selected").alias("selected"), F.col("p.omitted").alias("omitted"),
            F.col("p.estimated_tokens").alias("estimated_tokens"),
            limit.cast("int").alias("budget"), F.lit(counter.name).alias("counter_name"),
        )
    )


def _block_type() -> str:
    return (
        "array<struct<rank:int,chunk_id:string,doc_id:string,title:string,path:string,"
        "text:string,block:string,tokens:int>>"
    )


def with_prompt(packed: DataFrame) -> DataFrame:
    """Add the prompt made of the packed blocks."""
    texts = F.transform("blocks", lambda b: b["block"])
    return packed.withColumn("prompt", assemble_prompt(F.col("question"), texts))


def smallest_contrast_budget(
    results: DataFrame, questions: DataFrame, required: str, counter=None
) -> DataFrame:
    """(query_id, budget): smallest budget that selects and omits something and keeps
    every document of the ``required`` array column; no row where none does.

    What is selected changes only where the room left for blocks is the size of some
    subset of them, so those sizes are tried, up to the sum of all. Equal sums are one,
    so there are never more of them than tokens; each is one fold inside the query's row.
    """
    counter = counter or CharCounter()
    joined = questions.join(result_blocks(results, counter), "query_id").select(
        "query_id", required, counter.count(F.col("question")).alias("question_tokens"),
        F.transform("blocks", lambda b: F.struct(b["chunk_id"], b["doc_id"], b["tokens"])).alias("blocks"),
    )

    def works(budget: Column) -> Column:
        def check(packed: Column) -> Column:
            kept = F.filter("blocks", lambda b: F.array_contains(packed["selected"], b["chunk_id"]))
            docs = F.transform(kept, lambda b: b["doc_id"])
            return (
                (F.size(packed["selected"]) > 0) & (F.size(packed["omitted"]) > 0)
                & (F.size(F.array_except(F.col(required), docs)) == 0)
            )

        return let(_fold(F.col("blocks"), budget, F.col("question_tokens")), check)

    sums = F.aggregate(
        "blocks", F.array(F.lit(0)),
        lambda s, b: F.array_distinct(F.concat(s, F.transform(s, lambda x: x + b["tokens"]))),
    )
    return (
        joined.withColumn("budget", F.explode(sums))
        .withColumn("budget", F.col("budget") + PROMPT_OVERHEAD + F.col("question_tokens"))
        .where(works(F.col("budget")))
        .groupBy("query_id").agg(F.min("budget").alias("budget"))
    )


def chunk_traces(results: DataFrame) -> DataFrame:
    """Trace rows: identity, score and a one-line preview."""
    before = [
        F.col(c) if c in results.columns else F.lit(None).cast(kind).alias(c)
        for c, kind in (("pre_rerank_rank", "int"), ("pre_rerank_score", "double"))
    ]
    return results.select(
        "query_id", "rank", "chunk_id", "doc_id", "title", "path", "score",
        preview(F.col("text")).alias("text_preview"), *before,
    )


def evidence(results: DataFrame, semantics: str, selected: DataFrame | None = None) -> DataFrame:
    """Evidence rows; ``selected``(query_id, selected) marks what entered the prompt."""
    out = results.withColumn("score_semantics", F.lit(semantics))
    if selected is None:
        return out.withColumn("selected_for_context", F.lit(None).cast("boolean"))
    return out.join(selected.select("query_id", "selected"), "query_id", "left").withColumn(
        "selected_for_context",
        F.coalesce(F.array_contains("selected", F.col("chunk_id")), F.lit(False)),
    ).drop("selected")
