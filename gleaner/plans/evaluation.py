"""Retrieval and answer evaluation, diagnosis and A/B comparison as set-oriented jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.labels import (
    AnswerThresholds, RetrievalThresholds, answer_label, failure_label, is_fixed, is_moved, outcome,
)
from gleaner.functions.metrics import all_metrics
from gleaner.functions.prompts import extract_citations
from gleaner.operators.context import pack_context, with_prompt
from gleaner.plans.retrieval import RetrievalConfig, ask, retrieve, retrieved_docs

METRICS = ("hit", "reciprocal_rank", "context_precision", "context_recall")

# The three comparisons on offer.
PRESETS = {
    "bm25-vs-dense": (RetrievalConfig("bm25"), RetrievalConfig("dense")),
    "dense-vs-hybrid": (RetrievalConfig("dense"), RetrievalConfig("hybrid")),
    "hybrid-vs-reranked": (
        RetrievalConfig("hybrid"), RetrievalConfig("hybrid", 5, "cross-encoder", 20),
    ),
}


def _mean(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.avg(value.cast("double")), F.lit(0.0))


# ---------------------------------------------------------------- retrieval

def score_questions(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Per question: retrieved documents and the four metrics against its gold ids."""
    docs = retrieved_docs(questions, results)
    return docs.select("*", *all_metrics(F.col("retrieved_doc_ids"), F.col("gold_doc_ids")))


def eval_report(scored: DataFrame, *by: str) -> DataFrame:
    """Means over all questions; zeros when there are none."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("n_questions"), _mean("hit").alias("hit_rate"),
        _mean("reciprocal_rank").alias("mrr"),
        _mean("context_precision").alias("mean_context_precision"),
        _mean("context_recall").alias("mean_context_recall"),
    )


def run_retrieval_eval(
    index, samples: DataFrame, config: RetrievalConfig, embedder=None, reranker=None
) -> DataFrame:
    """Per-question metrics for samples(query_id, question, gold_doc_ids)."""
    config.validate()
    if config.retriever != "bm25" and embedder is None:
        raise ValueError(f"embedder must not be None for retriever={config.retriever!r}")
    asks = ask(samples, config)
    return score_questions(samples, retrieve(index, asks, embedder, reranker))


# ---------------------------------------------------------------- answers

def answer_questions(
    asks: DataFrame, results: DataFrame, generator, judge,
    context_budget: int | None = None, counter=None,
) -> DataFrame:
    """Pack, prompt, generate, cite and judge every ask.

    A non-empty ``scripted_answer`` column stands in for the generator.
    """
    if context_budget is not None and context_budget < 0:
        raise ValueError(f"context_budget must be >= 0, got {context_budget!r}")
    budget = context_budget if counter is not None and context_budget else 0
    prompted = with_prompt(pack_context(results, asks, budget, counter))
    answer = generator.answer(F.col("prompt"))
    if "scripted_answer" in asks.columns:
        scripted = F.col("scripted_answer")
        answer = F.when(scripted != "", scripted).otherwise(answer)
    answered = (
        prompted.withColumn("answer", answer)
        .withColumn("citations", extract_citations(F.col("answer")))
        .withColumn("context", F.transform("blocks", lambda b: b["text"]))
    )
    return judge.judge(answered)


def answer_report(judged: DataFrame, judge_name: str) -> DataFrame:
    """Three means over all questions; correctness over those that have one."""
    return judged.agg(
        F.count("*").alias("n_questions"), F.lit(judge_name).alias("judge"),
        _mean("verdict.faithfulness").alias("mean_faithfulness"),
        _mean("verdict.answer_relevance").alias("mean_answer_relevance"),
        _mean("verdict.citation_support").alias("mean_citation_support"),
        F.avg("verdict.answer_correctness").alias("mean_answer_correctness"),
    )


def run_answer_eval(
    index, samples: DataFrame, config: RetrievalConfig, generator, judge,
    embedder=None, reranker=None, context_budget: int | None = None, counter=None,
) -> DataFrame:
    asks = ask(samples, config)
    results = retrieve(index, asks, embedder, reranker)
    return answer_questions(asks, results, generator, judge, context_budget, counter)


# ---------------------------------------------------------------- diagnosis

def case_sides(cases: DataFrame) -> DataFrame:
    """Two asks per case, one for each configuration."""
    sides = F.array(*[
        F.struct(
            F.lit(side).alias("side"), F.col(f"{side}.retriever").alias("retriever"),
            F.col(f"{side}.top_k").alias("top_k"), F.col(f"{side}.reranker").alias("reranker"),
            F.col(f"{side}.rerank_top_n").alias("rerank_top_n"),
            F.col(f"{side}_answer").alias("scripted_answer"),
        )
        for side in ("baseline", "intervention")
    ])
    return cases.select(
        "case_id", "question", "gold_doc_ids", "expected_label", "answer_label_expected",
        F.inline(sides),
    ).withColumn("query_id", F.concat_ws(":", "case_id", "side"))


def _both_sides(rows: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """Pivot the two sides of each case back into one row."""
    value = F.struct(*fields)
    wide = rows.groupBy("case_id").agg(
        *[F.first(k).alias(k) for k in keep],
        *[F.max(F.when(F.col("side") == s, value)).alias(s) for s in ("baseline", "intervention")],
    )
    return wide.select("case_id", *keep, *[
        F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("baseline", "intervention") for f in fields
    ])


def _judged_change(wide: DataFrame, expected: str) -> DataFrame:
    before, after = F.col("baseline_label"), F.col("intervention_label")
    return wide.select(
        "*", is_fixed(before, after).alias("fixed"), is_moved(before, after).alias("moved"),
        outcome(before, after, F.col(expected)).alias("outcome"),
    )


def label_sides(
    sides: DataFrame, results: DataFrame, thresholds: RetrievalThresholds = RetrievalThresholds()
) -> DataFrame:
    """Label and metrics of both sides of every case."""
    docs = retrieved_docs(sides, results)
    got, gold = F.col("retrieved_doc_ids"), F.col("gold_doc_ids")
    labelled = docs.select(
        "*", failure_label(got, gold, F.col("expected_label"), thresholds).alias("label"),
        *all_metrics(got, gold),
    )
    fields = ["label", "retrieved_doc_ids", *METRICS]
    wide = _both_sides(labelled, fields, ["question", "expected_label"])
    return _judged_change(wide, "expected_label")


def run_diagnosis(
    index, cases: DataFrame, embedder=None, reranker=None,
    thresholds: RetrievalThresholds = RetrievalThresholds(),
) -> DataFrame:
    sides = case_sides(cases)
    return label_sides(sides, retrieve(index, sides, embedder, reranker), thresholds)


def label_answers(
    answered: DataFrame, thresholds: AnswerThresholds = AnswerThresholds()
) -> DataFrame:
    """Answer label of both sides of every case."""
    labelled = answered.select(
        "case_id", "side", "question", "answer_label_expected", "verdict",
        answer_label(
            F.col("verdict.faithfulness"), F.col("verdict.citation_support"), thresholds
        ).alias("label"),
        F.col("verdict.faithfulness").alias("faithfulness"),
        F.col("verdict.citation_support").alias("citation_support"),
    )
    wide = _both_sides(
        labelled, ["label", "faithfulness", "citation_support"],
        ["question", "answer_label_expected"],
    ).withColumnRenamed("answer_label_expected", "expected_label")
    return _judged_change(wide, "expected_label")


def run_answer_diagnosis(
    index, cases: DataFrame, generator, judge, embedder=None, reranker=None,
    thresholds: AnswerThresholds = AnswerThresholds(),
    context_budget: int | None = None, counter=None,
) -> DataFrame:
    """Only cases that expect an answer label take part."""
    sides = case_sides(cases.where(F.col("answer_label_expected") != ""))
    results = retrieve(index, sides, embedder, reranker)
    answered = answer_questions(sides, results, generator, judge, context_budget, counter)
    return label_answers(answered, thresholds)


def diagnosis_report(per_case: DataFrame) -> DataFrame:
    return per_case.agg(
        F.count("*").alias("n_cases"), F.count_if("fixed").alias("n_fixed"),
        F.count_if("moved").alias("n_moved"),
        F.count_if(F.col("baseline_label") == F.col("expected_label")).alias("n_confirmed"),
    )


# ---------------------------------------------------------------- comparison

def compare_sides(questions: DataFrame, left: RetrievalConfig, right: RetrievalConfig) -> DataFrame:
    """Two asks per question; equal configurations are refused."""
    left.validate_ranges()
    right.validate_ranges()
    if left.identity == right.identity:
        raise ValueError("Choose two different retrieval configurations")
    sides = F.array(*[
        F.struct(F.lit(name).alias("side"), *config.as_columns())
        for name, config in (("left", left), ("right", right))
    ])
    return (
        questions.withColumnRenamed("query_id", "question_id")
        .select("*", F.inline(sides))
        .withColumn("query_id", F.concat_ws(":", "question_id", "side"))
    )


def run_comparison(
    index, questions: DataFrame, left: RetrievalConfig, right: RetrievalConfig,
    embedder=None, reranker=None,
) -> DataFrame:
    """Per question and side: metrics and the evidence list in rank order."""
    sides = compare_sides(questions, left, right)
    results = retrieve(index, sides, embedder, reranker)
    shown = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "chunk_id", "doc_id", "title", "path", "text", "score"
    ))).alias("evidence"))
    return score_questions(sides, results).join(shown, "query_id", "left")


def comparison_report(compared: DataFrame) -> DataFrame:
    """One row of means per side; an empty question set is an error."""
    report = eval_report(compared, "side")
    if report.isEmpty():
        raise ValueError("The evaluation set cannot be empty")
    return report
