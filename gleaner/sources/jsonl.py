"""JSON-lines sources with the tolerance each kind of file needs.

Fields are read as text first, so one odd value never costs a whole row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions.labels import NO_FAILURE
from gleaner.functions.text import strip

_EVAL_FIELDS = (
    "question_id", "question", "answer", "gold_doc_ids", "reference_answer", "expected_facts",
)
_CASE_FIELDS = (
    "case_id", "question", "gold_doc_ids", "expected_label", "baseline", "intervention",
    "notes", "answer_label_expected", "baseline_answer", "intervention_answer",
)
_CONFIG_FIELDS = ("retriever", "top_k", "reranker", "rerank_top_n")

# The reviewed set has four questions in each of four categories.
REVIEWED_CATEGORIES = ("lexical", "dense", "hybrid", "reranking")
REVIEWED_PER_CATEGORY = 4


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("line"))


def _objects(lines: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """JSON objects as ``o`` (every field as text) with their keys; other lines are dropped."""
    schema = ", ".join(f"{f} STRING" for f in fields)
    keys = F.json_object_keys("line")
    return lines.where(keys.isNotNull()).select(
        F.from_json("line", schema).alias("o"), keys.alias("keys")
    )


def _text(name: str, default: str = "", parent: str = "o", keys: str = "keys") -> Column:
    """Text of a field; a JSON null reads "None", an absent field the default."""
    return F.when(~F.array_contains(keys, name), F.lit(default)).otherwise(
        F.coalesce(F.col(f"{parent}.{name}"), F.lit("None"))
    )


def _list(name: str) -> Column:
    """array<string> of a JSON list, null for anything else."""
    raw = F.col(f"o.{name}")
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>"))


def parse_eval_samples(lines: DataFrame) -> DataFrame:
    """Questions from lines; those without text or without gold ids are skipped."""
    rows = _objects(lines, _EVAL_FIELDS)
    reference = F.col("o.reference_answer")
    return (
        rows.select(
            strip(_text("question_id")).alias("question_id"),
            strip(_text("question")).alias("question"),
            strip(_text("answer")).alias("answer"),
            _list("gold_doc_ids").alias("gold_doc_ids"),
            F.when(reference != "", strip(reference)).alias("reference_answer"),
            F.coalesce(_list("expected_facts"), F.array().cast("array<string>"))
            .alias("expected_facts"),
        )
        .where((F.col("question") != "") & (F.size("gold_doc_ids") > 0))
    )


def load_eval_samples(spark: SparkSession, path: str) -> DataFrame:
    return parse_eval_samples(_lines(spark, path))


def _config(name: str) -> Column:
    """Retriever settings with defaults for whatever is absent."""
    raw = F.col(f"o.{name}")
    c = F.from_json(raw, ", ".join(f"{f} STRING" for f in _CONFIG_FIELDS))
    return F.struct(
        F.coalesce(c["retriever"], F.lit("dense")).alias("retriever"),
        F.coalesce(c["top_k"].cast("int"), F.lit(5)).alias("top_k"),
        F.coalesce(c["reranker"], F.lit("none")).alias("reranker"),
        c["rerank_top_n"].cast("int").alias("rerank_top_n"),
    )


def parse_failure_cases(lines: DataFrame) -> DataFrame:
    """Cases from lines; an id and a question are needed, gold ids may be empty."""
    rows = _objects(lines, _CASE_FIELDS)
    return (
        rows.select(
            strip(_text("case_id")).alias("case_id"),
            strip(_text("question")).alias("question"),
            F.coalesce(_list("gold_doc_ids"), F.array().cast("array<string>"))
            .alias("gold_doc_ids"),
            _text("expected_label", NO_FAILURE).alias("expected_label"),
            _config("baseline").alias("baseline"), _config("intervention").alias("intervention"),
            *[_text(f).alias(f) for f in (
                "notes", "answer_label_expected", "baseline_answer", "intervention_answer",
            )],
        )
        .where((F.col("case_id") != "") & (F.col("question") != ""))
    )


def load_failure_cases(spark: SparkSession, path: str) -> DataFrame:
    return parse_failure_cases(_lines(spark, path))


def check_reviewed(questions: DataFrame) -> None:
    """The reviewed set is complete: unique ids, text and gold, four per category."""
    total = REVIEWED_PER_CATEGORY * len(REVIEWED_CATEGORIES)
    rows, ids, incomplete = questions.agg(
        F.count("*"), F.count_distinct("question_id"),
        F.count_if((F.coalesce("question", F.lit("")) == "")
                   | (F.coalesce(F.size("gold_doc_ids"), F.lit(0)) <= 0)),
    ).first()
    if rows != total or ids != total:
        raise ValueError(f"The reviewed evaluation set must contain {total} unique questions")
    if incomplete:
        raise ValueError("Every reviewed question needs text and gold document IDs")
    counts = {r["category"]: r["count"] for r in category_counts(questions).collect()}
    if counts != dict.fromkeys(REVIEWED_CATEGORIES, REVIEWED_PER_CATEGORY):
        raise ValueError("The reviewed evaluation set must contain four questions per category")


def category_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("category").count()


def load_reviewed_questions(spark: SparkSession, path: str) -> DataFrame:
    questions = (
        spark.read.schema(schemas.REVIEWED_QUESTION).option("mode", "FAILFAST").json(path)
    )
    check_reviewed(questions)
    return questions


def find_question(questions: DataFrame, question_id: str) -> DataFrame:
    """The catalog entry with that id; the filter reaches the scan."""
    return questions.where(F.col("question_id") == question_id).limit(1)


def catalog_view(questions: DataFrame, position: str = "position", featured: int = 8) -> DataFrame:
    """What a reader may see before answering: no answers, no gold ids."""
    return questions.select(
        "question_id", "question", (F.col(position) < featured).alias("featured")
    )


def catalog_check(questions: DataFrame) -> DataFrame:
    """Expected and retrieved documents side by side, with a hit flag."""
    return questions.select(
        "question_id", F.col("gold_doc_ids").alias("expected_document_ids"),
        F.col("retrieved_doc_ids").alias("retrieved_document_ids"),
        F.arrays_overlap("gold_doc_ids", "retrieved_doc_ids").alias("hit"),
    )
