"""Dataset preparation: unique documents, questions with translated gold ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.prepare import (
    doc_to_markdown, gold_ids_from_list, gold_ids_from_text, pick_text, resolve_title, slugify,
)
from gleaner.functions.text import strip
from gleaner.session import broadcast_if_small


def corpus_rows(rows: DataFrame) -> DataFrame:
    """Rows with document text."""
    return rows.where((F.coalesce("md_document", F.lit("")) != "")
                      | (F.coalesce("document", F.lit("")) != ""))


def qa_rows(rows: DataFrame) -> DataFrame:
    """Rows with a question."""
    return rows.where(F.coalesce("question", F.lit("")) != "")


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """First row of every key by ``order``.

    ``min_by`` keeps one row per key and map task, so a key with a third of all rows
    shuffles no more than any other; the rows themselves are never grouped.
    """
    packed = F.struct(*rows.columns)
    return (
        rows.groupBy(key).agg(F.min_by(packed, F.col(order)).alias("first"))
        .select("first.*")
    )


def extract_documents(rows: DataFrame, order: str = "input_pos") -> DataFrame:
    """One document per original id (the first), with title, slug and prepared id."""
    original = strip(F.col("doc_id"))
    kept = first_per_key(
        corpus_rows(rows).withColumn("doc_id", original).where(F.col("doc_id") != ""),
        "doc_id", order,
    )
    text = pick_text(F.col("md_document"), F.col("document"))
    title = strip(F.coalesce("title", "doc_id"))
    url = F.coalesce("url", F.lit(""))
    resolved = resolve_title(title, F.col("text"), url, F.col("doc_id"))
    slug = slugify(F.col("doc_id"))
    return (
        kept.withColumn("text", text).withColumn("resolved", resolved)
        .select(
            "doc_id", F.col("resolved.title").alias("title"), title.alias("original_title"),
            F.col("resolved.method").alias("title_resolution"), "text", url.alias("url"),
            slug.alias("slug"), F.concat(F.lit("docs/"), slug, F.lit(".md")).alias("prepared_id"),
            doc_to_markdown(F.col("resolved.title"), F.col("text")).alias("markdown"),
        )
    )


def gold_ids(rows: DataFrame, fields: tuple[str, ...]) -> Column:
    """Ids of the first field that has any; lists, comma strings and scalars alike."""
    kinds = dict(rows.dtypes)
    found = []
    for name in (f for f in fields if f in kinds):
        column = F.col(name)
        if kinds[name].startswith("array"):
            ids, present = gold_ids_from_list(column.cast("array<string>")), F.size(column) > 0
        elif kinds[name] == "string":
            ids, present = gold_ids_from_text(column), column != ""
        else:
            ids = gold_ids_from_list(F.array(column.cast("string")))
            present = column.isNotNull() & (column != 0)
        found.append(F.when(present, ids))
    return F.coalesce(*found, F.array().cast("array<string>"))


def translate_ids(rows: DataFrame, id_map: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, ids) with every known id replaced; unknown ids stay as they are.

    Lists keep their order and repeats; rows with empty lists stay too.
    """
    positions = rows.select(key, F.posexplode_outer(ids).alias("pos", "raw"))
    mapped = positions.join(
        broadcast_if_small(id_map.select(F.col("doc_id").alias("raw"), "prepared_id")),
        "raw", "left",
    )
    return mapped.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct(
                "pos", F.coalesce("prepared_id", "raw").alias("id"))))),
            lambda e: e["id"],
        ).alias(ids),
        F.count_if(F.col("raw").isNotNull() & F.col("prepared_id").isNull()).alias("unknown_ids"),
    )


def extract_qa_pairs(
    rows: DataFrame, id_map: DataFrame,
    gold_fields: tuple[str, ...] = ("correct_answer_document_ids", "ground_truths_contexts_ids"),
) -> DataFrame:
    """Questions with answers and gold ids in terms of prepared documents.

    ``input_no`` identifies a row; question ids may repeat.
    """
    asked = (
        qa_rows(rows).withColumn("gold_doc_ids", gold_ids(rows, gold_fields))
        .withColumn("question", strip(F.col("question"))).where(F.col("question") != "")
    )
    translated = translate_ids(asked, id_map, "input_no", "gold_doc_ids")
    return (
        asked.drop("gold_doc_ids").join(translated, "input_no")
        .select(
            "input_no", strip(F.coalesce("question_id", F.lit(""))).alias("question_id"),
            "question", strip(F.coalesce("correct_answer", F.lit(""))).alias("answer"),
            "gold_doc_ids", "unknown_ids",
        )
    )
