"""Whole evaluation bundles against what they declare: one aggregation, one row per violation.

Every rule is turned into facts (kind, key, counts), from questions, documents and declared
values alike; one combined count per key decides all rules at once. So a gold id is checked
against all documents without a join, and a frequent key is added up before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.collection import vector_fingerprint
from gleaner.operators.digest import ordered_digest
from gleaner.sources.index_store import StoredIndex
from gleaner.sources.jsonl import REVIEWED_CATEGORIES, REVIEWED_PER_CATEGORY

REVIEWED = dict.fromkeys(REVIEWED_CATEGORIES, REVIEWED_PER_CATEGORY)
KINDS = ("category", "gold_doc_ids", "identity", "incomplete", "question_count", "question_id")


def _fact(kind: str, key: Column, asked: Column | int = 0, known: int = 0) -> Column:
    """One thing that was seen; what is asked for or expected is added up per kind and key."""
    def number(value: Column | int) -> Column:
        return F.lit(value).cast("long")

    return F.struct(
        F.lit(kind).alias("kind"), key.cast("string").alias("key"), number(asked).alias("asked"),
        number(known).alias("known"), number(0).alias("expected"),
    )


def _question_facts() -> Column:
    gold = F.coalesce(F.filter("gold_doc_ids", lambda d: d.isNotNull()), F.array().cast("array<string>"))
    empty = (F.coalesce("question", F.lit("")) == "") | (F.size(gold) == 0) | F.col("question_id").isNull()
    own = F.array(
        _fact("question_id", F.col("question_id"), 1), _fact("category", F.col("category"), 1),
        _fact("question_count", F.lit("all"), 1), _fact("incomplete", F.col("question_id"), empty.cast("int")),
    )
    return F.concat(own, F.transform(F.array_distinct(gold), lambda d: _fact("gold_doc_ids", d, 1)))


def bundle_violations(
    questions: DataFrame, documents: DataFrame, identity: DataFrame, per_category: dict[str, int] | None = None
) -> DataFrame:
    """(kind, key, found, expected) of everything that is wrong; empty where all holds.

    ``questions`` has question_id, category, question, gold_doc_ids; ``documents`` doc_id;
    ``identity`` key, actual, declared, trusted as strings, where a null trusted value asks
    nothing. ``per_category`` is a short dictionary of how many questions each category needs.

    ``question_id``: an id that occurs more than once. ``incomplete``: no id, text or gold.
    ``category`` and ``question_count``: another number than asked for. ``gold_doc_ids``: a
    document that does not exist, with the number of questions that name it. ``identity``: the
    actual value differs from the declared or the trusted one.
    """
    wanted = REVIEWED if per_category is None else per_category
    spark = questions.sparkSession
    declared = spark.createDataFrame(
        [("category", c, 0, 0, n) for c, n in wanted.items()] + [("question_count", "all", 0, 0, sum(wanted.values()))],
        "kind string, key string, asked long, known long, expected long",
    )
    facts = (
        questions.select(F.inline(_question_facts()))
        .unionByName(documents.select(_fact("gold_doc_ids", F.col("doc_id"), known=1).alias("f")).select("f.*"))
        .unionByName(declared)
    )
    asked, known, expected = F.col("asked"), F.col("known"), F.col("expected")
    kind = F.col("kind")
    wrong = (
        ((kind == "question_id") & F.col("key").isNotNull() & (asked > 1))
        | ((kind == "incomplete") & (asked > 0))
        | (kind.isin("category", "question_count") & (asked != expected))
        | ((kind == "gold_doc_ids") & (asked > 0) & (known == 0))
    )
    due = F.when(kind == "question_id", 1).when(kind.isin("category", "question_count"), expected).otherwise(0)
    counted = (
        facts.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("asked", "known", "expected")]).where(wrong)
        .select("kind", "key", asked.cast("string").alias("found"), due.cast("string").alias("expected"))
    )
    trusted = F.col("trusted")
    differs = ~F.col("actual").eqNullSafe(F.col("declared")) | (trusted.isNotNull() & ~F.col("actual").eqNullSafe(trusted))
    return counted.unionByName(identity.where(differs).select(
        F.lit("identity").alias("kind"), "key", F.col("actual").alias("found"),
        F.coalesce(trusted, "declared").alias("expected"),
    ))


def bundle_identity(index: StoredIndex, questions: DataFrame, reranker_model: str, reranker_revision: str) -> dict:
    """What a bundle is made of: digests, counts, models. A fixed number of values."""
    def digest(rows: DataFrame, *order: str) -> str:
        row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
        return ordered_digest(rows.select(*order, row.alias("digest")), *order)

    m = index.manifest
    return {
        "questions_sha256": digest(questions, "question_id"),
        "chunks_sha256": digest(index.chunks, "position"),
        "embeddings_sha256": digest(index.vectors, "position"),
        "source_vector_fingerprint": vector_fingerprint(index.vectors),
        "document_count": m.get("document_count"),
        "chunk_count": index.chunks.count(),
        "distance_metric": m.get("distance_metric"),
        "embedding_dimension": m.get("embedding_dim"),
        "embedding_model": m.get("embedding_model"),
        "embedding_revision": m.get("embedding_revision"),
        "reranker_model": reranker_model,
        "reranker_revision": reranker_revision,
        "question_count": questions.count(),
    }


def verify_bundle(
    index: StoredIndex, questions: DataFrame, manifest: dict, *, reranker_model: str, reranker_revision: str,
    trusted: dict | None = None, backend: str = "numpy", per_category: dict[str, int] | None = None,
) -> None:
    """Raises ValueError that names what differs, before an evaluation starts on the wrong inputs."""
    actual = {**bundle_identity(index, questions, reranker_model, reranker_revision),
              "index_backend": index.manifest.get("index_backend")}
    declared, trusted = {**manifest, "index_backend": backend}, trusted or {}

    def text(value) -> str | None:
        return None if value is None else str(value)

    identity = index.chunks.sparkSession.createDataFrame(
        [(k, text(v), text(declared.get(k)), text(trusted.get(k))) for k, v in actual.items()],
        "key string, actual string, declared string, trusted string",
    )
    found = bundle_violations(questions, index.documents, identity, per_category)
    # Named by field or kind of rule, of which there are few; the rows themselves stay where they are.
    names = found.select(F.when(F.col("kind") == "identity", F.col("key")).otherwise(F.col("kind")).alias("name"))
    wrong = sorted(r["name"] for r in names.distinct().collect())
    if wrong:
        raise ValueError(f"bundle does not match its manifest: {', '.join(wrong)}")
