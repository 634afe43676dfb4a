"""Explicit schemas; nothing is inferred from data."""

from pyspark.sql import types as T

STR, INT, LONG, DBL, BOOL = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


METADATA = struct(title=STR, path=STR, format=STR, raw_hash=STR)
DOCUMENT = struct(
    doc_id=STR, path=STR, title=STR, format=STR, raw_text=STR, normalized_text=STR, raw_hash=STR
)
CHUNK = struct(
    chunk_id=STR, doc_id=STR, text=STR, char_start=INT, char_end=INT, metadata=METADATA
)
STORED_CHUNK = struct(**{f.name: f.dataType for f in CHUNK}, position=LONG)
VECTOR = struct(
    position=LONG, chunk_id=STR, doc_id=STR, embedding=T.ArrayType(T.FloatType())
)
RANKED = struct(query_id=STR, chunk_id=STR, doc_id=STR, score=DBL, rank=INT)
EVAL_SAMPLE = struct(
    question_id=STR, question=STR, answer=STR, gold_doc_ids=T.ArrayType(STR),
    reference_answer=STR, expected_facts=T.ArrayType(STR),
)
RETRIEVER_CONFIG = struct(retriever=STR, top_k=INT, reranker=STR, rerank_top_n=INT)
FAILURE_CASE = struct(
    case_id=STR, question=STR, gold_doc_ids=T.ArrayType(STR), expected_label=STR,
    baseline=RETRIEVER_CONFIG, intervention=RETRIEVER_CONFIG, notes=STR,
    answer_label_expected=STR, baseline_answer=STR, intervention_answer=STR,
)
VERDICT = struct(
    faithfulness=DBL, answer_relevance=DBL, citation_support=DBL, answer_correctness=DBL,
    judge_name=STR, latency=DBL, notes=STR,
)
REVIEWED_QUESTION = struct(
    question_id=STR, category=STR, question=STR, gold_doc_ids=T.ArrayType(STR),
    teaching_note=struct(en=STR, zh=STR), expected_observation=struct(en=STR, zh=STR),
)
