"""The language stage of the pipeline: what the network must reject, and what must stay."""

import base64
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)


def test_no_language_goes_and_clean_documents_stay(spark, docs):
    rng = random.Random(3)
    raw = rng.randbytes(1500)
    keys = "\n".join("AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) for _ in range(60))
    junk = [base64.b64encode(raw).decode(), raw.hex(), keys]
    first = docs.agg(F.max("doc_id")).first()[0] + 1
    planted = spark.createDataFrame([(first + k, t, None, "x", len(t)) for k, t in enumerate(junk)], docs.schema)
    got = {r[0] for r in corpus_pipeline.language_stage(spark, docs.unionByName(planted), SF).select("doc_id").collect()}
    assert got == {r[0] for r in docs.select("doc_id").collect()}


def test_without_labels_documents_stay(spark, docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.language_stage(spark, bare, SF)
    assert got.columns == corpus_pipeline.COLUMNS and got.count() == docs.count()
    assert corpus_pipeline.language_stage(spark, docs.limit(0), SF).count() == 0
