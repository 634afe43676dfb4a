"""Bounds the rows of an Arrow batch while a table of wide rows is written."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(KEY, before)
