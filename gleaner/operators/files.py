"""File sets against their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.digest import ordered_digest


def compare_files(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status) of the full outer match of two (path, sha256) sets."""
    both = expected.select("path", F.col("sha256").alias("want")).join(
        actual.select("path", F.col("sha256").alias("have")), "path", "full_outer"
    )
    return both.select(
        "path",
        F.when(F.col("want").isNull(), "unexpected_files")
        .when(F.col("have").isNull(), "missing_files")
        .when(F.col("want") != F.col("have"), "digest_mismatch")
        .otherwise("matches").alias("status"),
    )


def files_status(compared: DataFrame) -> DataFrame:
    """One row: the gravest status, extra before missing before changed files."""
    def any_is(status: str):
        return F.coalesce(F.some(F.col("status") == status), F.lit(False))

    return compared.agg(
        F.when(any_is("unexpected_files"), "unexpected_files")
        .when(any_is("missing_files"), "missing_files")
        .when(any_is("digest_mismatch"), "digest_mismatch")
        .otherwise("matches").alias("status"),
        F.count("*").alias("files"),
    )


def directory_digest(files: DataFrame) -> str:
    """One digest over (path, sha256) rows in path order."""
    row = F.sha2(F.concat_ws("\n", "path", "sha256"), 256)
    return ordered_digest(files.select("path", row.alias("digest")), "path")
