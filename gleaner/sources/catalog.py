"""Catalogs of corpora, indexes and lessons, kept as JSON descriptions on shared storage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SAFE_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def safe_name(name: str) -> str:
    """Refuse names that could leave their folder."""
    if not _SAFE_NAME.fullmatch(name) or ".." in name:
        raise ValueError(f"invalid identifier: {name!r}")
    return name


def _read(spark: SparkSession, root: str, file_name: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema).option("multiLine", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", file_name).json(root)
    )


def list_corpora(spark: SparkSession, root: str) -> DataFrame:
    return _read(
        spark, root, "corpus.json", "id STRING, name STRING, kind STRING, file_count INT"
    ).orderBy("id")


def list_indexes(spark: SparkSession, root: str) -> DataFrame:
    """Index descriptions written by ``write_index``; one manifest part per index."""
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.txt")
        .text(root).where(F.col("_metadata.file_path").rlike(r"/manifest/part-[^/]*\z"))
    )
    schema = (
        "schema_version STRING, source_corpus_id STRING, chunking_strategy STRING, "
        "index_backend STRING, document_count LONG, chunk_count LONG, embedding_dim INT"
    )
    index_id = F.regexp_extract("_metadata.file_path", r"([^/]+)/manifest/part-[^/]*\z", 1)
    return lines.select(
        index_id.alias("index_id"), F.from_json("value", schema).alias("m")
    ).select("index_id", "m.*").orderBy("index_id")


def list_lessons(spark: SparkSession, root: str) -> DataFrame:
    packages = _read(
        spark, root, "manifest.json",
        "id STRING, schema_version INT, lessons ARRAY<STRUCT<id: STRING, order: INT, "
        "title: STRING, question: STRING, focus: STRING>>",
    )
    return (
        packages.select(F.col("id").alias("package_id"), F.inline("lessons"))
        .orderBy("package_id", "order")
    )


def seed_assets(spark: SparkSession, path: str) -> DataFrame:
    """(asset_id, target, path, sha256) of every file a seed manifest promises."""
    manifest = spark.read.schema(
        "schema_version INT, seed_version STRING, assets ARRAY<STRUCT<id: STRING, path: STRING, "
        "target: STRING, files: ARRAY<STRUCT<path: STRING, sha256: STRING>>>>"
    ).option("multiLine", True).json(path)
    assets = manifest.select(F.explode("assets").alias("a"))
    files = assets.select(
        F.col("a.id").alias("asset_id"), F.col("a.target").alias("target"),
        F.explode("a.files").alias("f"),
    )
    return files.select("asset_id", "target", F.col("f.path").alias("path"), "f.sha256")
