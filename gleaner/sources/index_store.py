"""Index tables on shared storage: write once, query many times."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import schemas
from gleaner.operators.chunking import fan_out_chunks
from gleaner.operators.lexical import (
    FILE_POSTINGS, CorpusStats, LexicalIndex, build_blocks, build_chunk_lengths, corpus_stats, corpus_terms,
    document_frequency, shards_for, with_position,
)
from gleaner.session import shared_dir, write_and_reread

# The index format and what a manifest without these keys means.
SCHEMA_VERSION = "2.0"
MANIFEST_DEFAULTS = {
    "index_backend": "numpy", "distance_metric": "cosine", "backend_identity": "numpy",
}

_BLOCKS = (
    "term STRING, cell BIGINT, n BIGINT, max_tf INT, min_dl INT, "
    "entries ARRAY<STRUCT<position: BIGINT, dl: INT, tf: INT>>, shard INT"
)
_LENGTHS = "position BIGINT, chunk_id STRING, doc_id STRING, char_start INT, dl INT"
_TERMS = "term STRING, df BIGINT"
# Tables of an index that may follow when they are first needed.
TABLES = ("vectors", "lexical")


@dataclass(frozen=True)
class StoredIndex:
    """Everything a retrieval needs, read from one index folder."""

    manifest: dict
    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None
    lexical: LexicalIndex | None


def write_lexical(chunks: DataFrame, path: str, shards: int | None = None, postings: bool = True) -> CorpusStats:
    """Blocks of postings in folders by term hash, chunk lengths, df table, scalars.

    ``chunks`` carries a stored ``position``. The number of folders follows the tokens. Without ``postings``
    only the df table and the scalars are made; rankings then read the texts of the chunks.
    """
    spark = chunks.sparkSession
    if not postings:
        terms, stats = corpus_terms(chunks)
        terms.write.mode("overwrite").parquet(f"{path}/terms")
        _write_json(spark, f"{path}/stats", {**asdict(stats), "shards": 0})
        return stats
    build_chunk_lengths(chunks).write.mode("overwrite").parquet(f"{path}/chunk_lengths")
    lengths = spark.read.schema(_LENGTHS).parquet(f"{path}/chunk_lengths")
    count, tokens = lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    # A term has no more postings than there are chunks; the parts of a frequent one stay within two files' worth.
    slices = max(1, -(-count // (2 * FILE_POSTINGS)))
    n = shards or shards_for(tokens // slices)
    (
        build_blocks(chunks, n, slices).sortWithinPartitions("shard", "term", "cell")
        .write.mode("overwrite").partitionBy("shard").parquet(f"{path}/blocks")
    )
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    document_frequency(blocks).write.mode("overwrite").parquet(f"{path}/terms")
    stats = corpus_stats(lengths, spark.read.schema(_TERMS).parquet(f"{path}/terms"))
    _write_json(spark, f"{path}/stats", {**asdict(stats), "shards": n})
    return stats


def read_lexical(spark: SparkSession, path: str, chunks: DataFrame | None = None) -> LexicalIndex:
    """``chunks`` are those that the tables were made of; without postings they are needed."""
    stats = _read_json(spark, f"{path}/stats")
    shards = stats.pop("shards")
    stats["head"] = tuple(stats["head"])
    if not shards and chunks is None:
        raise ValueError(f"{path} has no postings, its chunks have to be given")
    return LexicalIndex(
        chunks=spark.read.schema(_LENGTHS).parquet(f"{path}/chunk_lengths") if shards else build_chunk_lengths(chunks),
        blocks=spark.read.schema(_BLOCKS).parquet(f"{path}/blocks") if shards else None,
        terms=spark.read.schema(_TERMS).parquet(f"{path}/terms"),
        stats=CorpusStats(**stats),
        shards=shards,
        texts=chunks.select("position", "text") if chunks is not None else None,
    )


def write_index(
    path: str,
    documents: DataFrame,
    chunks: DataFrame,
    *,
    corpus_root: str,
    chunk_size: int,
    chunk_overlap: int,
    chunking_strategy: str = "fixed_character",
    chunking_params: dict | None = None,
    embedder=None,
    embedding_model: str | None = None,
    index_backend: str = "numpy",
    distance_metric: str = "cosine",
    backend_identity: str | None = None,
    source_corpus_id: str | None = None,
    vectors: DataFrame | None = None,
    documents_folder: str | None = None,
    tables: tuple[str, ...] = TABLES,
) -> dict:
    """Write documents, chunks, vectors, the lexical tables and a manifest.

    ``vectors(chunk_id, embedding)`` are those of ``embedder`` where they exist already.
    ``documents_folder``, relative to ``path``, holds the documents where several indexes share them.
    ``chunks`` are put in document order unless they carry a ``position`` already, from ``cut_in_order``.
    What ``tables`` leaves out follows by ``write_vectors`` and ``write_lexical``.
    """
    spark = documents.sparkSession
    if documents_folder is None:
        documents.write.mode("overwrite").parquet(f"{path}/documents")
    # In position order, so that a lookup of few chunks reads few row groups.
    ordered = chunks if "position" in chunks.columns else with_position(chunks)
    ordered.write.mode("overwrite").parquet(f"{path}/chunks")
    documents = spark.read.schema(schemas.DOCUMENT).parquet(f"{path}/{documents_folder or 'documents'}")
    chunks = spark.read.schema(schemas.STORED_CHUNK).parquet(f"{path}/chunks")
    if embedder is not None and "vectors" in tables:
        write_vectors(chunks, path, embedder, vectors)
    if "lexical" in tables:
        write_lexical(chunks, f"{path}/lexical")
    manifest = {
        "schema_version": SCHEMA_VERSION,
        "corpus_root": corpus_root,
        "created_at": datetime.now(timezone.utc).isoformat(),
        "document_count": documents.count(),
        "chunk_count": chunks.count(),
        "chunk_size": chunk_size,
        "chunk_overlap": chunk_overlap,
        "chunking_strategy": chunking_strategy,
        "chunking_params": chunking_params or {},
        "index_backend": index_backend,
        "distance_metric": distance_metric,
        "backend_identity": backend_identity or index_backend,
        "source_corpus_id": source_corpus_id,
        "embedding_backend": embedder.name if embedder else None,
        "embedding_model": embedding_model or getattr(embedder, "model_name", None),
        "embedding_dim": embedder.dim if embedder else None,
    }
    if documents_folder is not None:
        manifest["documents_folder"] = documents_folder
    revision = getattr(embedder, "revision", None)
    if revision is not None:
        manifest["embedding_revision"] = revision
    # The per-file provenance list grows with the corpus, so it stays a table.
    documents.select("doc_id", "path", "raw_hash").write.mode("overwrite").parquet(
        f"{path}/corpus_files"
    )
    _write_json(spark, f"{path}/manifest", manifest)
    return manifest


def write_vectors(chunks: DataFrame, path: str, embedder, vectors: DataFrame | None = None) -> None:
    """A vector per stored chunk, made by ``embedder`` or looked up in ``vectors(chunk_id, embedding)``."""
    if vectors is None:
        vectors = chunks.select("chunk_id", embedder.vector(F.col("text")).alias("embedding"), "position", "doc_id")
    else:
        vectors = chunks.select("position", "chunk_id", "doc_id").join(vectors, "chunk_id", "left")
    vectors.select("position", "chunk_id", "doc_id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    check_vectors(chunks, chunks.sparkSession.read.parquet(f"{path}/vectors"), embedder.dim)


def write_indexes(
    root: str,
    documents: DataFrame,
    configurations: dict[str, tuple[str, int, int]],
    *,
    corpus_root: str,
    embedder=None,
    source_corpus_id: str | None = None,
) -> dict[str, dict]:
    """One index folder per configuration (strategy, size, overlap) below ``root``; their manifests.

    The source is read once: documents are stored once and shared, one job cuts the chunks of
    all configurations, and a chunk that several of them hold is embedded once.
    """
    spark = documents.sparkSession
    documents.write.mode("overwrite").parquet(f"{root}/documents")
    stored = spark.read.schema(schemas.DOCUMENT).parquet(f"{root}/documents")
    cut = f"{shared_dir(spark)}/fan-out-{uuid.uuid4().hex[:12]}"
    fan_out_chunks(stored, configurations).write.partitionBy("index_id").parquet(cut)
    schema = T.StructType([*schemas.CHUNK.fields, T.StructField("index_id", T.StringType())])
    chunks = spark.read.schema(schema).parquet(cut)
    vectors = None
    if embedder is not None:
        texts = chunks.select("chunk_id", "text").dropDuplicates(["chunk_id"])
        vectors = write_and_reread(texts.select("chunk_id", embedder.vector(F.col("text")).alias("embedding")), "shared-vectors")
    return {
        name: write_index(
            f"{root}/{name}", stored, chunks.where(F.col("index_id") == name).drop("index_id"),
            corpus_root=corpus_root, chunk_size=size, chunk_overlap=overlap, chunking_strategy=strategy,
            embedder=embedder, source_corpus_id=source_corpus_id, vectors=vectors, documents_folder="../documents",
        )
        for name, (strategy, size, overlap) in configurations.items()
    }


def load_index(spark: SparkSession, path: str, verify: bool = True, tables: tuple[str, ...] = TABLES) -> StoredIndex:
    """Open an index folder; ids of chunks and vectors have to agree. Only the named ``tables`` have to be there."""
    manifest = {**MANIFEST_DEFAULTS, **_read_json(spark, f"{path}/manifest")}
    chunks = spark.read.schema(schemas.STORED_CHUNK).parquet(f"{path}/chunks")
    vectors = None
    if manifest.get("embedding_dim") and "vectors" in tables:
        vectors = spark.read.schema(schemas.VECTOR).parquet(f"{path}/vectors")
        if verify:
            check_vectors(chunks, vectors, manifest["embedding_dim"])
    return StoredIndex(
        manifest=manifest,
        documents=spark.read.schema(schemas.DOCUMENT).parquet(f"{path}/{manifest.get('documents_folder', 'documents')}"),
        chunks=chunks,
        vectors=vectors,
        lexical=read_lexical(spark, f"{path}/lexical", chunks) if "lexical" in tables else None,
    )


def check_vectors(chunks: DataFrame, vectors: DataFrame, dim: int) -> None:
    """Every chunk has one vector of the declared width, and no vector is left over."""
    both = (
        chunks.select("chunk_id", F.lit(1).alias("c"))
        .join(vectors.select("chunk_id", F.size("embedding").alias("d")), "chunk_id", "full_outer")
    )
    unmatched, wrong, n_rows, n_ids = both.agg(
        F.count_if(F.col("c").isNull() | F.col("d").isNull()),
        F.count_if(F.col("d") != dim),
        F.count("*"),
        F.count_distinct("chunk_id"),
    ).first()
    if unmatched or n_rows != n_ids:
        raise ValueError("chunk_ids mismatch between chunks and vectors")
    if wrong:
        raise ValueError(f"embeddings width does not match {dim}")


# ---------------------------------------------------------------- helpers

def _write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON document through Spark's commit protocol: complete or absent."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])
