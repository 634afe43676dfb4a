"""Index a corpus that keeps arriving.

Chunking and embedding work row by row and need no state. Per micro-batch the new
documents, chunks and vectors are written as a segment, in folders named after the batch,
so a batch that runs again after a failure replaces itself. A document that arrives again
supersedes its earlier versions, one that arrives as null is gone. Publishing puts the
live rows of all segments into document order and reuses their vectors; positions, document
frequencies and mean lengths are those of an index built at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.chunking import chunk_documents
from gleaner.operators.lexical import LexicalIndex, with_position
from gleaner.sources.corpus import SUFFIXES, as_documents, path_suffix
from gleaner.sources.index_store import StoredIndex, load_index, read_lexical, write_index, write_lexical


def text_stream(spark: SparkSession, root: str) -> DataFrame:
    """Whole .md and .txt files as they appear below ``root``."""
    files = (
        spark.readStream.format("text").schema("value STRING").option("wholetext", True)
        .option("recursiveFileLookup", True).load(root)
    )
    path = F.regexp_replace("_metadata.file_path", r"\Afile:/+", "/")
    return files.where(path_suffix(path).isin(*SUFFIXES)).select(
        F.substring_index(path, f"{root.rstrip('/')}/", -1).alias("doc_id"),
        path.alias("path"), F.col("value").alias("raw_text"),
    )


def ingest(stream: DataFrame, index_path: str, checkpoint: str | None = None,
           embedder=None, **chunking) -> StreamingQuery:
    """Start indexing (doc_id, path, raw_text); processes what is there and stops.

    What was read is remembered below the index, unless ``checkpoint`` names another folder.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        part = f"batch={batch_id}"
        as_documents(batch).write.mode("overwrite").parquet(f"{index_path}/documents/{part}")
        documents = batch.sparkSession.read.parquet(f"{index_path}/documents/{part}").where("raw_text is not null")
        chunks = chunk_documents(documents, embedder=embedder, **chunking)
        chunks.write.mode("overwrite").parquet(f"{index_path}/chunks/{part}")
        stored = batch.sparkSession.read.parquet(f"{index_path}/chunks/{part}")
        if embedder is not None:
            stored.select(
                "chunk_id", "doc_id", "char_start",
                embedder.vector(F.col("text")).alias("embedding"),
            ).write.mode("overwrite").parquet(f"{index_path}/vectors/{part}")

    location = checkpoint or f"{index_path}/_checkpoint"
    return (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", location).trigger(availableNow=True).start()
    )


def live(spark: SparkSession, index_path: str, kind: str) -> DataFrame:
    """Rows of all segments whose document has no later version."""
    newest = spark.read.parquet(f"{index_path}/documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{index_path}/{kind}").join(newest, ["doc_id", "batch"], "left_semi").drop("batch")


def publish_index(spark: SparkSession, index_path: str, target: str, *, chunk_size: int = 800,
                  chunk_overlap: int = 120, embedder=None, **manifest) -> StoredIndex:
    """Write a whole index over everything ingested so far to ``target`` and open it.

    ``embedder`` is the one that the segments were embedded with; it is not run again.
    """
    documents = live(spark, index_path, "documents").where("raw_text is not null")
    vectors = live(spark, index_path, "vectors").select("chunk_id", "embedding") if embedder is not None else None
    write_index(target, documents, live(spark, index_path, "chunks"), corpus_root=index_path, chunk_size=chunk_size,
                chunk_overlap=chunk_overlap, embedder=embedder, vectors=vectors, **manifest)
    return load_index(spark, target)


def publish_lexical(spark: SparkSession, index_path: str) -> LexicalIndex:
    """Build the lexical tables over everything ingested so far."""
    chunks = live(spark, index_path, "chunks")
    with_position(chunks).write.mode("overwrite").parquet(f"{index_path}/ordered")
    write_lexical(spark.read.parquet(f"{index_path}/ordered"), f"{index_path}/lexical")
    return read_lexical(spark, f"{index_path}/lexical")
