"""Document sources: folders of text files, pinned file lists, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import document_title, line_feeds, normalize_text, path_format, sha256_text

# Accepted suffixes and upload limits.
SUFFIXES = (".md", ".txt")
MAX_UPLOAD_FILES = 100
MAX_UPLOAD_BYTES = 100 * 1024 * 1024


def path_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def _decoded(uri: Column) -> Column:
    """File URIs escape blanks and the like; "+" stands for itself."""
    plain = F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri)
    return F.regexp_replace(plain, r"\Afile:/+", "/")


def as_documents(files: DataFrame) -> DataFrame:
    """Documents from (doc_id, path, raw_text)."""
    fmt = path_format(F.col("path"))
    # Text files are read with universal newlines.
    return (
        files.withColumn("raw_text", line_feeds(F.col("raw_text")))
        .select(
            "doc_id", "path", document_title(F.col("raw_text"), F.col("path"), fmt).alias("title"),
            fmt.alias("format"), "raw_text", normalize_text(F.col("raw_text")).alias("normalized_text"),
            sha256_text(F.col("raw_text")).alias("raw_hash"),
        )
    )


def load_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every .md and .txt file below ``root``; the id is the path relative to it."""
    base = root.rstrip("/")
    files = (
        spark.read.option("recursiveFileLookup", True)
        .text(base, wholetext=True).select(_decoded(F.col("_metadata.file_path")).alias("path"), "value")
    )
    relative = F.substring_index(F.col("path"), f"{_plain(base)}/", -1)
    return as_documents(
        files.where(path_suffix(F.col("path")).isin(*SUFFIXES))
        .select(relative.alias("doc_id"), "path", F.col("value").alias("raw_text"))
    )


def _plain(root: str) -> str:
    return "/" + root.split("file:", 1)[1].lstrip("/") if root.startswith("file:") else root


def load_pinned(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """A fixed list of files below ``root`` with the digest of each."""
    files = spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{p}" for p in paths])
    path = _decoded(F.col("path"))
    return files.select(
        F.substring_index(path, f"{_plain(root.rstrip('/'))}/", -1).alias("source_path"),
        F.decode("content", "UTF-8").alias("raw_text"), F.sha2("content", 256).alias("sha256"),
    )


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of every file below ``root``."""
    base = root.rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    )
    return files.select(
        F.substring_index(_decoded(F.col("path")), f"{_plain(base)}/", -1).alias("path"),
        F.sha2("content", 256).alias("sha256"),
    )


def check_upload(files: DataFrame) -> None:
    """Refuse an upload of (name, length) that breaks a limit."""
    count, size, names, bad = files.agg(
        F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.count_distinct("name"),
        F.count_if(~path_suffix(F.col("name")).isin(*SUFFIXES)),
    ).first()
    if not 1 <= count <= MAX_UPLOAD_FILES:
        raise ValueError(f"an upload has 1 to {MAX_UPLOAD_FILES} files, got {count}")
    if size > MAX_UPLOAD_BYTES:
        raise ValueError(f"an upload has at most {MAX_UPLOAD_BYTES} bytes, got {size}")
    if names != count:
        raise ValueError("file names of an upload must be unique")
    if bad:
        raise ValueError(f"only {', '.join(SUFFIXES)} files can be uploaded")


def upload_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of an uploaded folder after its limits were checked."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    check_upload(listing.select(
        F.substring_index(_decoded(F.col("path")), "/", -1).alias("name"), "length"
    ))
    return load_documents(spark, folder)


def split_dataset(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corpus rows and question rows of a mixed dataset, told apart by their fields."""
    from gleaner.operators.prepare import corpus_rows, qa_rows

    return corpus_rows(rows), qa_rows(rows)


def write_corpus(documents: DataFrame, path: str) -> None:
    """Prepared documents as a table with one Markdown text per row."""
    documents.select("prepared_id", "title", "title_resolution", "url", "markdown").write.mode(
        "overwrite"
    ).parquet(path)


def write_qa(pairs: DataFrame, path: str) -> None:
    """Questions as JSON lines."""
    pairs.select("question_id", "question", "answer", "gold_doc_ids").write.mode(
        "overwrite"
    ).json(path)
