"""Exact cosine top-k as block products inside tasks.

Queries form one matrix that every task holds while it streams over its share of
the vectors. A task cuts a batch into blocks around pivots and keeps each query's k best
scores so far: by the triangle inequality of angles no row of a block is nearer to a
query than the pivot's angle less the block's radius, so queries that cannot gain from a
block skip it. Products are taken of slices of queries with a block, so that their size
has a bound in bytes, whatever the number of queries. Only rows that reach a query's k
best so far leave the task. A query set too large for one matrix is split into tiles that
meet shards of the vectors through an equi-key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.functions.checks import known, same_width
from gleaner.functions.vectors import dot, norm
from gleaner.operators.lexical import TIE_STEPS, tie_key

# A query matrix is shipped to the tasks only up to this many numbers (32 MB).
QUERY_MATRIX_LIMIT = 4_000_000
# Vectors per shard on the tiled path.
SHARD_ROWS = 50_000
# Rows in a block of vectors, bytes of the largest product of queries with a block.
BLOCK_ROWS, SCORE_BYTES = 1024, 16 << 20
# Cosines are compared with their bound this loosely.
BOUND_SLACK = 1e-6


def _matrix(vectors: pa.Array | pd.Series) -> np.ndarray:
    """Rows of equal width as one float64 matrix of unit rows; zero rows stay zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if isinstance(vectors, pa.Array):
        rows = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
    else:
        rows = np.stack(vectors.to_numpy()).astype(np.float64)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths == 0, 1.0, lengths)


def _best(keys: np.ndarray, order: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs of the k best rows per query from ``floor`` up; ties go by ``order``.

    Rows at minus infinity never count. However many copies tie, k rows are kept.
    """
    if keys.shape[1] > k:
        floor = np.maximum(floor, -np.partition(-keys, k - 1, axis=1)[:, k - 1])
    q, r = np.nonzero((keys >= floor[:, None]) & np.isfinite(keys))
    if len(q) > k:
        ranked = np.lexsort((order[r], -keys[q, r], q))
        q, r = q[ranked], r[ranked]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, r = q[place < k], r[place < k]
    return q, r


class Scanner:
    """Each query's k best rows of a stream of batches, block by block."""

    def __init__(self, matrix: np.ndarray, query_ids: np.ndarray, admits: np.ndarray, top_k: int) -> None:
        self.matrix, self.query_ids, self.admits, self.top_k = matrix, query_ids, admits, top_k
        self.best = np.full((len(matrix), top_k), -np.inf)  # keys of the best rows so far
        self.slice = max(1, SCORE_BYTES // (8 * BLOCK_ROWS))
        self.skipped = self.scored = self.largest = 0  # pairs of a query and a block; bytes

    def _blocks(self, unit: np.ndarray) -> list[np.ndarray]:
        """Row numbers of blocks around pivots: rows of the batch at even distances."""
        lengths = np.linalg.norm(unit, axis=1)
        zero, rest = np.flatnonzero(lengths == 0), np.flatnonzero(lengths > 0)
        pivots = unit[rest[::max(1, len(rest) // 16)][:16]]
        near = np.argmax(unit[rest] @ pivots.T, axis=1) if len(rest) else rest
        groups = [zero, *(rest[near == p] for p in range(len(pivots)))]
        return [g[i:i + BLOCK_ROWS] for g in groups for i in range(0, len(g), BLOCK_ROWS)]

    def scan(self, vectors: pa.Table | pa.RecordBatch) -> pa.Table:
        """Rows of a batch that are among the best so far, with their passed-through columns."""
        widths = set(pc.unique(pc.list_value_length(vectors.column("embedding"))).to_pylist())
        if widths - {self.matrix.shape[1]}:
            raise ValueError(f"embedding dimension mismatch: queries {self.matrix.shape[1]}, vectors {sorted(widths, key=str)}")
        unit = _matrix(vectors.column("embedding"))
        groups = vectors.column("payload_group").to_numpy(zero_copy_only=False)
        kept = [
            n for n in vectors.schema.names
            if n not in ("embedding", "payload_group", "tile", "shard")
        ]
        slim = vectors.select(kept)
        latest = [(name, "descending") for name in [*kept[1:], kept[0]]]
        order = np.empty(len(unit), dtype=np.int64)
        order[pc.sort_indices(slim, sort_keys=latest).to_numpy()] = np.arange(len(unit))
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0))]
        for rows in self._blocks(unit):
            centre = unit[rows].mean(axis=0)
            size = np.linalg.norm(centre)
            centre = centre / size if size else centre
            radius = np.arccos(np.clip((unit[rows] @ centre).min(), -1, 1)) if size else np.pi
            for a in range(0, len(self.matrix), self.slice):
                part = self.matrix[a:a + self.slice]
                angle = np.arccos(np.clip(part @ centre, -1, 1)) if size else np.zeros(len(part))
                most = np.cos(np.maximum(0, angle - radius))
                open_ = a + np.flatnonzero((most + BOUND_SLACK) * TIE_STEPS >= self.best[a:a + self.slice].min(axis=1))
                self.skipped, self.scored = self.skipped + len(part) - len(open_), self.scored + len(open_)
                if len(open_):
                    found.append(self._score(open_, rows, unit, groups, order))
        q, r, keys, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        still = keys >= self.best[q].min(axis=1) if len(q) else np.empty(0, bool)
        q, r, scores = q[still], r[still], scores[still]
        taken = slim.take(pa.array(r, pa.int64()))
        return pa.table({
            "query_id": pa.array(self.query_ids[q], pa.string()),
            **{name: taken.column(name) for name in kept},
            "score": pa.array(scores, pa.float64()),
        })

    def _score(self, queries, rows, unit, groups, order):
        scores = self.matrix[queries] @ unit[rows].T
        self.largest = max(self.largest, scores.nbytes)
        for i in np.flatnonzero([a is not None for a in self.admits[queries]]):
            scores[i, groups[rows] != self.admits[queries[i]]] = -np.inf
        keys = np.floor(scores * TIE_STEPS + 0.5)
        q, r = _best(keys, order[rows], self.top_k, self.best[queries].min(axis=1))
        both = np.concatenate([self.best[queries], keys], axis=1)
        self.best[queries] = -np.partition(-both, self.top_k - 1, axis=1)[:, :self.top_k]
        return queries[q], rows[r], keys[q, r], scores[q, r]


def dense_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    top_k: int = 5,
    *,
    where: Column | None = None,
    group: str | None = None,
    order_by: tuple[str, ...] = (),
    matrix_limit: int = QUERY_MATRIX_LIMIT,
) -> DataFrame:
    """(query_id, chunk_id, *order_by, score, rank) for queries(query_id, vector).

    ``where`` is a payload filter for all queries; it is applied before ranking and
    reaches the scan. ``group`` names a payload column for filters that differ by
    query: a query's ``group`` value admits equal rows only, null admits all.
    A zero query has no results, a zero row scores zero. Ties go to the row that is
    last by ``order_by`` and then by id.
    """
    if top_k < 0:
        raise ValueError(f"top_k must be >= 0, got {top_k}")
    admits = F.lit(None) if group is None else F.col("group")
    asked = queries.where(norm(F.col("vector")) > 0).select(
        F.col("query_id").cast("string").alias("query_id"), "vector",
        admits.cast("string").alias("admits"),
    )
    payload = F.lit(None) if group is None else F.col(group)
    rows = vectors if where is None else vectors.where(where)
    rows = rows.select(
        F.col("chunk_id").cast("string").alias("chunk_id"), *order_by, "embedding",
        payload.cast("string").alias("payload_group"),
    )
    if top_k == 0:
        asked = asked.limit(0)
    one = rows.select(F.size("embedding").alias("width")).take(1)
    row_limit = max(1, matrix_limit // max(1, one[0]["width"] if one else 1))
    # At most one row more than fits a matrix ever reaches the driver.
    head = asked.limit(row_limit + 1).collect()
    if len(head) <= row_limit:
        found = _by_shipped_matrix(rows, head, top_k)
    else:
        found = _by_tiles(rows, asked, top_k, row_limit)
    order = W.partitionBy("query_id").orderBy(
        F.desc(tie_key(F.col("score"))), *[F.desc(c) for c in order_by], F.desc("chunk_id")
    )
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
        .select("query_id", "chunk_id", *order_by, "score", "rank")
    )


def _found_schema(rows: DataFrame) -> T.StructType:
    kept = [f for f in rows.schema.fields if f.name not in ("embedding", "payload_group")]
    return T.StructType([
        T.StructField("query_id", T.StringType()), *kept, T.StructField("score", T.DoubleType())
    ])


def _by_shipped_matrix(rows: DataFrame, head: list, top_k: int) -> DataFrame:
    spark, schema = rows.sparkSession, _found_schema(rows)
    if not head:
        return spark.createDataFrame([], schema)
    shipped = spark.sparkContext.broadcast((
        _matrix(pd.Series([np.asarray(r["vector"]) for r in head])),
        np.array([r["query_id"] for r in head], dtype=object),
        np.array([r["admits"] for r in head], dtype=object),
    ))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*shipped.value, top_k)
        for batch in batches:
            if batch.num_rows:
                yield from scanner.scan(batch).to_batches()

    return rows.mapInArrow(score, schema)


def _by_tiles(rows: DataFrame, asked: DataFrame, top_k: int, tile_rows: int) -> DataFrame:
    """Every (query tile, vector shard) pair is one group of bounded size."""
    tiles = max(1, -(-asked.count() * 2 // tile_rows))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    schema = _found_schema(rows)
    left = rows.select(
        "*", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"),
    )
    right = asked.select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int").alias("tile"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    empty = to_arrow_schema(schema).empty_table()

    def score(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not (vectors.num_rows and queries.num_rows):
            return empty
        scanner = Scanner(
            _matrix(queries.column("vector")), queries.column("query_id").to_numpy(),
            queries.column("admits").to_numpy(), top_k,
        )
        return scanner.scan(vectors)

    return (
        left.groupBy("tile", "shard").cogroup(right.groupBy("tile", "shard"))
        .applyInArrow(score, schema)
    )


def dense_explain(
    vectors: DataFrame, queries: DataFrame, results: DataFrame, preview_dimensions: int = 12
) -> DataFrame:
    """The factors of every result's cosine, with the head of both vectors.

    A result whose query or chunk is unknown, or whose widths differ, is an error.
    """
    if preview_dimensions < 0:
        raise ValueError("preview_dimensions must be non-negative")
    q, v = F.col("vector"), F.col("embedding")
    keyed = vectors.select(F.col("chunk_id").cast("string").alias("chunk_id"), "embedding")
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector")
    product = F.col("query_norm") * F.col("chunk_norm")
    return (
        results.join(asked, "query_id", "left").join(keyed, "chunk_id", "left")
        .withColumn("vector", known(q, "query", F.col("query_id")))
        .withColumn("embedding", same_width(q, known(v, "chunk", F.col("chunk_id")), F.col("chunk_id")))
        .select(
            "query_id", "chunk_id", "rank", "score", F.size(q).alias("dimension"),
            norm(q).alias("query_norm"), norm(v).alias("chunk_norm"),
            dot(q, v).alias("dot_product"),
            F.slice(q, 1, preview_dimensions).alias("query_vector_preview"),
            F.slice(v, 1, preview_dimensions).alias("chunk_vector_preview"),
        )
        .withColumn(
            "cosine_similarity",
            F.when(product == 0, F.lit(0.0)).otherwise(F.col("dot_product") / product),
        )
    )
