"""Vector collections: payload, fingerprint, verification and publishing.

An alias is a log of snapshots. A publisher names the snapshot it started from and creates
the next entry of the log; where another one was faster the entry exists, and the slower
one fails instead of hiding the other's work. Readers hold on to a snapshot: publishing
deletes nothing, old collections go when ``expire`` is called.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import source_group
from gleaner.functions.vectors import all_close, unit
from gleaner.operators.digest import ordered_digest

PAYLOAD = ("chunk_id", "doc_id", "title", "path", "source_group", "source_fingerprint")


def payload(chunks: DataFrame, fingerprint: str) -> DataFrame:
    """Payload of every point; the path shown is the document id."""
    return chunks.select(
        "chunk_id", "doc_id", F.coalesce("metadata.title", F.lit("")).alias("title"),
        F.col("doc_id").alias("path"), source_group(F.col("doc_id")).alias("source_group"),
        F.lit(fingerprint).alias("source_fingerprint"),
    )


def vector_hex(vector: Column) -> Column:
    """Little-endian float32 bytes of an array column, as lower-case hex; null for null."""

    @F.pandas_udf("string")
    def to_hex(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            known = vectors.dropna()
            flat = np.concatenate([*known, []]).astype("<f4").tobytes().hex()
            ends = 8 * np.cumsum(known.map(len).to_numpy(int))
            cut = [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]] if len(ends) else [], ends, strict=True)]
            yield pd.Series(cut, known.index, dtype=object).reindex(vectors.index)

    return to_hex(vector)


def vector_fingerprint(vectors: DataFrame) -> str:
    """Digest of a collection's shape, ordered ids and float32 vectors.

    Each row is hashed where it lies; only row digests are put in order.
    """
    row = F.concat(
        F.char_length("chunk_id").cast("string"), F.lit(":"), F.col("chunk_id"), F.lit(":"),
        F.coalesce(vector_hex(F.col("embedding")), F.lit("-")),
    )
    keyed = vectors.select("position", F.sha2(row, 256).alias("digest"))
    digest = ordered_digest(keyed, "position")
    count, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    return hashlib.sha256(f"cosine:{count}:{width}:{digest}".encode()).hexdigest()


def verify_collection(
    points: DataFrame, chunks: DataFrame, vectors: DataFrame, fingerprint: str,
    tolerance: float = 1e-6,
) -> DataFrame:
    """One row: does the stored collection equal its source in ids, payload and vectors?

    ``points`` has the payload columns and ``embedding`` of unit length.
    """
    expected = payload(chunks, fingerprint).join(
        vectors.select("chunk_id", "embedding"), "chunk_id"
    )
    fields = [c for c in PAYLOAD if c != "chunk_id"]
    theirs = points.select("chunk_id", F.struct(*fields).alias("p"), F.col("embedding").alias("e"))
    ours = expected.select(
        "chunk_id", F.struct(*fields).alias("p0"), unit(F.col("embedding")).alias("e0")
    )
    both = ours.join(theirs, "chunk_id", "full_outer")
    same = F.coalesce(
        (F.col("p") == F.col("p0")) & all_close(F.col("e"), F.col("e0"), tolerance), F.lit(False)
    )
    return both.agg(
        F.count("*").alias("points"), F.count_if(~same).alias("mismatches"),
        F.coalesce(F.every(same), F.lit(True)).alias("verified"),
    )


def payload_filters_available(points: DataFrame, chunks: DataFrame) -> bool:
    """Every chunk has a point whose source group is filled in."""
    if "source_group" not in points.columns:
        return False
    both = chunks.select("chunk_id").join(
        points.select("chunk_id", "source_group"), "chunk_id", "left"
    )
    return bool(both.agg(
        F.coalesce(F.every(F.coalesce(F.col("source_group") != "", F.lit(False))), F.lit(True))
    ).first()[0])


@dataclass(frozen=True)
class PreparationReport:
    alias: str
    collection: str
    source_fingerprint: str
    point_count: int
    dimension: int
    reused: bool
    verified: bool


class PublishConflict(RuntimeError):
    """Another publisher's snapshot came first."""


@dataclass(frozen=True)
class Snapshot:
    """An entry of an alias's log; version 0 stands for none yet."""

    alias: str
    version: int
    collection: str | None


class CollectionCatalog:
    """Collections as parquet folders, published through the snapshot log of an alias.

    A collection's folder is never written twice; a rebuild goes beside it, is verified, and
    only then becomes the next snapshot.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, collection: str) -> str:
        return f"{self.root}/{collection}"

    def _hadoop(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        fs, target = self._hadoop(path)
        return fs.exists(target)

    def build(
        self, collection: str, chunks: DataFrame, vectors: DataFrame, fingerprint: str
    ) -> None:
        """Write all points under a name that is not in use."""
        points = payload(chunks, fingerprint).join(
            vectors.select("chunk_id", unit(F.col("embedding")).alias("embedding")), "chunk_id"
        )
        points.write.mode("errorifexists").parquet(self._path(collection))

    def read(self, collection: str) -> DataFrame:
        return self.spark.read.parquet(self._path(collection))

    def delete(self, collection: str) -> None:
        fs, target = self._hadoop(self._path(collection))
        fs.delete(target, True)

    # ------------------------------------------------------------ snapshot log

    def _log(self, alias: str) -> str:
        return f"{self.root}/_alias_{alias}"

    def snapshots(self, alias: str) -> list[Snapshot]:
        """The log, oldest first; an entry is a small file."""
        fs, folder = self._hadoop(self._log(alias))
        if not fs.exists(folder):
            return []
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder))
        return [Snapshot(alias, int(n), self._entry(alias, int(n)).split("\n")[0]) for n in names if n.isdigit()]

    def _entry(self, alias: str, version: int) -> str:
        fs, target = self._hadoop(f"{self._log(alias)}/{version:012d}")
        stream = fs.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def snapshot(self, alias: str) -> Snapshot:
        """What the alias names now; a reader keeps to it while others publish."""
        log = self.snapshots(alias)
        return log[-1] if log else Snapshot(alias, 0, None)

    def resolve(self, alias: str) -> str | None:
        return self.snapshot(alias).collection

    def commit(self, base: Snapshot, collection: str) -> Snapshot:
        """Append ``collection`` to the log if ``base`` is still its last entry.

        Creating a file that must not exist is atomic on a distributed file system; the
        entry is read back, so that of two writers on a file system without that guarantee
        one at most believes it has won.
        """
        version, token = base.version + 1, uuid.uuid4().hex
        fs, target = self._hadoop(f"{self._log(base.alias)}/{version:012d}")
        try:
            stream = fs.create(target, False)
            stream.write(f"{collection}\n{token}".encode())
            stream.close()
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
            raise PublishConflict(f"{base.alias} has a newer snapshot than {base.version}") from error
        if self._entry(base.alias, version).split("\n")[1] != token:
            raise PublishConflict(f"{base.alias} has a newer snapshot than {base.version}")
        return Snapshot(base.alias, version, collection)

    def expire(self, alias: str, keep: int = 2) -> list[str]:
        """Delete collections that only entries before the last ``keep`` name; returns their names."""
        log = self.snapshots(alias)
        current = {s.collection for s in log[-max(keep, 1):]}
        old = sorted({s.collection for s in log} - current)
        gone = [c for c in old if c.startswith(f"{alias}__") and self._exists(self._path(c))]
        for collection in gone:
            self.delete(collection)
        return gone

    # ------------------------------------------------------------ publishing

    def _verified(self, collection, chunks, vectors, fingerprint) -> bool:
        if not self._exists(self._path(collection)):
            return False
        points = self.read(collection)
        if not {*PAYLOAD, "embedding"} <= set(points.columns):
            return False
        return verify_collection(points, chunks, vectors, fingerprint).first()["verified"]

    def prepare(self, alias: str, chunks: DataFrame, vectors: DataFrame) -> PreparationReport:
        """Publish a verified collection; a good one that is published already is kept.

        Raises PublishConflict where another publisher was faster; its snapshot stands.
        """
        base = self.snapshot(alias)
        fingerprint = vector_fingerprint(vectors)
        if base.collection and self._verified(base.collection, chunks, vectors, fingerprint):
            return self._report(alias, base.collection, fingerprint, vectors, True)
        # A name of its own, so that two publishers of equal vectors do not share a folder.
        target = f"{alias}__{fingerprint[:16]}__{uuid.uuid4().hex[:8]}"
        self.build(target, chunks, vectors, fingerprint)
        if not self._verified(target, chunks, vectors, fingerprint):
            self.delete(target)
            raise RuntimeError("the collection was not stored completely; prepare it again")
        try:
            self.commit(base, target)
        except PublishConflict:
            self.delete(target)
            raise
        return self._report(alias, target, fingerprint, vectors, False)

    def status(self, alias: str, chunks: DataFrame, vectors: DataFrame) -> PreparationReport | None:
        """Report of the published collection, or none when it is absent or damaged."""
        fingerprint = vector_fingerprint(vectors)
        published = self.resolve(alias)
        if not published or not self._verified(published, chunks, vectors, fingerprint):
            return None
        return self._report(alias, published, fingerprint, vectors, True)

    @staticmethod
    def _report(alias, collection, fingerprint, vectors, reused) -> PreparationReport:
        count, dim = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
        return PreparationReport(alias, collection, fingerprint, count, dim, reused, True)
