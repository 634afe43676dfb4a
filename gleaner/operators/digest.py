"""Digests of whole tables that no single task has to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import write_and_reread

FAN_OUT = 1024


def ordered_digest(rows: DataFrame, *order: str) -> str:
    """Digest of the ``digest`` column in the given order; rows of equal order go by digest.

    A tree over fixed ranges of ranks: 1024 consecutive digests are hashed to a node, and so
    on until one is left. Ranks are exact, so that neither partitions nor files matter.
    """
    level = numbered(rows.select(*order, "digest"), *order, "digest").select("no", "digest")
    count = level.count()
    while count > 1:
        children = F.array_sort(F.collect_list(F.struct("no", "digest")))
        level = level.groupBy(F.expr(f"no div {FAN_OUT}").alias("no")).agg(
            F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256)
            .alias("digest")
        )
        count = -(-count // FAN_OUT)
    top = level.first()
    return top["digest"] if top else ""


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``no``, the rank from 0 in ``order``.

    Partitions hold ascending ranges and are stored once, since a second sort may cut them
    elsewhere; a rank is the rows of earlier partitions plus the place in its own one.
    """
    placed = write_and_reread(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)),
        "placed",
    )
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"), F.min("at").alias("first")).select(
        "part", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("earlier"))
    return placed.join(sizes, "part").withColumn(
        "no", F.col("earlier") + F.col("at") - F.col("first")).drop("part", "at", "first", "earlier")
