"""Connected components by contraction with pointer jumping; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import shared_dir, write_and_reread

# Spark broadcasts by the size of the files, and files of repeated numbers are far smaller than their rows.
BROADCAST_ROWS = 200_000


def merged_if_large(side: DataFrame, rows: int) -> DataFrame:
    """A side of a join that is never broadcast, and so never held by the driver, if it may have more rows than ``BROADCAST_ROWS``."""
    return side.hint("merge") if rows > BROADCAST_ROWS else side


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by ``write_and_reread`` that no later step reads; others are left alone."""
    for table in tables:
        files = table.inputFiles()[:1] if table is not None else []
        spark = table.sparkSession if files else None
        if files and shared_dir(spark).split("://")[-1] in files[0]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def _roots(to: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``to(v, c)``, of ``rows`` rows, with every c replaced by the end of its chain, and the steps that took.

    Each step looks up the label of the label, so that a chain of n is done in log2(n) steps.
    """
    steps = 0
    while True:
        further = to.select(F.col("v").alias("c"), F.col("c").alias("next"))
        ahead = write_and_reread(to.select("v", "c").join(merged_if_large(further, rows), "c").select(
            "v", F.col("next").alias("c"), (F.col("next") != F.col("c")).alias("moved")), "labels")
        discard(to)
        to, steps = ahead, steps + 1
        if to.where("moved").isEmpty():
            return to.select("v", "c"), steps


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every end of ``edges(a, b)``: c is the smallest vertex reachable from v.

    Each round points vertices at their smallest neighbour, follows the pointers to their ends
    and keeps the edges between different ends; a round at least halves the vertices of every
    component that is not done. Hub vertices are combined before the shuffle; the joins are
    plain equi-joins that adaptive execution splits. An empty table gives an empty table.
    """
    return components_and_rounds(edges)[0]


def components_and_rounds(edges: DataFrame) -> tuple[DataFrame, int]:
    """The components and how many tables of labels were written on the way."""
    e = write_and_reread(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    result, rounds = None, 0
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = write_and_reread(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("c")), "labels")
        size = nearest.count()
        to, steps = _roots(nearest, size)
        rounds += 1 + steps
        moved = write_and_reread(
            e.join(merged_if_large(to.select(F.col("v").alias("a"), F.col("c").alias("x")), size), "a")
            .join(merged_if_large(to.select(F.col("v").alias("b"), F.col("c").alias("y")), size), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if result is None:
            result, spent = to, [e]
        else:
            merged = write_and_reread(
                result.join(merged_if_large(to.select(F.col("v").alias("c"), F.col("c").alias("next")), size), "c", "left")
                .select("v", F.coalesce("next", "c").alias("c")), "labels")
            spent, result, rounds = [e, result, to], merged, rounds + 1
        discard(*spent)
        e = moved
        if e.isEmpty():
            return result, rounds
