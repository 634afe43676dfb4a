"""Merkle manifest of a dataset: one leaf per row, a ternary tree per source, one over the sources.

Rows get their rank within their source from a range partitioning, so a source of any size is
ranked by many tasks. The ternary digits of the rank are columns; within a block of 3**DIGITS
consecutive leaves the lowest digit is grouped away first, which nests the children of a node as
an array of structs, then the next digit, until one row holds the block's tree. All these
groupings share one exchange. The tops of the blocks are ranks of a shorter sequence and go
through the same steps, and so do the sources' tops. On the way down, one transform over the
nested structs writes every leaf's siblings and one explode emits them: proofs inside a block need
no join; a block row (one per 3**DIGITS leaves) meets the siblings above it by an equi-join.

Cases: a null field counts as ``-``; a null source is a source of its own, ahead of the others; a
null doc_id stands first in its source and is never tampered with; rows with equal source and
doc_id are ordered by their leaf digest, equal rows are leaves each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import write_and_reread

DIGITS = 6  # a block holds at most 3**6 leaves, whatever the size of a source
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in FIELDS[:-1]], field(text)), 256)


def with_rank(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, in ``order`` within ``group``) and ``n``, the group's size.

    Partitions hold ascending ranges, so a row's rank is its place in the partition plus the
    group's rows in earlier partitions; only counts per group and partition are windowed.
    """
    keys = [*group, *order]
    placed = write_and_reread(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                              .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "placed")
    parts = placed.groupBy(*group, "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(g).alias(f"of_{g}") for g in group], F.col("part").alias("of_part"), "first",
                         F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"), F.sum("rows").over(whole).alias("n"))
    same = reduce(lambda a, g: a & placed[g].eqNullSafe(parts[f"of_{g}"]), group, placed["part"] == parts["of_part"])
    return placed.join(parts, same).withColumn("rank", F.col("earlier") + F.col("at") - F.col("first")).select(*rows.columns, "rank", "n")


def rolled(rows: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(g, block, n, h, kids) of ``rows(g, rank, n, h, item)``: the tree of every block in one row.

    A group that has one node left after some level keeps it unhashed above that level.
    """
    digit = [F.expr(f"rank div {3 ** j} % 3").alias(f"d{j}") for j in range(digits)]
    level = rows.select("g", F.expr(f"rank div {3 ** digits}").alias("block"), "n", "h", *digit, F.col("item").alias("kids"))
    level = level.repartition("g", "block")
    for j in range(digits):
        level = level.groupBy("g", "block", "n", *[f"d{i}" for i in range(j + 1, digits)]).agg(
            F.sort_array(F.collect_list(F.struct(F.col(f"d{j}").alias("digit"), "h", "kids"))).alias("kids"))
        joined = F.array_join(F.col("kids")["h"], "")
        level = level.withColumn("h", F.when(F.col("n") > 3 ** j, F.sha2(joined, 256)).otherwise(joined))
    return level.select("g", "block", "n", "h", "kids")


def emitted(blocks: DataFrame, above: Column, *carried: str, digits: int = DIGITS) -> DataFrame:
    """(g, item, steps, *carried) for every leaf: the siblings left and right of its path, bottom up."""

    def step(kids: Column, i: Column) -> Column:
        hashes = lambda part: F.array_join(F.transform(part, lambda k: k["h"]), "")
        return F.struct(hashes(F.slice(kids, 1, i)).alias("before"), hashes(F.slice(kids, i + 2, 3)).alias("after"))

    def leaves(kids: Column, j: int, steps: Column) -> Column:
        def through(i: Column) -> Column:
            return F.when(F.col("n") > 3 ** j, F.concat(F.array(step(kids, i)), steps)).otherwise(steps)

        if j == 0:
            return F.transform(kids, lambda k, i: F.struct(k["kids"].alias("item"), through(i).alias("steps")))
        return F.flatten(F.transform(kids, lambda k, i: leaves(k["kids"], j - 1, through(i))))

    found = F.explode(leaves(F.col("kids"), digits - 1, above)).alias("leaf")
    return blocks.select("g", *carried, found).select("g", "leaf.item", "leaf.steps", *carried)


def forest(rows: DataFrame, digits: int = DIGITS) -> list[DataFrame]:
    """Stored blocks of every stage, leaves first, until each group is one block."""
    longest = rows.agg(F.max("n")).first()[0] or 0
    stages = [write_and_reread(rolled(rows, digits), "blocks")]
    while longest > 3 ** digits:
        tops = stages[-1].select("g", F.col("block").alias("rank"), F.expr(f"(n + {3 ** digits - 1}) div {3 ** digits}").alias("n"), "h",
                                 F.col("block").alias("item"))
        stages.append(write_and_reread(rolled(tops, digits), "blocks"))
        longest = -(-longest // 3 ** digits)
    return stages


def descended(stages: list[DataFrame], above: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(g, item, steps, subroot, root) for all leaves; ``above(g, steps, subroot, root)`` has a row per group."""
    top = above.withColumnRenamed("g", "of_g")
    blocks = stages[-1].join(top, stages[-1]["g"].eqNullSafe(top["of_g"]))
    for stage in reversed(stages[:-1]):
        lower = emitted(blocks, F.col("steps"), "subroot", "root", digits=digits)
        lower = write_and_reread(lower.select(F.col("g").alias("of_g"), F.col("item").alias("of_block"), "steps", "subroot", "root"), "above")
        blocks = stage.join(lower, stage["g"].eqNullSafe(lower["of_g"]) & (stage["block"] == lower["of_block"]))
    return emitted(blocks, F.col("steps"), "subroot", "root", digits=digits)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None, digits: int = DIGITS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, steps, folded_root, verified) per row of ``docs``.

    ``steps`` are the siblings of the path, bottom up. Rows where ``tampered`` holds are folded
    from the leaf of ``tampered_text`` instead of their own.
    """
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf_of(tampered_text))
    leaves = write_and_reread(docs.select(F.col("doc_id"), F.col("source").alias("g"), leaf_of(F.col("text")).alias("h"), other.alias("changed")), "leaves")
    ranks = with_rank(leaves, ["g"], ["doc_id", "h"])
    # Stored, since the number of stages depends on the longest source.
    rows = write_and_reread(ranks.select("g", "rank", "n", "h", F.struct("doc_id", F.col("h").alias("leaf"), "changed").alias("item")), "ranked")
    stages = forest(rows, digits)
    subroots = stages[-1].select(F.col("g").alias("source"), "h")
    order = with_rank(subroots, [], ["source"])
    order = write_and_reread(order.select(F.lit(0).alias("g"), "rank", "n", "h", F.struct("source", F.col("h").alias("subroot")).alias("item")), "sources")
    upper = forest(order, digits)
    root = upper[-1].select("g", F.array().cast(STEPS).alias("steps"), F.lit("").alias("subroot"), F.col("h").alias("root"))
    sources = write_and_reread(descended(upper, root, digits).select(F.col("item.source").alias("g"), "steps", F.col("item.subroot").alias("subroot"), "root"), "tops")
    found = descended(stages, sources, digits)
    return (found.select("item.doc_id", F.col("g").alias("source"), "item.leaf", "subroot", "root", "steps",
                         folded(F.coalesce("item.changed", "item.leaf"), F.col("steps")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)
