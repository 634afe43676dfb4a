"""Embedding near-dedup: products between strips of pieces, exact cosine, components.

Equal vectors are one representative with a count. Representatives of one label are dealt into pieces of some
2,000, the pieces into strips; every two strips of a label meet in one visit (links are symmetric). A visit
compares all of its pairs: a product in single precision finds what may be linked, and cosine in double
precision decides. It returns a row per linked vector, not per link: the number of its links there and the
smallest id that it reaches there.

Cases: null labels and vectors that are null, zero, of another width or with null or non-finite
components link with nothing; repeated ids with equal rows are one vector; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.arrow import batches_of
from gleaner.llm.graph import components, discard, merged_if_large
from gleaner.session import write_and_reread

SHARD = 2_000
SHARD_BYTES = 1 << 20
STRIP = 32  # pieces of a strip, where a label has many
STRIPS = 4  # at least, where a label has as many pieces
BATCH, TILE = 256, 2_048
PAIRS = 500_000  # links that a visit holds before it counts them
SLACK = 1e-4  # beyond the rounding of a single-precision product
NO_ID = -1 << 63  # a null id inside a visit


def links(queries: np.ndarray, members: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (query, member) at cosine >= threshold, in double precision; both arrays are unit rows. same: each pair once."""
    single_q, single_m = queries.astype(np.float32), members.astype(np.float32)
    slack = max(SLACK, queries.shape[1] * 2.0 ** -22)
    # Vectors whose norm under- or overflows are no unit rows; the bound of the rounding does not hold for them.
    certain = all((np.abs(np.einsum("pd,pd->p", x, x) - 1) < 1e-6).all() for x in (queries, members))
    for a in range(0, len(queries), BATCH):
        for b in range(a if same else 0, len(members), TILE):
            near = single_q[a:a + BATCH] @ single_m[b:b + TILE].T
            q, m = np.nonzero(near >= np.float32(threshold - slack))
            if not len(q):
                continue
            exact = near[q, m] >= np.float32(threshold + slack) if certain else np.zeros(len(q), bool)
            q, m = q + a, m + b
            doubt = np.flatnonzero(~exact)
            for k in range(0, len(doubt), BATCH * BATCH):  # a group of near copies links with whole rows
                x = doubt[k:k + BATCH * BATCH]
                exact[x] = np.einsum("pd,pd->p", queries[q[x]], members[m[x]]) >= threshold
            exact &= (m > q) | (not same)
            yield q[exact], m[exact]


def unite(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites what the pairs (a, b) link; ``roots`` has the smallest row of each row's group, before and after."""
    while True:
        x, y = roots[a], roots[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while (further := roots[roots]).tobytes() != roots.tobytes():
            roots[:] = further


def visit(sides: list[list], kind: str, threshold: float) -> Iterator[pd.DataFrame]:
    """(a, b, n): a linked id, the smallest id it reaches inside the visit, its links; n is -1 for a link (a, b) of an id with several vectors."""
    if not all(sides):
        return
    join = lambda name, dtype: np.concatenate([np.frombuffer(getattr(p, name), dtype) for side in sides for p in side])
    ids, copies, shared = join("ids", np.int64), join("copies", np.int64), join("shared", np.bool_)
    units = []
    for side in sides:
        raw = np.concatenate([np.frombuffer(p.vectors, kind) for p in side]).reshape(-1, side[0].width).astype(np.float64)
        with np.errstate(all="ignore"):
            units.append(raw / np.linalg.norm(raw, axis=1)[:, None])
    roots, others, linked = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    several, held, size = shared.any(), [], 0

    def count() -> Iterator[pd.DataFrame]:
        q, m = (np.concatenate(x) for x in zip(*held, strict=True))
        unite(roots, q, m)
        linked[q] = linked[m] = True
        if several:
            apart = shared[q] | shared[m]
            a, b = ids[q[apart]], ids[m[apart]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "n": np.int64(-1)}).drop_duplicates()
            q, m = q[~apart], m[~apart]
        np.add.at(others, q, copies[m])
        np.add.at(others, m, copies[q])

    for q, m in links(units[0], units[-1], threshold, len(units) == 1):
        m = m + (len(units[0]) if len(units) == 2 else 0)
        differ = ids[q] != ids[m]
        held.append((q[differ], m[differ]))
        size += len(held[-1][0])
        if size >= PAIRS:
            yield from count()
            held, size = [], 0
    if size:
        yield from count()
    smallest = ids.copy()
    np.minimum.at(smallest, roots, ids)
    yield pd.DataFrame({"a": ids, "b": smallest[roots], "n": others})[linked]


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id",
                           vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per distinct (id, vector, label)."""
    spark = vectors.sparkSession
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"),
                          F.col(label_col).cast("string").alias("label")).distinct()
    good = F.coalesce(
        F.col("label").isNotNull() & (F.size("v") > 0) & F.exists("v", lambda x: x != 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    rows = write_and_reread(rows.withColumn("good", good).withColumn(
        "key", F.when(F.col("good"), F.sha2(F.concat_ws("|", "label", F.concat_ws(",", F.transform(
            "v", lambda x: (x + F.lit(0.0)).cast("string")))), 256))), "vectors")
    reps = rows.where("good").groupBy("key", "label").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    reps = write_and_reread(reps.withColumn("width", F.size("v")), "reps")
    per_shard = F.greatest(F.lit(1), F.least(F.lit(SHARD), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("width")))))
    counts = reps.groupBy("label", "width").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.first(per_shard))).cast("int").alias("shards"))
    counts = counts.withColumn("strips", F.least("shards", F.greatest(F.lit(STRIPS), F.ceil(F.col("shards") / STRIP))).cast("int"))
    dealt = reps.join(F.broadcast(counts) if counts.limit(100_001).count() <= 100_000 else counts, ["label", "width"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    # Links of an id that has several vectors are kept one by one and counted once for each two ids.
    several = reps.groupBy("rep").count().where("count > 1 OR rep IS NULL").select("rep")
    apart = not several.isEmpty()
    shared = several.select(F.col("rep").alias("again"))
    dealt = dealt.join(shared, F.col("rep").eqNullSafe(F.col("again")), "left") if apart else dealt.withColumn("again", F.lit(None))
    dealt = dealt.select("label", "width", "shard", "strips", F.coalesce("rep", F.lit(NO_ID)).alias("rep"), "copies",
                         (F.col("again").isNotNull() | F.col("rep").isNull()).alias("shared"), "v")
    kind = "float32" if single else "float64"

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        one = pdf.iloc[0]
        return pd.DataFrame({"label": [one["label"]], "width": [one["width"]], "shard": [one["shard"]], "strips": [one["strips"]],
                             "ids": [pdf["rep"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()],
                             "shared": [pdf["shared"].to_numpy(np.bool_).tobytes()], "vectors": [np.array(pdf["v"].tolist(), kind).tobytes()]})

    pieces = write_and_reread(dealt.groupBy("label", "width", "shard", "strips").applyInPandas(
        piece, "label string, width int, shard int, strips int, ids binary, copies binary, shared binary, vectors binary"), "pieces")
    # Every piece goes to each visit of its strip; a visit's pieces are sorted next to each other.
    each = pieces.withColumn("strip", F.col("shard") % F.col("strips")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    each = each.withColumn("i", F.least("strip", "other")).withColumn("j", F.greatest("strip", "other")).drop("other", "strips")
    visits = counts.agg(F.sum(F.expr("strips * (strips + 1) / 2"))).first()[0] or 1
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, int(visits // 4))
    order = ["label", "width", "i", "j"]
    each = each.repartition(tasks, *order).sortWithinPartitions(*order, "shard")

    def run(batches):
        rows = (r for pdf in batches for r in pdf.itertuples(index=False))
        for (_, _, i, j), parts in groupby(rows, lambda r: (r.label, r.width, r.i, r.j)):
            parts = list(parts)
            yield from visit([[p for p in parts if p.strip == s] for s in dict.fromkeys((i, j))], kind, threshold)

    # A row is a piece; a batch holds one row.
    with batches_of(spark, 1):
        found = write_and_reread(each.mapInPandas(run, "a long, b long, n long"), "links")
    discard(pieces)
    size = found.count()
    others = found.where("n >= 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    if apart:
        edges = found.where("n < 0").select("a", "b").distinct()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        copies = reps.select(F.col("rep").alias("b"), "copies")
        more = merged_if_large(both, size).join(copies, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
        others = others.unionByName(more).groupBy("rep").agg(F.sum("others").alias("others"))
    group = components(found.where("n >= 0").select("a", "b"))
    known = (reps.select("key", "rep", "copies").join(merged_if_large(others, size), "rep", "left")
             .join(merged_if_large(group.select(F.col("v").alias("rep"), "c"), size), "rep", "left"))
    out = rows.select("id", "key").join(known, "key", "left").select(
        F.col("id").alias("vec_id"), (F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("c", "rep", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
