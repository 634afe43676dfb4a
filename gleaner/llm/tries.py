"""Conversation prefixes as a trie: a double array per shard, shared upper nodes merged globally.

A turn's identity is a 16-byte digest of its role and text, a conversation's path the digests of
its turns one after another. Equal paths are one sequence, whatever the number of copies. Paths are
range-partitioned and sorted, so that a shard (some SHARD_TURNS turns in a row) is a run of
neighbouring prefixes: a very common first turn or conversation is cut like any other. Each shard
gives its turns dense ids, packs its trie into BASE and CHECK arrays (child = BASE[node] + id,
valid where CHECK[child] = node) and walks its sequences through them. Only nodes on the paths of
a shard's first and last sequences can stand in other shards too; these are emitted with the
aggregates of what hangs below them off those paths, and merged by a grouping.

Cases: turns go by number, null first, turns of equal number by their digest; null role or text is
an empty one; rows without conv_id belong to no conversation; repeated rows are turns each; an
empty table gives no node; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.arrow import batches_of
from gleaner.session import write_and_reread

DIGEST = 16  # bytes that stand for a turn
ID_BUCKET = 10  # conversation ids are listed in pieces of 2**10 ids at most
SHARD_TURNS = 100_000  # turns in a shard, or one sequence if that is longer
BATCH_ROWS = 2_000
NODES = ("key binary, parent binary, depth long, conv_id long, n_convs long, chars long, ends_sha256 string, "
         "n_children long, n_leaves long, saved_tokens long, shared boolean, above array<binary>, shard binary, parent_conv_id long")


class DoubleArray:
    """A trie over dense turn ids. ``edges``: (parent, id, child) arrays, nodes numbered from the root 0."""

    def __init__(self, parent: np.ndarray, turn: np.ndarray, child: np.ndarray, n_turns: int) -> None:
        n = len(child) + 1
        order = np.lexsort((turn, parent))
        parent, turn, child = parent[order], turn[order], child[order]
        heads = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if n > 1 else np.empty(0, np.int64)
        counts = np.diff(np.r_[heads, len(parent)])
        # Bases may be negative by up to n_turns, so cells are shifted by that.
        size = 2 * n + 2 * n_turns + 2
        taken = np.zeros(size, bool)
        taken[0] = True  # the root's cell
        cell_of_edge = np.empty(len(parent), np.int64)
        base_of_node = np.zeros(n, np.int64)
        # Widest nodes first: first fit over the free cells; nodes with one child then fill the gaps.
        wide = np.flatnonzero(counts > 1)
        low = 1
        for h in wide[np.argsort(-counts[wide], kind="stable")]:
            ids = turn[heads[h]:heads[h] + counts[h]]
            base = low - ids[0]
            while True:
                want = base + ids
                if want[-1] >= len(taken):
                    taken = np.r_[taken, np.zeros(len(taken) + int(want[-1]), bool)]
                hit = taken[want]
                if not hit.any():
                    break
                # The last id that collides must at least move to the next free cell.
                at = int(want[np.flatnonzero(hit)[-1]])
                gap = np.flatnonzero(~taken[at:at + 4096])
                base += int(gap[0]) if len(gap) else 4096
            taken[want] = True
            while low < len(taken) and taken[low]:
                low += 1
            cell_of_edge[heads[h]:heads[h] + counts[h]] = want
            base_of_node[parent[heads[h]]] = base
        single = heads[counts == 1]
        free = np.flatnonzero(~taken)
        if len(free) < len(single):
            free = np.r_[free, np.arange(len(taken), len(taken) + len(single))]
        free = free[:len(single)]
        cell_of_edge[single] = free
        base_of_node[parent[single]] = free - turn[single]
        cells = int(max(cell_of_edge, default=0)) + 1
        self.base, self.check, self.node = np.zeros(cells, np.int64), np.full(cells, -1, np.int64), np.zeros(cells, np.int64)
        cell_of_node = np.zeros(n, np.int64)
        cell_of_node[child] = cell_of_edge
        self.base[cell_of_node] = base_of_node
        self.check[cell_of_edge] = cell_of_node[parent]
        self.node[cell_of_edge] = child

    def step(self, cell: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The cells of the children; -1 where there is none."""
        to = self.base[cell] + turn
        inside = (to >= 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == cell), to, -1)


def _shard(paths: list[bytes], n: np.ndarray, conv: np.ndarray, lens: list[np.ndarray], ends: list[str]) -> pd.DataFrame:
    """The nodes of the trie of sorted, distinct paths."""
    depth = np.array([len(p) // DIGEST for p in paths])
    starts = np.r_[0, np.cumsum(depth)[:-1]]
    _, turns = np.unique(np.frombuffer(b"".join(paths), f"S{DIGEST}"), return_inverse=True) if depth.any() else (None, np.empty(0, np.int64))
    n_turns, tall = int(turns.max(initial=-1)) + 1, int(depth.max())
    # Edges level by level: the paths are sorted, so equal prefixes are neighbours.
    at, edges, made = np.zeros(len(paths), np.int64), [], 1
    for d in range(tall):
        live = np.flatnonzero(depth > d)
        pair = at[live] * n_turns + turns[starts[live] + d]
        new = np.r_[True, pair[1:] != pair[:-1]]
        number = made + np.cumsum(new) - 1
        edges.append((at[live][new], turns[starts[live] + d][new], number[new]))
        at[live], made = number, made + int(new.sum())
    parent, turn, child = (np.concatenate(x) if edges else np.empty(0, np.int64) for x in (zip(*edges, strict=True) if edges else ((), (), ())))
    trie = DoubleArray(parent, turn, child, max(n_turns, 1))
    # Traversal: every sequence adds to the nodes it passes.
    count, least = np.zeros(made, np.int64), np.full(made, np.iinfo(np.int64).max)
    size, level = np.zeros(made, np.int64), np.zeros(made, np.int64)
    above, keys = np.full(made, -1), np.empty(made, object)
    sha = np.full(made, None, object)
    cell, node = np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64)
    count[0], least[0] = n.sum(), conv.min()
    flat = np.concatenate(lens) if depth.any() else np.empty(0, np.int64)
    digests = [hashlib.md5() for _ in paths]
    keys[0] = digests[0].digest()
    for i in np.flatnonzero(depth == 0):
        sha[0] = ends[i]
    boundary = np.zeros(made, bool)
    boundary[0] = True
    for d in range(tall):
        live = np.flatnonzero(depth > d)
        cell[live] = trie.step(cell[live], turns[starts[live] + d])
        to = trie.node[cell[live]]
        np.add.at(count, to, n[live])
        np.minimum.at(least, to, conv[live])
        size[to], level[to], above[to] = flat[starts[live] + d], d + 1, node[live]
        node[live] = to
        for i, v in zip(live, to, strict=True):
            digests[i].update(paths[i][d * DIGEST:(d + 1) * DIGEST])
            if keys[v] is None:
                keys[v] = digests[i].digest()
            if depth[i] == d + 1:
                sha[v] = ends[i]
        for i in (0, len(paths) - 1):
            if depth[i] > d:
                boundary[node[i]] = True
    # Bottom up: what hangs below a node; a boundary node's totals stay with itself.
    kids = np.bincount(above[1:], minlength=made)
    inner = np.bincount(above[1:], weights=~boundary[1:], minlength=made).astype(np.int64)
    leaves = np.where(boundary, 0, kids == 0).astype(np.int64)
    saved = np.where(boundary, 0, (count - 1) * size)
    by_level = np.argsort(-level, kind="stable")
    for part in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
        part = part[~boundary[part]]
        np.add.at(leaves, above[part], leaves[part])
        np.add.at(saved, above[part], saved[part])
    over = [None] * made
    for v in np.flatnonzero(boundary):  # numbered from the root down
        over[v] = [*over[above[v]], keys[above[v]]] if v else []
    # A parent on the boundary has its smallest member from the merging, not from here.
    known = (above >= 0) & ~boundary[above] & ~boundary
    return pd.DataFrame({
        "key": keys, "parent": [keys[p] if p >= 0 else None for p in above], "depth": level, "conv_id": least, "n_convs": count, "chars": size,
        "ends_sha256": sha, "n_children": np.where(boundary, inner, kids), "n_leaves": leaves, "saved_tokens": saved, "shared": boundary, "above": over,
        "shard": digests[0].digest(), "parent_conv_id": pd.arrays.IntegerArray(np.where(known, least[above], 0), ~known)})


def _tries(batches: Iterator[pd.DataFrame], shard_turns: int) -> Iterator[pd.DataFrame]:
    """Shards of a sorted partition; pieces of one path are folded while they stream by."""
    paths, n, conv, lens, ends, held = [], [], [], [], [], 0
    path, listed = None, None

    def close() -> None:
        if path is not None:
            ends.append(listed.hexdigest())

    def cut() -> pd.DataFrame:
        return _shard(paths, np.array(n), np.array(conv), lens, ends)

    for batch in batches:
        for p, ids, k, c, sizes in zip(batch["path"], batch["ids"], batch["n"], batch["conv_id"], batch["lens"], strict=True):
            if p == path:
                n[-1] += k
                conv[-1] = min(conv[-1], c)
                listed.update(b"," + ids.encode())
                continue
            close()
            if held > shard_turns:
                yield cut()
                paths, n, conv, lens, ends, held = [], [], [], [], [], 0
            path, listed = bytes(p), hashlib.sha256(ids.encode())
            paths.append(path)
            n.append(k)
            conv.append(c)
            lens.append(np.asarray(sizes, np.int64))
            held += len(sizes) + 1
    close()
    if paths:
        yield cut()


def own_turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, turns) of conversations with an id; turns are (turn, digest, chars) in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
                    F.length(text).alias("chars"))
    rows = conversations.where("conv_id IS NOT NULL").select((F.col("conv_id") - F.col("conv_id") % 100).alias("base"), "conv_id", turn.alias("t"))
    # All conversations of a base share the partition, so that the join below needs no further exchange.
    return rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, taken: Column) -> DataFrame:
    """(conv_id, path, lens): the first ``taken`` turns of the base conversation, then the own turns after as many.

    A base serves 100 conversations at most.
    """
    convs = own_turns(conversations)
    heads = convs.where("conv_id = base").select("base", F.col("turns").alias("head"))
    turns = F.concat(F.slice(F.coalesce("head", F.array().cast(convs.schema["turns"].dataType)), F.lit(1), taken),
                     F.slice("turns", taken + 1, F.greatest(F.size("turns"), F.lit(1))))
    return (convs.join(heads, "base", "left").select("conv_id", turns.alias("turns"))
            .select("conv_id", F.unhex(F.array_join(F.col("turns")["digest"], "")).alias("path"), F.col("turns")["chars"].alias("lens")))


def prefix_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of ``sequences(conv_id, path, lens)``.

    conv_id is the smallest member; n_leaves and saved_tokens are summed over the subtree;
    ends_sha256 is over the ids of the members that end at the node.
    """
    bucket = F.shiftright("conv_id", ID_BUCKET).alias("bucket")
    pieces = sequences.groupBy("path", bucket).agg(F.sort_array(F.collect_list("conv_id")).alias("c"), F.first("lens").alias("lens"))
    pieces = write_and_reread(pieces.select("path", "bucket", F.array_join("c", ",").alias("ids"), F.size("c").cast("long").alias("n"),
                                            F.col("c")[0].alias("conv_id"), "lens"), "paths")
    with batches_of(sequences.sparkSession, BATCH_ROWS):
        found = pieces.repartitionByRange("path").sortWithinPartitions("path", "bucket").mapInPandas(lambda batches: _tries(batches, shard_turns), NODES)
        nodes = write_and_reread(found, "nodes")
    edge = nodes.where("shared")
    merged = write_and_reread(edge.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.first("chars").alias("chars"), F.max("ends_sha256").alias("ends_sha256"), F.sum("n_children").alias("inner"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.first("above").alias("above")), "upper")
    outer = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("outer"))
    merged = merged.join(outer, "key", "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0)))
    # A merged node and what hangs off it count for itself and for every node above it.
    mine = merged.select(F.explode(F.concat("above", F.array("key"))).alias("key"),
                         (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"),
                         (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    totals = mine.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    upper = merged.drop("n_leaves", "saved_tokens").join(totals, "key").join(parents, "parent", "left")
    # Other nodes ask their own shard's copy of the parent, so that the root is no hot key.
    copies = edge.select("key", "shard").join(parents.withColumnRenamed("parent", "key"), "key").withColumnRenamed("key", "parent")
    single = nodes.where("not shared")
    below = single.where("parent_conv_id is null").drop("parent_conv_id").join(copies, ["parent", "shard"])
    columns = ["key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = single.where("parent_conv_id is not null").select(columns).unionByName(below.select(columns)).unionByName(upper.select(columns))
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
