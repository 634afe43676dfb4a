"""Conversation trie: many small shards against brute force, edge cases, the double array itself."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F


from gleaner.llm.oracle import ORACLE
from gleaner.llm.tries import DoubleArray, prefix_nodes, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(sequences):
    """sequences: {conv_id: [(role, text)]} -> sorted node rows."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)

    def below(k):
        leaves, saved = 0, (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        for x in children.get(k, ()):
            a, b = below(x)
            leaves, saved = leaves + a, saved + b
        return leaves or 1, saved

    rows = []
    for k, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(sequences[c]) == len(k))))
        rows.append((min(ids), len(k), min(members[k[:-1]]) if k else None, len(ids), len(children.get(k, ())), *below(k),
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, rows))


def nodes(spark, rows, shard_turns, taken=None):
    table = spark.createDataFrame(rows, SCHEMA)
    found = prefix_nodes(rebuilt(table, F.lit(0) if taken is None else taken), shard_turns)
    return sorted(repr(tuple(r)) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("shard_turns", [3, 40, 100_000])
def test_shards_merge_to_one_trie(spark, shard_turns):
    rng = random.Random(shard_turns)
    sequences = {c: [("u", rng.choice(["a", "bb", "ccc"])) for _ in range(rng.randint(1, 6))] for c in range(150)}
    sequences |= {c: [("u", "hot")] for c in range(200, 3500)}  # copies over several pieces of ids
    sequences[4000] = [("u", "hot")] + [("a", f"t{i}") for i in range(300)]
    rows = [(c, i, *t) for c, turns in sequences.items() for i, t in enumerate(turns)]
    rng.shuffle(rows)
    assert nodes(spark, rows, shard_turns) == brute(sequences)


def test_base_turns_come_first(spark):
    rows = [(100, 0, "u", "x"), (100, 1, "a", "y"), (107, None, "u", "p"), (107, 5, None, "q"), (108, 1, "u", None), (250, 3, "u", "alone")]
    got = nodes(spark, rows, 100, F.lit(1))
    want = brute({100: [("u", "x"), ("a", "y")], 107: [("u", "x"), ("", "q")], 108: [("u", "x")], 250: []})
    assert got == want


def test_nulls_repeats_and_further_columns(spark):
    rows = [(1, 0, "u", "x"), (1, 0, "u", "x"), (None, 0, "u", "lost")]
    assert nodes(spark, rows, 100) == brute({1: [("u", "x"), ("u", "x")]})
    table = spark.createDataFrame([(1, 0, "u", "x", "k", 3)], SCHEMA + ", path string, n long")
    assert prefix_nodes(rebuilt(table, F.lit(0))).count() == 2
    assert prefix_nodes(rebuilt(table.limit(0), F.lit(0))).count() == 0


def test_sql_orders_equal_turns_alike(spark, tmp_path):
    rows = [(c, t, r, x) for c in (0, 3, 104, 200, -7) for t, r, x in
            ((None, "u", "s"), (1, None, "same"), (1, "a", "same"), (2, "u", None), (2, "u", "é\n"), (3, "a", "z" * c if c > 0 else "z"))]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = con.execute(ORACLE["op13_conversation_trie"])
    names = [d[0] for d in cursor.description]
    at = [names.index(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    want = sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())
    assert nodes(spark, rows, 5, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")) == want


def test_double_array_finds_children_and_nothing_else():
    rng = np.random.default_rng(4)
    parent, turn, child, seen, n = [], [], [], {}, 1
    for _ in range(2000):
        key = (int(rng.integers(0, n)) if rng.random() < 0.8 else 0, int(rng.integers(0, 500)))
        if key not in seen:
            seen[key], n = n, n + 1
            parent.append(key[0]), turn.append(key[1]), child.append(seen[key])
    trie = DoubleArray(np.array(parent), np.array(turn), np.array(child), 500)
    cell_of = {0: 0}
    for (p, t), c in seen.items():  # parents are numbered before their children
        cell_of[c] = int(trie.step(np.array([cell_of[p]]), np.array([t]))[0])
        assert trie.node[cell_of[c]] == c
    assert len(set(cell_of.values())) == n
    for p in range(0, n, 7):
        for t in range(0, 500, 3):
            assert (trie.step(np.array([cell_of[p]]), np.array([t]))[0] >= 0) == ((p, t) in seen)


