"""Merkle manifest against a plain tree: several blocks, nulls, ties, repeated rows, empty table."""

import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from gleaner.llm.manifest import manifest, proof_digest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank long, steps string"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    for nodes in tree[:-1]:
        a = i // 3 * 3
        yield nodes[a:i], nodes[i + 1:a + 3]
        i //= 3


def plain(rows):
    """Counted result rows; those of equal source and doc_id go by leaf."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top, out = levels([trees[s][-1][0] for s in order]), []
    for k, s in enumerate(order):
        for i, (*_, h, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = [*path(trees[s], i), *path(top, k)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            root = leaf(r, r[4].replace("\n", "")) if bad else h
            for a, b in steps:
                root = sha([*a, root, *b])
            proof = sha(x for a, b in steps for x in (*a, *b))
            out.append((r[0], h, trees[s][-1][0], top[-1][0], proof, root, root == top[-1][0]))
    return Counter(out)


def spark_rows(spark, rows, digits):
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = manifest(docs, tampered, F.replace("text", F.lit("\n"), F.lit("")), digits)
    return Counter(tuple(r) for r in found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")), "folded_root", "verified").collect())


def test_several_stages_of_blocks(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "en", i, f"line {i}\nend é") for i in range(120)]
    got = spark_rows(spark, rows, 2)
    assert got == plain(rows)
    assert {r[6] for r in got} == {True, False}


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", 3, ""), (1, None, "en", 3, ""), (1, None, "de", 3, "a\nb"),
            (2, "", None, 0, "x" * 100_000), (3, "é", "fr", 1, "\n"), (-4, "z", "fr", 1, "no break")]
    assert spark_rows(spark, rows, 2) == plain(rows)


def test_lone_leaf_and_empty_table(spark):
    rows = [(5, "only", "en", 2, "t\nu")]
    assert spark_rows(spark, rows, 6) == plain(rows)
    assert sum(spark_rows(spark, [], 6).values()) == 0
