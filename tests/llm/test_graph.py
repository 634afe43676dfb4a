"""Components against a plain union-find; ordered chains in logarithmic rounds."""

import random

import pytest

from gleaner.llm.graph import components, components_and_rounds, discard
from gleaner.session import write_and_reread


def plain(edges):
    parent = {v: v for e in edges for v in e if e[0] != e[1]}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {v: root(v) for v in parent}


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def test_ordered_chain_of_a_thousand(spark):
    edges = [(i, i + 1) for i in range(999)]
    found, rounds = components_and_rounds(frame(spark, edges))
    assert {r["v"]: r["c"] for r in found.collect()} == dict.fromkeys(range(1000), 0)
    assert rounds < 15


def test_random_graphs_stars_loops_and_no_edges(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(55)] + [(200, x) for x in range(201, 240)] + [(7, 7), (300, 299), (299, 300)]
    assert {r["v"]: r["c"] for r in components(frame(spark, edges)).collect()} == plain(edges)
    assert components(frame(spark, [(1, 1)])).isEmpty()


def test_discard_deletes_only_what_was_written_here(spark, tmp_path):
    kept, path = frame(spark, [(1, 2)]), str(tmp_path / "own")
    kept.write.parquet(path)
    own, gone = spark.read.parquet(path), write_and_reread(kept, "gone")
    discard(own, gone, kept, None)
    assert own.count() == 1
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        spark.read.parquet(gone.inputFiles()[0])
