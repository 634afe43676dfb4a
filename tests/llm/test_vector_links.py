"""Visits return a row per linked vector; joins of many rows are never broadcast; ids with several vectors."""

from collections import defaultdict

import numpy as np
import pytest

from gleaner.llm import embeddings, graph

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, ids, v, labels):
    return spark.createDataFrame([(i, [float(x) for x in w], k) for i, w, k in zip(ids, v, labels, strict=True)], SCHEMA)


def expected(ids, v, labels):
    """By brute force: n_links and component of every id; an id's links are to other ids, whose vectors count one by one."""
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None])
    to, parent = defaultdict(set), {i: i for i in ids}
    for a, b in zip(*np.nonzero(near), strict=True):
        if ids[a] != ids[b]:
            to[ids[a]].add(ids[b])

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in to:
        for b in to[a]:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (sum(ids.count(b) for b in to[i]), root(i)) for i in ids}


@pytest.fixture
def near_copies():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    v = np.concatenate([base, base[7] + rng.standard_normal((240, 16)) * 0.02, base[20:60] + rng.standard_normal((40, 16)) * 0.03])
    return v.astype(np.float32)


@pytest.mark.parametrize("shard", [2_000, 60])
def test_links_of_near_copies_are_not_written_pair_by_pair(spark, monkeypatch, near_copies, shard):
    tables = {}

    def written(df, name, f=embeddings.write_and_reread):
        tables[name] = f(df, name)
        return tables[name]

    monkeypatch.setattr(embeddings, "SHARD", shard)
    monkeypatch.setattr(embeddings, "write_and_reread", written)
    n = len(near_copies)
    got = embeddings.near_duplicate_vectors(table(spark, range(n), near_copies, [1] * n)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == expected(list(range(n)), near_copies, [1] * n)
    assert sum(r["n_links"] for r in got) > 50_000
    assert tables["links"].count() <= 4 * n


@pytest.mark.parametrize("pairs", [500_000, 100])
def test_ids_with_several_vectors(spark, monkeypatch, near_copies, pairs):
    monkeypatch.setattr(embeddings, "SHARD", 60)
    monkeypatch.setattr(embeddings, "PAIRS", pairs, raising=False)
    rng = np.random.default_rng(9)
    n = len(near_copies)
    ids = [int(x) for x in np.where(rng.random(n) < 0.3, rng.integers(0, n, n), np.arange(n))]
    labels = [int(x) for x in rng.integers(0, 2, n)]
    got = embeddings.near_duplicate_vectors(table(spark, ids, near_copies, labels)).collect()
    want = expected(ids, near_copies, labels)
    assert len(got) == n > len(want)
    assert all((r["n_links"], r["component_id"]) == want[r["vec_id"]] for r in got)


def test_groups_are_united_over_any_order_of_pairs():
    rng = np.random.default_rng(2)
    pairs = [*zip(range(199, 0, -1), range(198, -1, -1), strict=True), *zip(range(300, 400), range(500, 600), strict=True)]
    rng.shuffle(pairs)
    a, b = np.array(pairs).T
    roots = np.arange(700)
    embeddings.unite(roots, a[:90], b[:90])
    embeddings.unite(roots, b[90:], a[90:])
    assert roots.tolist() == [0] * 200 + list(range(200, 500)) + list(range(300, 400)) + list(range(600, 700))


def test_small_files_of_many_rows_are_not_broadcast(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 400, 2)], "a long, b long")
    plans = []

    def written(df, name, f=graph.write_and_reread):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return f(df, name)

    monkeypatch.setattr(graph, "write_and_reread", written)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 399, raising=False)
    found = {r["v"]: r["c"] for r in graph.components(edges).collect()}
    assert found == {i: i // 2 * 2 for i in range(400)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
