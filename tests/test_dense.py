import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import dense
from gleaner.operators.dense import dense_explain, dense_top_k
from gleaner.plugins.embedders import HashEmbedder

SCHEMA = "chunk_id string, no int, grp string, embedding array<float>"


def table(spark, rows):
    return spark.createDataFrame(
        [(f"c{i}", i, "even" if i % 2 == 0 else "odd", [float(x) for x in v])
         for i, v in enumerate(rows)], SCHEMA,
    )


def asks(spark, vectors, groups=None):
    rows = [(f"q{i}", [float(x) for x in v], groups[i] if groups else None)
            for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "query_id string, vector array<float>, group string")


def brute(rows, query, k, keep=lambda i: True):
    q = np.asarray(query, dtype=np.float32).astype(float)
    if not q.any():
        return []
    out = []
    for i, v in enumerate(np.asarray(rows, dtype=np.float32).astype(float)):
        length = np.linalg.norm(v) * np.linalg.norm(q)
        out.append((round(float(v @ q / length) if length else 0.0, 9), i))
    return [i for _, i in sorted(out, reverse=True) if keep(i)][:k]


def ids(found, q):
    rows = sorted((r["rank"], r["no"]) for r in found if r["query_id"] == q)
    assert [r for r, _ in rows] == list(range(1, len(rows) + 1))
    return [n for _, n in rows]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 6))
    base[7] = 0                      # a row without length
    base[20:45] = base[19]           # many copies that tie
    return base


@pytest.mark.parametrize("limit", [10_000, 6])
def test_matches_brute_force_on_both_paths(spark, rows, limit):
    queries = np.vstack([rows[19], rows[3], np.zeros(6), -rows[19]])
    found = dense_top_k(
        table(spark, rows).repartition(5), asks(spark, queries), 9, order_by=("no",),
        matrix_limit=limit,
    ).collect()
    for i, q in enumerate(queries):
        assert ids(found, f"q{i}") == brute(rows, q, 9)


def test_k_is_clipped_and_checked(spark, rows):
    few = table(spark, rows[:3])
    assert dense_top_k(few, asks(spark, rows[:1]), 50, order_by=("no",)).count() == 3
    assert dense_top_k(few, asks(spark, rows[:1]), 0).count() == 0
    assert dense_top_k(few.limit(0), asks(spark, rows[:1]), 5).count() == 0
    with pytest.raises(ValueError, match="top_k must be >= 0, got -1"):
        dense_top_k(few, asks(spark, rows[:1]), -1)


def test_filters_apply_before_ranking(spark, rows):
    vectors = table(spark, rows)
    one = dense_top_k(vectors, asks(spark, rows[:1]), 5, where=F.col("grp") == "odd",
                      order_by=("no",)).collect()
    assert ids(one, "q0") == brute(rows, rows[0], 5, lambda i: i % 2)
    mixed = dense_top_k(
        vectors, asks(spark, rows[:3], ["odd", None, "even"]), 5, group="grp", order_by=("no",),
    ).collect()
    assert ids(mixed, "q0") == brute(rows, rows[0], 5, lambda i: i % 2)
    assert ids(mixed, "q1") == brute(rows, rows[1], 5)
    assert ids(mixed, "q2") == brute(rows, rows[2], 5, lambda i: i % 2 == 0)


def scanned(rows, queries, k, batch, groups=None, admits=None):
    """Ids per query from a scanner fed batch by batch, and the scanner."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    admits = np.array(admits if admits else [None] * len(queries), dtype=object)
    scanner = dense.Scanner(unit(queries), np.array([f"q{i}" for i in range(len(queries))], dtype=object), admits, k)
    found = {}
    for a in range(0, len(rows), batch):
        part = rows[a:a + batch]
        table = pa.table({"chunk_id": [f"{i:07d}" for i in range(a, a + len(part))], "embedding": pa.array(list(part), pa.list_(pa.float64())),
                          "payload_group": pa.array(groups[a:a + batch] if groups else [None] * len(part), pa.string())})
        for r in scanner.scan(table).to_pylist():
            found.setdefault(r["query_id"], []).append((np.floor(r["score"] * 1e9 + 0.5), r["chunk_id"]))
    return {q: [int(i) for _, i in sorted(x, reverse=True)[:k]] for q, x in found.items()}, scanner, sum(map(len, found.values()))


def test_blocks_are_bounded_and_skipped():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((16, 24)) * 6
    # Clusters of unequal size, copies among them, in random order.
    rows = centres[rng.integers(0, 16, 12_000)] + rng.standard_normal((12_000, 24)) * 0.4
    rows[500:900] = rows[499]
    queries = np.r_[centres[rng.integers(0, 16, 5_000)] + rng.standard_normal((5_000, 24)) * 0.3, rows[499:500]]
    got, scanner, emitted = scanned(rows, queries, 5, 4_000)
    assert scanner.largest <= dense.SCORE_BYTES < len(queries) * dense.BLOCK_ROWS * 8
    assert scanner.skipped > 0.5 * (scanner.skipped + scanner.scored)
    assert emitted < len(queries) * 5 * 3
    for i in [*range(0, 5_000, 97), 5_000]:
        assert got[f"q{i}"] == brute_double(rows, queries[i], 5)


def brute_double(rows, q, k, keep=lambda i: True):
    keys = np.floor(rows @ q / np.linalg.norm(rows, axis=1) / np.linalg.norm(q) * 1e9 + 0.5)
    return [i for i in sorted(range(len(rows)), key=lambda i: (-keys[i], -i)) if keep(i)][:k]


def test_blocks_respect_filters_and_directions():
    rng = np.random.default_rng(9)
    rows = rng.standard_normal((3_000, 3))
    queries = np.r_[rows[:40], -rows[:40]]
    groups = ["a" if i % 3 else "b" for i in range(3_000)]
    admits = [None if i % 2 else "b" for i in range(80)]
    got, _, _ = scanned(rows, queries, 7, 700, groups, admits)
    for i in range(80):
        assert got[f"q{i}"] == brute_double(rows, queries[i], 7, lambda r: admits[i] is None or groups[r] == admits[i])


def test_explanation_reproduces_the_score(spark, rows):
    vectors, queries = table(spark, rows), asks(spark, rows[:2])
    found = dense_top_k(vectors, queries, 4, order_by=("no",))
    for r in dense_explain(vectors, queries, found, 3).collect():
        assert r["cosine_similarity"] == pytest.approx(r["score"], abs=1e-12)
        assert r["dimension"] == 6 and len(r["chunk_vector_preview"]) == 3
    with pytest.raises(ValueError, match="preview_dimensions"):
        dense_explain(vectors, queries, found, -1)


def test_hash_embedder_is_deterministic_and_unit(spark):
    a = HashEmbedder(8).embed(["one", "two", "one"])
    assert a.dtype == np.float32 and (a[0] == a[2]).all() and (a[0] != a[1]).any()
    assert np.linalg.norm(a, axis=1) == pytest.approx([1, 1, 1])
    df = spark.createDataFrame([("one",)], "t string")
    got = df.select(HashEmbedder(8).vector(F.col("t")).alias("v")).first()["v"]
    assert got == pytest.approx(a[0].tolist())


def test_unknown_ids_and_widths_are_errors(spark, rows):
    vectors, queries = table(spark, rows), asks(spark, rows[:2])
    found = dense_top_k(vectors, queries, 2, order_by=("no",))
    for wrong, message in ((vectors.where("chunk_id <> 'c0'"), "unknown chunk: c0"),
                           (vectors.withColumn("embedding", F.slice("embedding", 1, 4)), "dimension mismatch")):
        with pytest.raises(Exception, match=message):
            dense_explain(wrong, queries, found).collect()
    with pytest.raises(Exception, match="unknown query: q1"):
        dense_explain(vectors, queries.where("query_id = 'q0'"), found).collect()
    mixed = vectors.withColumn("embedding", F.when(F.col("no") == 5, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    for limit in (10_000, 6):
        with pytest.raises(Exception, match="dimension mismatch"):
            dense_top_k(mixed, queries, 2, matrix_limit=limit).collect()
