import pytest
from pyspark.sql import functions as F

from gleaner.operators import parity, rerank
from gleaner.operators.fusion import reciprocal_rank_fusion, score_components
from gleaner.plugins.rerankers import ColumnScore, KeepOrder, ScoreTable


def ranking(spark, ids, scores=None):
    rows = [("q", c, float(scores[i]) if scores else 1.0 / (i + 1), i + 1)
            for i, c in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int")


def in_order(df, column="chunk_id"):
    return [r[column] for r in df.orderBy("rank").collect()]


def test_fusion_ties_keep_first_seen_order(spark):
    fused = reciprocal_rank_fusion([ranking(spark, "ab"), ranking(spark, "cd")], 4)
    assert in_order(fused) == ["a", "c", "b", "d"]
    both = reciprocal_rank_fusion([ranking(spark, "ab"), ranking(spark, "bc")], 2)
    assert in_order(both) == ["b", "a"]
    assert both.where("chunk_id = 'b'").first()["score"] == pytest.approx(1 / 62 + 1 / 61)


def test_fusion_explains_itself(spark):
    fused = reciprocal_rank_fusion(
        [ranking(spark, "ab"), ranking(spark, "b")], 5, source_names=["dense", "bm25"]
    )
    for row in fused.collect():
        assert sum(s["contribution"] for s in row["sources"]) == pytest.approx(row["score"], abs=1e-15)
    top = fused.where("rank = 1").first()
    assert [(s["source"], s["rank"]) for s in top["sources"]] == [("dense", 2), ("bm25", 1)]
    with pytest.raises(ValueError, match="source_names must match"):
        reciprocal_rank_fusion([ranking(spark, "a")], 1, source_names=["x", "y"])
    with pytest.raises(ValueError, match="non-negative"):
        reciprocal_rank_fusion([ranking(spark, "a")], -1)


def test_components_leave_out_absent_sources(spark):
    dense, bm25 = ranking(spark, "ab"), ranking(spark, "b")
    out = score_components(reciprocal_rank_fusion([dense, bm25], 5), ("dense", dense), ("bm25", bm25))
    parts = {r["chunk_id"]: set(r["score_components"]) for r in out.collect()}
    assert parts["a"] == {"rrf_score", "dense_score", "dense_rank"}
    assert parts["b"] == parts["a"] | {"bm25_score", "bm25_rank"}


def test_rerank_audit_slice_and_movements(spark):
    base = ranking(spark, "abcd")
    scores = spark.createDataFrame([("c", 2.0), ("d", 2.0)], "chunk_id string, post_score double")
    audit = rerank.rerank_audit(base, ScoreTable(scores)).orderBy("post_rank").collect()
    assert [(r["chunk_id"], r["pre_rank"], r["post_score"]) for r in audit] == [
        ("c", 3, 2.0), ("d", 4, 2.0), ("a", 1, 0.0), ("b", 2, 0.0)]
    final = rerank.apply_rerank(base, ScoreTable(scores), 3).orderBy("rank").collect()
    assert [(r["chunk_id"], r["rank"], r["score"], r["pre_rerank_rank"]) for r in final] == [
        ("c", 1, 2.0, 3), ("d", 2, 2.0, 4), ("a", 3, 0.0, 1)]
    moves = rerank.explain_rerank(rerank.rerank_audit(base, ScoreTable(scores)), 3)
    got = [(r["chunk_id"], r["final_rank"], r["rank_delta"], r["outcome"])
           for r in moves.orderBy("pre_rank").collect()]
    assert got == [("a", 3, -2, "moved_down"), ("b", None, None, "dropped"),
                   ("c", 1, 2, "moved_up"), ("d", 2, 2, "moved_up")]


def test_keeping_order_and_expressions(spark):
    base = ranking(spark, "abc", [1, 1, 5])
    assert in_order(rerank.apply_rerank(base, KeepOrder(), 2)) == ["a", "b"]
    assert in_order(rerank.apply_rerank(base, ColumnScore(-F.col("rank")), 1)) == ["a"]
    with pytest.raises(ValueError, match="top_k must be >= 0"):
        rerank.apply_rerank(base, KeepOrder(), -1)
    with pytest.raises(ValueError, match="non-negative"):
        rerank.explain_rerank(base, -1)


def test_tie_groups_are_anchored_on_their_first_score(spark):
    got = parity.grouped_ranking(ranking(spark, "abcd", [1.0, 0.95, 0.89, 0.85]), 0.1)
    assert [r["tie_group"] for r in got.orderBy("rank").collect()] == [0, 0, 1, 1]


def test_parity(spark):
    left = ranking(spark, "abc", [0.9, 0.9000001, 0.1])
    swapped = ranking(spark, "bac", [0.9000001, 0.9, 0.1])
    items = parity.compare_rankings(left, swapped)
    assert all(r["equivalent"] for r in items.collect())
    assert parity.parity_verdict(items).first()["equivalent"]
    other = parity.compare_rankings(left, ranking(spark, "abd", [0.9, 0.9000001, 0.1]))
    rows = {r["chunk_id"]: (r["left_rank"], r["right_rank"], r["equivalent"]) for r in other.collect()}
    assert rows["c"] == (3, None, False) and rows["d"] == (None, 3, False) and rows["a"][2]
    assert not parity.parity_verdict(other).first()["equivalent"]
    with pytest.raises(ValueError, match="tolerance"):
        parity.compare_rankings(left, left, -1)
