"""Bundles against their manifest, and several indexes from one build."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators.chunking import chunk_documents, fan_out_chunks
from gleaner.plans.bundle import bundle_identity, bundle_violations, verify_bundle
from gleaner.plans.retrieval import RetrievalConfig, ask, retrieve
from gleaner.plugins.embedders import LetterEmbedder
from gleaner.plugins.rerankers import ColumnScore
from gleaner.sources.index_store import load_index, write_index, write_indexes

LETTERS = LetterEmbedder("abcde")
CONFIGS = {"by-block": ("structural", 60, 10), "by-width": ("fixed_character", 60, 10)}
RERANKER = {"reranker_model": "m", "reranker_revision": "r"}
ASKED = "question_id string, category string, question string, gold_doc_ids array<string>"
IDENTITY = "key string, actual string, declared string, trusted string"


@pytest.fixture(scope="module")
def documents(make_docs):
    return make_docs({f"g/d{i}.md": f"# Title {i}\n\n" + f"word{i} bead cab. " * (3 + i) for i in range(6)})


@pytest.fixture(scope="module")
def built(spark, documents, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("indexes"))
    write_indexes(root, documents, CONFIGS, corpus_root="c", embedder=LETTERS)
    return {name: load_index(spark, f"{root}/{name}") for name in CONFIGS}


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(
        [("1", "a", "word1?", ["g/d1.md"]), ("2", "a", "word2?", ["g/d2.md", "g/d3.md"]), ("3", "b", "word3?", ["g/d3.md"])], ASKED)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", CONFIGS)
def test_shared_build_equals_a_build_of_its_own(spark, documents, built, name, tmp_path):
    strategy, size, overlap = CONFIGS[name]
    write_index(str(tmp_path), documents, chunk_documents(documents, strategy, size, overlap), corpus_root="c",
                chunk_size=size, chunk_overlap=overlap, chunking_strategy=strategy, embedder=LETTERS)
    alone, shared = load_index(spark, str(tmp_path)), built[name]
    assert rows(alone.chunks.drop("position")) == rows(shared.chunks.drop("position"))
    assert rows(alone.documents) == rows(shared.documents)
    assert rows(alone.vectors.drop("position")) == rows(shared.vectors.drop("position"))
    assert alone.lexical.stats == shared.lexical.stats
    same = set(alone.manifest) - {"created_at"}
    assert {k: shared.manifest[k] for k in same} == {k: alone.manifest[k] for k in same}


def test_documents_are_read_once(spark, built):
    cut = fan_out_chunks(built["by-block"].documents, CONFIGS)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert {r["index_id"] for r in cut.select("index_id").distinct().collect()} == set(CONFIGS)
    with pytest.raises(ValueError, match="semantic"):
        fan_out_chunks(cut, {"x": ("semantic", 60, 10)})


def test_every_violation_is_a_row(spark, documents):
    asked = spark.createDataFrame([
        ("1", "a", "q", ["g/d1.md", "g/d1.md", "nowhere"]), ("1", "a", "q", ["nowhere", None]), ("2", "b", "", ["g/d1.md"]),
        ("3", None, "q", []), (None, "c", "q", ["g/d2.md"]), ("4", "b", "q", None)], ASKED)
    identity = spark.createDataFrame([
        ("same", "1", "1", None), ("declared", "1", "2", None), ("trusted", "1", "1", "3"), ("null", None, None, None),
        ("gone", None, "1", None)], IDENTITY)
    got = rows(bundle_violations(asked, documents, identity, {"a": 2, "b": 3, "d": 1}))
    want = [("category", "b", "2", "3"), ("category", "c", "1", "0"), ("category", "d", "0", "1"), ("category", None, "1", "0"),
            ("gold_doc_ids", "nowhere", "2", "0"), ("identity", "declared", "1", "2"), ("identity", "gone", None, "1"),
            ("identity", "trusted", "1", "3"), ("incomplete", "2", "1", "0"), ("incomplete", "3", "1", "0"),
            ("incomplete", "4", "1", "0"), ("incomplete", None, "1", "0"), ("question_id", "1", "2", "1")]
    assert got == sorted(want, key=repr)
    empty = bundle_violations(asked.limit(0), documents, identity.limit(0), {})
    assert empty.isEmpty()


def test_bundle_that_holds_and_bundles_that_do_not(built, questions):
    index, counts = built["by-block"], {"a": 2, "b": 1}
    manifest = bundle_identity(index, questions, "m", "r")
    assert len(manifest) == 13 and manifest["question_count"] == 3
    verify_bundle(index, questions, manifest, per_category=counts, **RERANKER)
    verify_bundle(index, questions, manifest, per_category=counts, trusted={"chunk_count": manifest["chunk_count"]}, **RERANKER)
    other = questions.withColumn("gold_doc_ids", F.array(F.lit("nowhere")))
    with pytest.raises(ValueError, match="manifest: gold_doc_ids, questions_sha256$"):
        verify_bundle(index, other, manifest, per_category=counts, **RERANKER)
    with pytest.raises(ValueError, match="manifest: category, question_count, reranker_model$"):
        verify_bundle(index, questions, {**manifest, "reranker_model": "n"}, **RERANKER)


def test_components_behind_every_result(spark, built, questions):
    asked = questions.select(F.col("question_id").alias("query_id"), "question")
    asks = ask(asked.where("query_id = '1'"), RetrievalConfig("bm25", 2)).unionByName(
        ask(asked.where("query_id = '2'"), RetrievalConfig("hybrid", 3))).unionByName(
        ask(asked.where("query_id = '3'"), RetrievalConfig("hybrid", 1, "length", 4)))
    found = retrieve(built["by-block"], asks, LETTERS, ColumnScore(-F.char_length("text"), "length"), explain=True).collect()
    plain = retrieve(built["by-block"], asks, LETTERS, ColumnScore(-F.char_length("text"), "length")).collect()
    key = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in plain}
    assert key == {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in found}
    for r in found:
        parts = r["score_components"]
        if r["query_id"] == "1":
            assert parts == {"bm25_score": r["score"], "bm25_rank": r["rank"]} and r["score_semantics"] == "bm25_score"
            continue
        fused = sum(1 / (60 + parts[f"{s}_rank"]) for s in ("dense", "bm25") if f"{s}_rank" in parts)
        assert parts["rrf_score"] == pytest.approx(fused)
        if r["query_id"] == "3":
            assert (parts["reranker_score"], parts["pre_rerank_score"]) == (r["score"], parts["rrf_score"])
            assert parts["pre_rerank_rank"] == r["pre_rerank_rank"] and r["score_semantics"] == "length_score"
        else:
            assert r["score"] == parts["rrf_score"] and r["score_semantics"] == "reciprocal_rank_fusion"


def test_letter_counts(spark):
    df = spark.createDataFrame([("AbaE", ["a", "b", "ab", ""]), (None, [])], "t string, s array<string>")
    first, second = df.select(LETTERS.vector(F.col("t")).alias("v"), LETTERS.neighbour_similarity(F.col("s")).alias("n")).collect()
    assert first["v"] == [2, 1, 0, 0, 1] == LETTERS.embed(["AbaE"])[0].tolist() and second["v"] == [0] * 5
    assert first["n"] == [None, 0, pytest.approx(2 ** -0.5), 0] and second["n"] == []
