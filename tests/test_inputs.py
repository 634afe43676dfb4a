"""Gold documents of short passages, against a plain search."""

from gleaner.suite import inputs
from gleaner.suite.queries import QUERIES

TEXTS = {
    "s/1": "The cat sat.\nOn a mat", "s/2": "concatenate all Words", "s/3": "words, all words",
    "s/4": "x", "s/5": "", "s/6": "ΟΔΟΣΑ ab", "s/7": "the cat  sat on a mat today with us",
}
PASSAGES = ["cat", "cat sat", "all words", "all Words", "x", "e", "ΟΔΟΣ", "absent", "nowhere here", "sat.\nOn",
            " mat", "a", "zz", "cat  sat on a mat", "", "  "]


def test_short_passages_find_their_documents(spark, make_docs):
    docs = make_docs(TEXTS)
    rows = [(str(i), p) for i, p in enumerate(PASSAGES)] + [("none", None)]
    asked = spark.createDataFrame(rows, "query_id string, question string")
    got = sorted(map(tuple, inputs.containing_documents(docs, asked).collect()))
    texts = {r["doc_id"]: r["normalized_text"] for r in docs.collect()}
    assert got == sorted((q, d) for q, p in rows if p is not None for d, t in texts.items() if p in t)


def test_gold_of_one_and_two_words(spark, tmp_path):
    spark.createDataFrame([(1, "a", "One two three"), (2, "a", "none")], "doc_id long, source string, text string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "two"), (8, "One two"), (9, "six")], "item_id long, text string"
                          ).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["query_id"]: r["gold_doc_ids"] for r in inputs.gold(spark, str(tmp_path)).collect()}
    assert got == {"7": ["a/1"], "8": ["a/1"], "9": []}


def test_only_needed_tables_of_the_index_are_made(spark, tmp_path):
    """Corpus scalars need no postings, collections none either, rankings by words no vectors; results are the same."""
    rows = [(i, f"src{i % 2}", " ".join(f"w{j % (i + 3)} " for j in range(40 * i))) for i in range(9)]
    spark.createDataFrame([*rows, (9, "src0", None)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "w1 w2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)

    def made(what):
        return (spark.sparkContext.applicationId, sf, what) in inputs._stored

    scalars, terms = QUERIES["corpus_statistics"](spark, sf).collect(), sorted(QUERIES["term_statistics"](spark, sf).collect())
    assert not made("lexical") and not made("chunks")
    assert QUERIES["collection_check"](spark, sf).first()["points"] == scalars[0]["chunks"] > 9
    assert made("vectors") and not made("lexical")
    ix = inputs.index(spark, sf)
    assert made("lexical") and ix.vectors.count() == scalars[0]["chunks"]
    assert QUERIES["corpus_statistics"](spark, sf).collect() == scalars
    assert sorted(QUERIES["term_statistics"](spark, sf).collect()) == terms
    assert scalars[0]["tokens"] == ix.lexical.stats.token_count


def test_corpus_statistics_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["corpus_statistics"](spark, str(tmp_path)).first()
    assert tuple(got) == (0, None, None, 0, 0.0)


def test_runs_of_words_are_found_by_task_or_shuffle(spark, make_docs, monkeypatch):
    docs = make_docs({"a": "one two three four five six", "b": "TWO three\tfour\u2003five x", "c": "two three", "d": "", "e": "four five six two three four",
                      "f": "two three four five two three four five"})
    rows = [("q1", "e two three four five s"), ("q1", "one two three fo"), ("q2", "two three four"), (None, "one two thr"), ("q3", "x y z"), ("q4", "six\ntwo three")]
    passages = spark.createDataFrame(rows, "query_id string, question string")
    texts = {r["doc_id"]: r["normalized_text"] for r in docs.collect()}
    want = sorted({(str(q), d) for q, p in rows for d, t in texts.items() if p in t})
    anchors = passages.select("query_id", "question", inputs.F.slice(inputs.tokenize(inputs.F.col("question")), 2, 1).alias("run"))
    held = [sorted(map(repr, inputs._holders(docs, anchors).distinct().collect()))]
    assert "Exchange" not in inputs._holders(docs, anchors).select("doc_id")._jdf.queryExecution().sparkPlan().toString()
    assert sorted((str(q), d) for q, d in inputs.containing_documents(docs, passages).collect()) == want
    monkeypatch.setattr(inputs, "HELD_RUNS", 0)
    held.append(sorted(map(repr, inputs._holders(docs, anchors).distinct().collect())))
    assert sorted((str(q), d) for q, d in inputs.containing_documents(docs, passages).collect()) == want
    # A query id with two passages finds both for each of its documents; the search for the passage decides.
    assert set(held[1]) <= set(held[0])


def test_rankings_of_the_suite_make_no_postings(spark, tmp_path):
    spark.createDataFrame([(i, "s", f"w{i % 3} w{i} a b c") for i in range(30)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "w1 a"), (8, "w9")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = QUERIES["bm25_top_k"](spark, str(tmp_path)).orderBy("query_id", "rank").collect()
    assert len(rows) == 10 and rows[5]["doc_id"] == "s/9" and rows[5]["score"] > 0 == rows[6]["score"]
    assert inputs.index(spark, str(tmp_path), ("lexical",)).lexical.blocks is None


def test_evidence_ranks_once(spark, monkeypatch):
    from gleaner.suite import queries

    calls, ranked = [], queries._results
    monkeypatch.setattr(queries, "_results", lambda *a: calls.append(a) or ranked(*a))
    assert QUERIES["context_evidence"](spark, "/root/testdata/sf0.001").count() == 200
    assert len(calls) == 1
