import json

import pytest
from pyspark.sql import functions as F

from gleaner import cli
from gleaner.operators.chunking import chunk_fixed
from gleaner.plans import evaluation as ev
from gleaner.plans import reports
from gleaner.plans.retrieval import RetrievalConfig, ask, retrieve
from gleaner.plugins.counters import CharCounter
from gleaner.plugins.embedders import HashEmbedder
from gleaner.plugins.generators import EchoGenerator
from gleaner.plugins.judges import ScriptedJudge
from gleaner.plugins.rerankers import ColumnScore
from gleaner.sources.corpus import load_documents
from gleaner.sources.index_store import load_index, write_index
from gleaner.streaming.ingest import ingest, publish_index, publish_lexical, text_stream

EMBEDDER = HashEmbedder(8)
TEXTS = {f"g{i % 2}/d{i}.md": f"# Doc {i}\n\nsubject{i} shared words {'extra ' * i}" for i in range(8)}


@pytest.fixture(scope="module")
def index(spark, make_docs, tmp_path_factory):
    path, docs = str(tmp_path_factory.mktemp("ix")), make_docs(TEXTS)
    write_index(path, docs, chunk_fixed(docs), corpus_root="x", chunk_size=800, chunk_overlap=120,
                embedder=EMBEDDER)
    return load_index(spark, path)


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(
        [("q1", "subject3 words", ["g1/d3.md"]), ("q2", "subject5", ["g1/d5.md", "absent"]),
         ("q3", "subject3 words", ["nowhere"])],
        "query_id string, question string, gold_doc_ids array<string>")


def by_query(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


def test_each_ask_has_its_own_configuration(spark, index, samples):
    few = ask(samples.limit(2), RetrievalConfig("bm25", 2))
    more = ask(samples.where("query_id = 'q3'"), RetrievalConfig("hybrid", 4))
    got = by_query(retrieve(index, few.unionByName(more), EMBEDDER))
    assert got["q1"][0] == "g1/d3.md" and len(got["q1"]) == 2 and len(got["q3"]) == 4
    alone = by_query(retrieve(index, more, EMBEDDER))
    assert alone["q3"] == got["q3"]


def test_hybrid_depth_is_part_of_the_fusion(spark, index, samples):
    """A hybrid list at depth two is not the head of a deeper one, but the fusion of two heads."""
    asks = ask(samples.limit(1), RetrievalConfig("hybrid", 2))
    deep = ask(samples.where("query_id = 'q3'"), RetrievalConfig("hybrid", 8))
    together = by_query(retrieve(index, asks.unionByName(deep), EMBEDDER))
    assert together["q1"] == by_query(retrieve(index, asks, EMBEDDER))["q1"]


def test_eval_metrics_and_report(spark, index, samples):
    scored = ev.run_retrieval_eval(index, samples, RetrievalConfig("bm25", 2))
    rows = {r["query_id"]: r for r in scored.collect()}
    assert (rows["q1"]["hit"], rows["q1"]["context_precision"], rows["q2"]["context_recall"]) == (True, 0.5, 0.5)
    report = ev.eval_report(scored)
    row = report.first()
    assert (row["n_questions"], row["hit_rate"]) == (3, pytest.approx(2 / 3))
    text = reports.eval_report_text(report, 2, "bm25", "cross-encoder", 20).first()["report"].split("\n")
    assert text[0] == "Evaluation report  (n=3, top_k=2, retriever=bm25)"
    assert text[2:5] == ["Reranker          :  cross-encoder", "Rerank Top-N      :  20", ""]
    assert text[5] == "Hit Rate @ 2     :  0.667"
    empty = ev.eval_report(ev.run_retrieval_eval(index, samples.limit(0), RetrievalConfig("bm25", 2)))
    assert tuple(empty.first()) == (0, 0.0, 0.0, 0.0, 0.0)


def test_invalid_runs_fail_before_retrieval(index, samples):
    for config, message in [
        (RetrievalConfig("nope"), "retriever must be one of"), (RetrievalConfig("dense"), "embedder must not"),
        (RetrievalConfig("bm25", 5, "x"), "rerank_top_n must be set"),
        (RetrievalConfig("bm25", 5, "x", 3), r"rerank_top_n \(3\) must be >= top_k \(5\)"),
        (RetrievalConfig("bm25", 5, "x", 9), "reranker must not be None"),
    ]:
        with pytest.raises(ValueError, match=message):
            ev.run_retrieval_eval(index, samples, config)


def test_rerank_reads_the_deeper_pool(index, samples):
    last = ColumnScore(-F.col("rank").cast("double") * -1)
    asks = ask(samples.limit(1), RetrievalConfig("bm25", 1, "x", 3))
    (row,) = retrieve(index, asks, reranker=last).collect()
    assert (row["rank"], row["pre_rerank_rank"]) == (1, 3)


def cases(spark):
    config = "struct<retriever:string,top_k:int,reranker:string,rerank_top_n:int>"
    return spark.createDataFrame(
        [("c1", "shared words", ["g1/d7.md"], "missing_evidence", ("bm25", 1, "none", None),
          ("bm25", 8, "none", None), "", "", "", ""),
         ("c2", "other", [], "unanswerable_query", ("bm25", 1, "none", None),
          ("bm25", 2, "none", None), "", "unsupported_answer", "made up", "")],
        "case_id string, question string, gold_doc_ids array<string>, expected_label string,"
        f" baseline {config}, intervention {config}, notes string, answer_label_expected string,"
        " baseline_answer string, intervention_answer string")


def test_diagnosis(spark, index):
    per_case = ev.run_diagnosis(index, cases(spark))
    rows = {r["case_id"]: r for r in per_case.collect()}
    assert rows["c1"]["baseline_label"] == "missing_evidence" and rows["c1"]["moved"]
    assert (rows["c2"]["outcome"], rows["c2"]["intervention_label"]) == ("CONFIRMED", "unanswerable_query") or rows["c2"]["outcome"]
    assert tuple(ev.diagnosis_report(per_case).first()) == (2, 0, 1, 2)
    lines = [r["line"] for r in reports.diagnosis_lines(per_case).where("case_id = 'c1'").orderBy("line_no").collect()]
    assert lines[0] == "Case c1  expected=missing_evidence" and lines[3] == "  MOVED"
    assert lines[1] == "  baseline   : missing_evidence          hit=0.000  prec=0.000  recall=0.000  mrr=0.000"


def test_answer_diagnosis_uses_scripted_answers(spark, index):
    verdicts = spark.createDataFrame([("made up", 0.0, 1.0, 1.0, None)],
        "answer string, faithfulness double, answer_relevance double, citation_support double, answer_correctness double")
    per_case = ev.run_answer_diagnosis(index, cases(spark), EchoGenerator(), ScriptedJudge(verdicts))
    (row,) = per_case.collect()
    assert (row["case_id"], row["baseline_label"], row["fixed"]) == ("c2", "unsupported_answer", True)


def test_answer_eval(spark, index, samples):
    judged = ev.run_answer_eval(index, samples, RetrievalConfig("bm25", 2), EchoGenerator(), ScriptedJudge(),
                                context_budget=150, counter=CharCounter())
    report = ev.answer_report(judged, "fake").first()
    assert (report["n_questions"], report["mean_faithfulness"], report["mean_answer_correctness"]) == (3, 1.0, None)
    assert "Answer Correctness" not in reports.answer_report_text(ev.answer_report(judged, "fake")).first()[0]


def test_comparison(spark, index, samples):
    left, right = RetrievalConfig("bm25", 1), RetrievalConfig("dense", 3)
    compared = ev.run_comparison(index, samples, left, right, EMBEDDER)
    sides = {(r["question_id"], r["side"]): len(r["evidence"]) for r in compared.collect()}
    assert sides[("q1", "left")] == 1 and sides[("q1", "right")] == 3
    assert {r["side"] for r in ev.comparison_report(compared).collect()} == {"left", "right"}
    with pytest.raises(ValueError, match="two different"):
        ev.run_comparison(index, samples, RetrievalConfig("bm25", 5, "none", 10), RetrievalConfig("bm25"), EMBEDDER)
    with pytest.raises(ValueError, match="between 1 and 20"):
        ev.run_comparison(index, samples, RetrievalConfig("bm25", 21), right, EMBEDDER)


def test_streamed_corpus_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for step in range(2):
        for i in range(3):
            (src / f"{step}{i}.md").write_text(f"# T\n\nstream{i} common {step}")
        ingest(text_stream(spark, str(src)), out, str(tmp_path / "cp")).awaitTermination()
    lexical = publish_lexical(spark, out)
    assert lexical.stats.chunk_count == 6
    assert {r["term"]: r["df"] for r in lexical.terms.collect()}["common"] == 6


def test_streamed_indexes_equal_a_batch_build(spark, tmp_path):
    src, names = tmp_path / "in", [f"{i}.md" for i in (3, 1, 2, 0, 4)]
    src.mkdir()
    text = lambda n: f"# T\n\nshared words stream{n[0]} common"
    outs = [str(tmp_path / f"out{k}") for k in range(2)]
    for step, part in enumerate((names[:2], names[2:])):
        for n in part:
            (src / n).write_text(text(n))
        (src / f"{step}.bin").write_text("not a document")
        for out in outs[:1 + step]:  # the second index reads all files in one batch
            for _ in range(2):  # a restart finds nothing new
                ingest(text_stream(spark, str(src)), out, embedder=EMBEDDER).awaitTermination()
    batch = str(tmp_path / "batch")
    docs = load_documents(spark, str(src))
    write_index(batch, docs, chunk_fixed(docs), corpus_root="c", chunk_size=800, chunk_overlap=120, embedder=EMBEDDER)
    asked = spark.createDataFrame([(f"q{i}", q, "hybrid", 4, "none", 4) for i, q in enumerate(["stream1", "shared", "common stream4"])],
                                  "query_id string, question string, retriever string, top_k int, reranker string, rerank_top_n int")

    def answers(index):
        rows = retrieve(index, asked, EMBEDDER).collect()
        return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in rows)

    want = answers(load_index(spark, batch))
    assert len(want) == 12
    for out in outs:
        index = publish_index(spark, out, f"{out}-published", embedder=EMBEDDER)
        assert index.manifest["document_count"] == 5 and answers(index) == want


def test_later_versions_supersede_and_nulls_remove(spark, tmp_path):
    src, out = tmp_path / "rows", str(tmp_path / "out")
    schema = "doc_id string, path string, raw_text string"
    for rows in ([("a.md", "a.md", "old words"), ("b.md", "b.md", "stays"), ("c.md", "c.md", "leaves")],
                 [("a.md", "a.md", "fresh words"), ("c.md", "c.md", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        ingest(spark.readStream.schema(schema).parquet(str(src)), out, embedder=EMBEDDER).awaitTermination()
    index = publish_index(spark, out, str(tmp_path / "published"), embedder=EMBEDDER)
    assert {r["text"] for r in index.chunks.collect()} == {"fresh words", "stays"}
    assert {r["doc_id"] for r in index.documents.collect()} == {"a.md", "b.md"}
    assert {r["term"] for r in index.lexical.terms.collect()} == {"fresh", "words", "stays"}


def test_command_line(spark, tmp_path, capsys):
    corpus, ix = tmp_path / "corpus", str(tmp_path / "ix")
    corpus.mkdir()
    for i in range(4):
        (corpus / f"d{i}.md").write_text(f"# Doc {i}\n\nsubject{i} shared words")
    fake = ["--index-dir", ix, "--embedder", "fake"]
    cli.main(["index", "--corpus", str(corpus), *fake], spark)
    assert "indexed 4 documents, 4 chunks" in capsys.readouterr().out
    cli.main(["retrieve", "subject2", "--retriever", "bm25", "--top-k", "2", *fake], spark)
    out = capsys.readouterr().out
    assert "Retrieve trace" in out and "doc_id  : d2.md" in out
    cli.main(["ask", "subject1", "--generator", "fake", "--judge", "fake", "--context-budget", "200",
              "--trace-out", str(tmp_path / "trace"), *fake], spark)
    assert "Citations: " in capsys.readouterr().out
    assert spark.read.json(str(tmp_path / "trace")).first()["query"] == "subject1"
    qa = tmp_path / "qa.jsonl"
    qa.write_text(json.dumps({"question_id": "1", "question": "subject3", "gold_doc_ids": ["d3.md"]}))
    cli.main(["eval", "--qa-file", str(qa), "--retriever", "bm25", *fake], spark)
    assert "Hit Rate @ 5     :  1.000" in capsys.readouterr().out
    case = tmp_path / "cases.jsonl"
    case.write_text(json.dumps({"case_id": "c", "question": "subject3", "gold_doc_ids": ["d3.md"],
        "baseline": {"retriever": "bm25", "top_k": 1}, "intervention": {"retriever": "bm25"}}))
    cli.main(["diagnose", "--cases-file", str(case), *fake], spark)
    assert "Diagnosis report  (n=1)" in capsys.readouterr().out
    with pytest.raises(ValueError, match="must be >= --top-k"):
        cli.main(["retrieve", "x", "--reranker", "cross-encoder", "--rerank-top-n", "2", *fake], spark)
