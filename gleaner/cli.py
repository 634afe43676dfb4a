"""Command line: index, retrieve, ask, eval, diagnose."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.chunking import STRATEGIES, chunk_documents
from gleaner.plans import evaluation as ev
from gleaner.plans import reports
from gleaner.plans.retrieval import RetrievalConfig, ask, retrieve
from gleaner.plugins.counters import CharCounter, TiktokenCounter
from gleaner.plugins.embedders import HashEmbedder, SentenceTransformerEmbedder
from gleaner.plugins.generators import ChatGenerator, EchoGenerator
from gleaner.plugins.judges import ChatJudge, ScriptedJudge
from gleaner.plugins.rerankers import CrossEncoderReranker
from gleaner.session import local_session
from gleaner.sources.corpus import load_documents
from gleaner.sources.index_store import load_index, write_index
from gleaner.sources.jsonl import load_eval_samples, load_failure_cases


def _embedder(args, model: str | None = None):
    if args.embedder == "fake":
        return HashEmbedder(args.dim)
    return SentenceTransformerEmbedder(model) if model else SentenceTransformerEmbedder()


def _reranker(args):
    if args.reranker == "none":
        if args.reranker_model is not None:
            raise ValueError(
                "--reranker-model is only valid with --reranker cross-encoder, "
                f"got --reranker {args.reranker}"
            )
        return None
    if args.rerank_top_n < 1:
        raise ValueError(f"--rerank-top-n must be >= 1, got {args.rerank_top_n}")
    if args.rerank_top_n < args.top_k:
        raise ValueError(
            f"--rerank-top-n ({args.rerank_top_n}) must be >= --top-k ({args.top_k}) "
            "when --reranker is active"
        )
    return CrossEncoderReranker(args.reranker_model)


def _config(args, retriever: str) -> RetrievalConfig:
    depth = args.rerank_top_n if args.reranker != "none" else None
    return RetrievalConfig(retriever, args.top_k, args.reranker, depth)


def _provider(args) -> tuple[str, str | None, str | None]:
    return (
        args.model or os.environ.get("OPENAI_MODEL") or "gpt-4o-mini",
        args.api_key or os.environ.get("OPENAI_API_KEY"),
        args.base_url or os.environ.get("OPENAI_BASE_URL"),
    )


def _generator(args):
    return EchoGenerator() if args.generator == "fake" else ChatGenerator(*_provider(args))


def _judge(args):
    return ScriptedJudge() if args.judge in ("fake", "none") else ChatJudge(*_provider(args))


def _counter():
    """Exact token counts where the tokenizer and its vocabulary are at hand."""
    try:
        return TiktokenCounter()
    except (ImportError, OSError) as exc:
        print(f"counting characters instead of tokens: {type(exc).__name__}", file=sys.stderr)
        return CharCounter()


def _print_lines(lines: DataFrame, *order: str) -> None:
    """Stream ordered lines partition by partition."""
    for row in lines.orderBy(*order).select("line").toLocalIterator():
        print(row["line"])


def _one_question(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("q", text)], "query_id string, question string")


def cmd_index(spark: SparkSession, args) -> None:
    documents = load_documents(spark, args.corpus)
    if documents.isEmpty():
        raise SystemExit(f"no documents found in {args.corpus}")
    embedder = _embedder(args)
    semantic = args.chunking_strategy == "semantic"
    chunks = chunk_documents(
        documents, args.chunking_strategy, args.chunk_size, args.chunk_overlap,
        embedder if semantic else None, args.semantic_similarity_threshold,
    )
    manifest = write_index(
        args.index_dir, documents, chunks, corpus_root=args.corpus, chunk_size=args.chunk_size,
        chunk_overlap=args.chunk_overlap, chunking_strategy=args.chunking_strategy,
        chunking_params=(
            {"similarity_threshold": args.semantic_similarity_threshold} if semantic else {}
        ),
        embedder=embedder,
    )
    print(f"indexed {manifest['document_count']} documents, {manifest['chunk_count']} chunks"
          f" -> {args.index_dir}")


def cmd_retrieve(spark: SparkSession, args) -> None:
    reranker = _reranker(args)
    index = load_index(spark, args.index_dir)
    embedder = None
    if args.retriever != "bm25":
        embedder = _embedder(args, index.manifest.get("embedding_model"))
    asks = ask(_one_question(spark, args.query), _config(args, args.retriever))
    traces = reports.retrieve_traces(asks, retrieve(index, asks, embedder, reranker))
    _print_lines(reports.retrieve_trace_lines(traces), "line_no")
    if args.trace_out:
        reports.write_records(traces, args.trace_out)


def cmd_ask(spark: SparkSession, args) -> None:
    if args.context_budget < 0:
        raise ValueError(f"--context-budget must be >= 0, got {args.context_budget}")
    reranker = _reranker(args)
    index = load_index(spark, args.index_dir)
    embedder = _embedder(args, index.manifest.get("embedding_model"))
    asks = ask(_one_question(spark, args.query), _config(args, "dense"))
    results = retrieve(index, asks, embedder, reranker)
    judged = ev.answer_questions(
        asks, results, _generator(args), _judge(args), args.context_budget,
        _counter() if args.context_budget else None,
    )
    if args.judge == "none":
        judged = judged.withColumn("verdict", F.lit(None).cast(judged.schema["verdict"].dataType))
    traces = reports.ask_traces(reports.retrieve_traces(asks, results), judged)
    if args.output_format == "json":
        print(traces.select(F.to_json(F.struct("*"))).first()[0])
    else:
        _print_lines(reports.retrieve_trace_lines(traces), "line_no")
        _print_lines(reports.ask_trace_lines(traces), "line_no")
    if args.trace_out:
        reports.write_records(traces, args.trace_out)


def cmd_eval(spark: SparkSession, args) -> None:
    reranker = _reranker(args)
    index = load_index(spark, args.index_dir)
    embedder = None
    if args.retriever != "bm25":
        embedder = _embedder(args, index.manifest.get("embedding_model"))
    # Question ids may repeat or be empty; a row number of its own identifies a sample.
    samples = load_eval_samples(spark, args.qa_file).withColumn("query_id", F.uuid(seed=0))
    config = _config(args, args.retriever)
    scored = ev.run_retrieval_eval(index, samples, config, embedder, reranker)
    text = reports.eval_report_text(
        ev.eval_report(scored), args.top_k, args.retriever,
        reranker.name if reranker else "none", config.rerank_top_n,
    )
    print(text.first()["report"])
    if args.judge != "none":
        judge = _judge(args)
        judged = ev.run_answer_eval(
            index, samples, config, _generator(args), judge, embedder, reranker,
            args.context_budget, _counter() if args.context_budget else None,
        )
        print(reports.answer_report_text(ev.answer_report(judged, judge.name)).first()["report"])


def cmd_diagnose(spark: SparkSession, args) -> None:
    index = load_index(spark, args.index_dir)
    cases = load_failure_cases(spark, args.cases_file)
    sides = ev.case_sides(cases)
    dense = not sides.where(F.col("retriever") != "bm25").isEmpty()
    embedder = _embedder(args, index.manifest.get("embedding_model")) if dense else None
    again = not sides.where(F.col("reranker") != "none").isEmpty()
    reranker = CrossEncoderReranker(args.reranker_model) if again else None
    per_case = ev.run_diagnosis(index, cases, embedder, reranker)
    print(reports.diagnosis_header(ev.diagnosis_report(per_case)).first()["report"])
    _print_lines(reports.diagnosis_lines(per_case), "case_id", "line_no")
    if args.judge != "none":
        answers = ev.run_answer_diagnosis(
            index, cases, _generator(args), _judge(args), embedder, reranker,
            context_budget=args.context_budget,
            counter=_counter() if args.context_budget else None,
        )
        report = ev.diagnosis_report(answers)
        print(reports.diagnosis_header(report, "Answer diagnosis report").first()["report"])
        _print_lines(reports.answer_diagnosis_lines(answers), "case_id", "line_no")


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gleaner", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, *groups: str) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--index-dir", default=".gleaner/index")
        p.add_argument("--embedder", choices=["fake", "sentence-transformers"],
                       default="sentence-transformers")
        p.add_argument("--dim", type=int, default=8, help="width of the fake embedder")
        if "retriever" in groups:
            p.add_argument("--retriever", choices=["dense", "bm25", "hybrid"], default="dense")
        if "rank" in groups:
            p.add_argument("--top-k", type=int, default=5)
            p.add_argument("--reranker", choices=["none", "cross-encoder"], default="none")
            p.add_argument("--rerank-top-n", type=int, default=20)
        if "rank" in groups or "model" in groups:
            p.add_argument("--reranker-model", default=None)
        if "trace" in groups:
            p.add_argument("--trace-out", default=None)
        if "answer" in groups:
            p.add_argument("--judge", choices=["none", "fake", "openai"], default="none")
            p.add_argument("--generator", choices=["fake", "openai"], default="openai")
            p.add_argument("--context-budget", type=int, default=0)
            for option in ("--model", "--api-key", "--base-url"):
                p.add_argument(option, default=None)
        return p

    p = verb("index", cmd_index)
    p.add_argument("--corpus", required=True)
    p.add_argument("--chunk-size", type=int, default=800)
    p.add_argument("--chunk-overlap", type=int, default=120)
    p.add_argument("--chunking-strategy", choices=STRATEGIES, default="fixed_character")
    p.add_argument("--semantic-similarity-threshold", type=float, default=0.5)
    p = verb("retrieve", cmd_retrieve, "retriever", "rank", "trace")
    p.add_argument("query")
    p = verb("ask", cmd_ask, "rank", "trace", "answer")
    p.add_argument("query")
    p.add_argument("--output-format", choices=["text", "json"], default="text")
    p = verb("eval", cmd_eval, "retriever", "rank", "answer")
    p.add_argument("--qa-file", required=True)
    p = verb("diagnose", cmd_diagnose, "model", "answer")
    p.add_argument("--cases-file", required=True)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = build_parser().parse_args(argv)
    args.run(spark or SparkSession.getActiveSession() or local_session(), args)


if __name__ == "__main__":
    main()
