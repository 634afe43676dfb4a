"""Registered queries: every operator over whole tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import prepare as prep
from gleaner.functions import prompts
from gleaner.functions import text as tx
from gleaner.functions.labels import answer_label
from gleaner.functions.vectors import all_close, norm, unit
from gleaner.operators import chunking, collection, context, files, lexical, parity, rerank
from gleaner.operators.dense import dense_explain, dense_top_k
from gleaner.operators.fusion import reciprocal_rank_fusion, score_components
from gleaner.operators.prepare import extract_documents, extract_qa_pairs, first_per_key
from gleaner.plans import bundle
from gleaner.plans import evaluation as ev
from gleaner.plans import reports
from gleaner.plans.retrieval import RetrievalConfig, ask, base_ranking, retrieve, with_chunks
from gleaner.plugins.generators import EchoGenerator, provider_url
from gleaner.plugins.judges import ScriptedJudge, parse_reply
from gleaner.plugins.rerankers import ColumnScore
from gleaner.session import shared_dir, write_and_reread
from gleaner.sources import jsonl
from gleaner.sources.lookup import look_up_all, write_lookup
from gleaner.suite import inputs as inp

QUERIES: dict = {}
BUDGET = 520
LEXICAL = ("lexical",)  # what a ranking by words alone needs of the index


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _r(column: str | Column, name: str, digits: int = 6) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, digits).alias(name)


def _n(column: str | Column, name: str) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return value.cast("long").alias(name)


def _list(column: str | Column, name: str) -> Column:
    return F.array_join(column, "|").alias(name)


# ---------------------------------------------------------------- text functions

@query
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return inp.documents(spark, sf).select(
        "doc_id", _n(F.char_length("normalized_text"), "n_chars"),
        tx.sha256_text(F.col("normalized_text")).alias("digest"),
    )


@query
def document_records(spark: SparkSession, sf: str) -> DataFrame:
    return inp.markdown_documents(spark, sf).select(
        "doc_id", "title", "format", "raw_hash", tx.source_group(F.col("doc_id")).alias("source_group")
    )


@query
def source_groups(spark: SparkSession, sf: str) -> DataFrame:
    docs = inp.table(spark, sf, "documents")
    return docs.groupBy(tx.source_group(inp.doc_key()).alias("source_group")).agg(
        _n(F.count("*"), "documents"), _n(F.sum(F.char_length("text")), "chars")
    )


@query
def split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    units = chunking.with_offsets(chunking.split_sentences(F.col("normalized_text")))
    return inp.documents(spark, sf).select("doc_id", F.inline(units)).select(
        "doc_id", _n("char_start", "char_start"), _n(F.char_length("text"), "n_chars")
    )


@query
def split_blocks(spark: SparkSession, sf: str) -> DataFrame:
    units = chunking.with_offsets(chunking.split_blocks(F.col("normalized_text")))
    return inp.markdown_documents(spark, sf).select("doc_id", F.inline(units)).select(
        "doc_id", _n("char_start", "char_start"), _n(F.char_length("text"), "n_chars")
    )


# ---------------------------------------------------------------- preparation

def _page_title() -> Column:
    return F.regexp_extract("html", r"<title>(.*?)</title>", 1)


@query
def url_titles(spark: SparkSession, sf: str) -> DataFrame:
    return inp.table(spark, sf, "pages").select(
        "page_id", prep.url_title(F.col("url")).alias("url_title"),
        provider_url(F.concat("url", F.lit("/chat/completions/"))).alias("provider_url"),
    )


@query
def resolve_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Plain-http pages come with a placeholder title and fall back to their URL."""
    given = F.when(F.col("url").startswith("http:"), F.lit("{{ document.title.text }}"))
    resolved = prep.resolve_title(
        given.otherwise(_page_title()), F.lit(""), F.col("url"), F.col("page_id").cast("string")
    )
    return inp.table(spark, sf, "pages").select("page_id", resolved.alias("r")).select(
        "page_id", F.col("r.title").alias("title"), F.col("r.method").alias("method")
    )


@query
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return inp.table(spark, sf, "pages").select("page_id", prep.slugify(_page_title()).alias("slug"))


@query
def markdown_headings(spark: SparkSession, sf: str) -> DataFrame:
    """First usable heading; one inside a fence does not count."""
    docs = inp.table(spark, sf, "documents")
    text = F.concat(
        F.lit("```\n# not this\n```\n## nor this\n # "), "source", F.lit(" "), "lang",
        F.lit(" ##\n"), "text",
    )
    return docs.select(
        "doc_id", prep.first_h1(text).alias("heading"),
        tx.sha256_text(prep.doc_to_markdown(F.col("lang"), F.col("text"))).alias("markdown_digest"),
    )


@query
def first_wins_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = inp.table(spark, sf, "documents").select(
        "doc_id", "source", tx.sha256_text(F.col("text")).alias("digest")
    )
    return first_per_key(docs, "digest", "doc_id")


def _dataset_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as raw dataset rows keyed by their text's digest: copies share an id."""
    return inp.table(spark, sf, "documents").select(
        F.col("doc_id").alias("input_pos"), tx.sha256_text(F.col("text")).alias("doc_id"),
        F.concat_ws(" ", "source", "lang").alias("title"), F.lit("").alias("md_document"),
        F.col("text").alias("document"), F.lit("").alias("url"),
    )


@query
def prepared_documents(spark: SparkSession, sf: str) -> DataFrame:
    return extract_documents(_dataset_rows(spark, sf)).select(
        "doc_id", "title", "title_resolution", "slug", "prepared_id",
        tx.sha256_text(F.col("markdown")).alias("markdown_digest"),
    )


@query
def gold_id_translation(spark: SparkSession, sf: str) -> DataFrame:
    """Gold documents as a comma list; those that were kept get their prepared id."""
    kept = first_wins_documents(spark, sf).select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("doc_id")
    )
    id_map = kept.select("doc_id", F.concat(
        F.lit("docs/"), prep.slugify(F.col("doc_id")), F.lit(".md")).alias("prepared_id"))
    rows = inp.gold(spark, sf).select(
        F.col("query_id").alias("input_no"), F.col("query_id").alias("question_id"), "question",
        F.lit("").alias("correct_answer"),
        F.array_join("gold_doc_ids", " , ").alias("correct_answer_document_ids"),
    )
    return extract_qa_pairs(rows, id_map).select(
        "question_id", _list("gold_doc_ids", "gold_doc_ids"), _n("unknown_ids", "unknown_ids")
    )


# ---------------------------------------------------------------- chunking

def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "chunk_id", "doc_id", _n("char_start", "char_start"), _n("char_end", "char_end"),
        tx.sha256_text(F.col("text")).alias("digest"),
    )


@query
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_rows(chunking.chunk_documents(inp.documents(spark, sf)))


@query
def chunk_structural(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_rows(
        chunking.chunk_documents(inp.markdown_documents(spark, sf), "structural", 400, 60)
    )


@query
def chunk_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """Two configurations cut side by side from one reading."""
    cut = chunking.fan_out_chunks(inp.markdown_documents(spark, sf), {
        "structural": ("structural", 400, 60), "fixed": ("fixed_character", 400, 60),
    })
    return cut.select("index_id", "chunk_id", "doc_id", _n("char_start", "char_start"), _n("char_end", "char_end"),
                      tx.sha256_text(F.col("text")).alias("digest"))


@query
def chunk_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_rows(chunking.chunk_documents(
        inp.documents(spark, sf), "semantic", embedder=inp.EMBEDDER, similarity_threshold=0.0
    ))


# ---------------------------------------------------------------- lexical

@query
def chunk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = tx.tokenize(F.col("text"))
    return inp.index(spark, sf, ()).chunks.select(
        "chunk_id", _n(F.size(tokens), "tokens"),
        _n(F.size(F.array_distinct(tokens)), "distinct_tokens"),
    )


@query
def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    terms, stats = inp.terms(spark, sf)
    return terms.select(
        "term", _n("df", "df"), _r(lexical.floored_idf(F.col("df"), stats), "idf")
    )


@query
def corpus_statistics(spark: SparkSession, sf: str) -> DataFrame:
    terms, stats = inp.terms(spark, sf)
    none = F.lit(stats.chunk_count) == 0
    return terms.agg(_n(F.count("*"), "vocabulary")).select(
        _n(F.lit(stats.chunk_count), "chunks"), F.when(~none, _n(F.lit(stats.token_count), "tokens")).alias("tokens"),
        F.when(~none, _r(F.lit(stats.average_length), "mean_length")).alias("mean_length"),
        "vocabulary", _r(F.lit(stats.mean_idf), "mean_idf"),
    )


def _bm25(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return lexical.bm25_top_k(inp.index(spark, sf, LEXICAL).lexical, inp.questions(spark, sf), k)


def _with_ids(spark: SparkSession, sf: str, ranked: DataFrame, k: int) -> DataFrame:
    limit = k * inp.questions(spark, sf).count()
    return lexical.with_ids(inp.index(spark, sf, LEXICAL).lexical, ranked, limit)


@query
def bm25_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return _with_ids(spark, sf, _bm25(spark, sf, 5), 5).select(
        "query_id", _n("rank", "rank"), "chunk_id", "doc_id", _r("score", "score")
    )


@query
def bm25_explanation(spark: SparkSession, sf: str) -> DataFrame:
    asked = inp.questions(spark, sf)
    found = lexical.bm25_explain(inp.index(spark, sf, LEXICAL).lexical, asked, _bm25(spark, sf, 3))
    return _with_ids(spark, sf, found, 3).select(
        "query_id", "chunk_id", "rank", "document_length", F.inline("terms")
    ).select(
        "query_id", "chunk_id", _n("rank", "rank"), _n("document_length", "document_length"),
        "term", _n("query_frequency", "query_frequency"), _n("term_frequency", "term_frequency"),
        _n("document_frequency", "document_frequency"),
        _r("inverse_document_frequency", "inverse_document_frequency"),
        _r("contribution", "contribution"),
    )


# ---------------------------------------------------------------- dense

def _by_centroid(spark: SparkSession, sf: str, k: int, **options) -> DataFrame:
    return dense_top_k(
        inp.vectors(spark, sf), inp.label_centroids(spark, sf), k, order_by=("vec_id",), **options
    )


@query
def dense_top_k_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return _by_centroid(spark, sf, 10).select(
        "query_id", _n("rank", "rank"), "chunk_id", _r("score", "score")
    )


@query
def dense_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Every label's search inside its own payload group."""
    queries = inp.label_centroids(spark, sf).withColumn("group", F.col("query_id"))
    return dense_top_k(
        inp.vectors(spark, sf), queries, 5, group="label", order_by=("vec_id",)
    ).select(
        "query_id", _n("rank", "rank"), "chunk_id", _r("score", "score")
    )


@query
def dense_explanation(spark: SparkSession, sf: str) -> DataFrame:
    vectors = inp.vectors(spark, sf)
    found = dense_explain(
        vectors, inp.label_centroids(spark, sf), _by_centroid(spark, sf, 5), 3
    )
    return found.select(
        "query_id", "chunk_id", _n("rank", "rank"), _n("dimension", "dimension"),
        _r("query_norm", "query_norm"), _r("chunk_norm", "chunk_norm"),
        _r("dot_product", "dot_product"), _r("cosine_similarity", "cosine_similarity"),
        _r(F.get("query_vector_preview", F.lit(2)), "query_preview_3"),
        _r(F.get("chunk_vector_preview", F.lit(2)).cast("double"), "chunk_preview_3"),
    )


@query
def vector_units(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    return inp.table(spark, sf, "embeddings").select(
        "vec_id", _r(norm(v), "length"), _r(F.get(unit(v), F.lit(0)), "first"),
        all_close(unit(v), v, 1e-5).alias("is_unit"),
    )


@query
def dense_label_eval(spark: SparkSession, sf: str) -> DataFrame:
    """How well a label's mean vector finds members of the label."""
    vectors = inp.vectors(spark, sf)
    found = _by_centroid(spark, sf, 10).join(vectors.select("chunk_id", "label"), "chunk_id")
    results = found.withColumn("doc_id", F.col("label").cast("string"))
    asked = inp.label_centroids(spark, sf).select(
        "query_id", F.array("query_id").alias("gold_doc_ids")
    )
    return _metric_rows(ev.score_questions(asked, results))


# ---------------------------------------------------------------- fusion, reranking

def _two_lists(spark: SparkSession, sf: str) -> list[DataFrame]:
    exemplars = dense_top_k(
        inp.vectors(spark, sf), inp.label_exemplars(spark, sf), 20, order_by=("vec_id",)
    )
    return [_by_centroid(spark, sf, 20), exemplars]


@query
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return reciprocal_rank_fusion(_two_lists(spark, sf), 10).select(
        "query_id", _n("rank", "rank"), "chunk_id", _r("score", "score", 9)
    )


@query
def rank_fusion_sources(spark: SparkSession, sf: str) -> DataFrame:
    fused = reciprocal_rank_fusion(
        _two_lists(spark, sf), 10, source_names=["centroid", "exemplar"]
    )
    return fused.select("query_id", "chunk_id", F.inline("sources")).select(
        "query_id", "chunk_id", "source", _n("rank", "rank"), _r("score", "score"),
        _r("contribution", "contribution", 9),
    )


@query
def fused_score_components(spark: SparkSession, sf: str) -> DataFrame:
    centroid, exemplar = _two_lists(spark, sf)
    fused = reciprocal_rank_fusion([centroid, exemplar], 10)
    out = score_components(fused, ("centroid", centroid), ("exemplar", exemplar))
    return out.select("query_id", "chunk_id", F.explode("score_components")).select(
        "query_id", "chunk_id", F.col("key").alias("component"), _r("value", "value")
    )


@query
def hybrid_top_k(spark: SparkSession, sf: str) -> DataFrame:
    asks = ask(inp.questions(spark, sf), RetrievalConfig("hybrid", 5))
    ranked = base_ranking(inp.index(spark, sf), asks, inp.EMBEDDER)
    return _with_ids(spark, sf, ranked, 5).select(
        "query_id", _n("rank", "rank"), "chunk_id", _r("score", "score", 9)
    )


@query
def retrieval_components(spark: SparkSession, sf: str) -> DataFrame:
    """Every question asked four ways in one run, with all scores and ranks behind the results."""
    ways = {
        "bm25": RetrievalConfig("bm25", 5), "dense": RetrievalConfig("dense", 5),
        "hybrid": RetrievalConfig("hybrid", 5), "reranked": RetrievalConfig("hybrid", 5, "length", 10),
    }
    asked = inp.questions(spark, sf)
    asks = reduce(DataFrame.unionByName, [
        ask(asked.withColumn("query_id", F.concat("query_id", F.lit(f":{way}"))), config)
        for way, config in ways.items()
    ])
    found = retrieve(inp.letter_index(spark, sf), asks, inp.LETTERS, _length_reranker(), explain=True)
    return found.select(
        "query_id", _n("rank", "rank"), "chunk_id", "score_semantics", F.explode("score_components")
    ).select(
        "query_id", "rank", "chunk_id", "score_semantics", F.col("key").alias("component"), _r("value", "value")
    )


def _length_reranker() -> ColumnScore:
    """Deterministic second score: texts of about 400 characters win."""
    return ColumnScore(-F.abs(F.char_length("text") - 400), "length")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    ranked = write_and_reread(_bm25(spark, sf, 20), "candidates")
    return with_chunks(inp.index(spark, sf, LEXICAL), ranked, 20 * inp.questions(spark, sf).count())


@query
def rerank_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.rerank_audit(_candidates(spark, sf), _length_reranker()).select(
        "query_id", "chunk_id", _n("pre_rank", "pre_rank"), _n("post_rank", "post_rank"),
        _r("pre_score", "pre_score"), _r("post_score", "post_score"),
    )


@query
def rerank_movements(spark: SparkSession, sf: str) -> DataFrame:
    audit = rerank.rerank_audit(_candidates(spark, sf), _length_reranker())
    return rerank.explain_rerank(audit, 5).select(
        "query_id", "chunk_id", _n("pre_rank", "pre_rank"), _n("final_rank", "final_rank"),
        _n("rank_delta", "rank_delta"), "outcome",
    )


def _reranked(spark: SparkSession, sf: str) -> DataFrame:
    asks = ask(inp.questions(spark, sf), RetrievalConfig("bm25", 5, "length", 20))
    return retrieve(inp.index(spark, sf, LEXICAL), asks, reranker=_length_reranker())


@query
def reranked_traces(spark: SparkSession, sf: str) -> DataFrame:
    return context.chunk_traces(_reranked(spark, sf)).select(
        "query_id", _n("rank", "rank"), "chunk_id", "doc_id", "title", "path", _r("score", "score"),
        "text_preview", _n("pre_rerank_rank", "pre_rerank_rank"),
        _r("pre_rerank_score", "pre_rerank_score"),
    )


# ---------------------------------------------------------------- context, prompts, answers

def _results(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    asks = ask(inp.questions(spark, sf), RetrievalConfig("bm25", k))
    return retrieve(inp.index(spark, sf, LEXICAL), asks)


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return context.pack_context(_results(spark, sf), inp.questions(spark, sf), BUDGET)


@query
def pack_context(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf).select(
        "query_id", _list("selected", "selected"), _list("omitted", "omitted"),
        _n("estimated_tokens", "estimated_tokens"),
    )


@query
def assemble_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return context.with_prompt(_packed(spark, sf)).select(
        "query_id", _n(F.char_length("prompt"), "n_chars"),
        tx.sha256_text(F.col("prompt")).alias("digest"),
    )


@query
def echo_answers(spark: SparkSession, sf: str) -> DataFrame:
    answer = EchoGenerator().answer(F.col("prompt"))
    return context.with_prompt(_packed(spark, sf)).select("query_id", answer.alias("answer")).select(
        "query_id", "answer", _list(prompts.extract_citations(F.col("answer")), "citations")
    )


@query
def citation_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Markers that share one bracket, repeat, or vary the separator."""
    ids = inp.index(spark, sf, ()).chunks.groupBy("doc_id").agg(
        F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b")
    )
    answer = F.concat(
        F.lit("x [Source: "), "b", F.lit(" ;  source: "), "a", F.lit("] y [Source: "), "a",
        F.lit(",Source: z, ] [source: no] [Source: "), "b", F.lit("]"),
    )
    return ids.select("doc_id", _list(prompts.extract_citations(answer), "citations"))


@query
def source_tables(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.transform("blocks", lambda b: F.struct(
        b["chunk_id"].alias("chunk_id"), b["title"].alias("title"), b["path"].alias("path")))
    return _packed(spark, sf).select("query_id", prompts.source_table(shown).alias("sources"))


@query
def context_evidence(spark: SparkSession, sf: str) -> DataFrame:
    results = _results(spark, sf)  # ranked once for both
    found = context.evidence(results, "bm25_score", context.pack_context(results, inp.questions(spark, sf), BUDGET))
    return found.select(
        "query_id", _n("rank", "rank"), "chunk_id", "score_semantics", "selected_for_context"
    )


@query
def smallest_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Smallest budget that keeps the best document and leaves something out; null where none does."""
    results = _results(spark, sf)
    required = results.where(F.col("rank") == 1).select("query_id", F.array("doc_id").alias("must"))
    asked = inp.questions(spark, sf).join(required, "query_id")
    found = context.smallest_contrast_budget(results, asked, "must")
    return asked.select("query_id").join(found, "query_id", "left").select(
        "query_id", _n("budget", "budget")
    )


@query
def judge_messages(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.transform("blocks", lambda b: b["text"])
    message = prompts.judge_message(
        F.col("question"), texts, F.lit("An answer."), F.col("selected"),
        F.lit("A reference."), F.array("query_id", F.lit("fact")),
    )
    return _packed(spark, sf).select("query_id", tx.sha256_text(message).alias("digest"))


@query
def judge_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies in the judges' JSON shape, made from the label table."""
    reply = F.format_string(
        '{"faithfulness": %d, "answer_relevance": 1.0, "citation_support": "%d",'
        ' "answer_correctness": null, "notes": "doc %d"}',
        "quality", 1 - F.col("toxic"), "doc_id",
    )
    v = parse_reply(reply, "fake")
    return inp.table(spark, sf, "labels").select("doc_id", v.alias("v")).select(
        "doc_id", F.col("v.faithfulness").alias("faithfulness"),
        F.col("v.answer_relevance").alias("answer_relevance"),
        F.col("v.citation_support").alias("citation_support"),
        F.col("v.answer_correctness").alias("answer_correctness"), F.col("v.notes").alias("notes"),
    )


@query
def answer_labels(spark: SparkSession, sf: str) -> DataFrame:
    label = answer_label(F.col("quality").cast("double"), 1.0 - F.col("toxic"))
    return inp.table(spark, sf, "labels").select("doc_id", label.alias("label"))


def _table_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts from the label table; correctness only where the text is safe."""
    return inp.table(spark, sf, "labels").select("doc_id", F.struct(
        F.col("quality").cast("double").alias("faithfulness"),
        F.lit(1.0).alias("answer_relevance"),
        (1.0 - F.col("toxic")).alias("citation_support"),
        F.when(F.col("toxic") == 0, F.col("quality").cast("double")).alias("answer_correctness"),
    ).alias("verdict"))


@query
def answer_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return ev.answer_report(_table_verdicts(spark, sf), "fake").select(
        _n("n_questions", "n_questions"), "judge", _r("mean_faithfulness", "mean_faithfulness"),
        _r("mean_answer_relevance", "mean_answer_relevance"),
        _r("mean_citation_support", "mean_citation_support"),
        _r("mean_answer_correctness", "mean_answer_correctness"),
    )


@query
def answer_quality_text(spark: SparkSession, sf: str) -> DataFrame:
    return reports.answer_report_text(ev.answer_report(_table_verdicts(spark, sf), "fake"))


def _judge(spark: SparkSession) -> ScriptedJudge:
    """Abstaining is unsupported; everything else passes."""
    return ScriptedJudge(spark.createDataFrame(
        [(prompts.ECHO_ABSTAIN, 0.25, 0.5, 1.0, None)],
        "answer string, faithfulness double, answer_relevance double, citation_support double, "
        "answer_correctness double",
    ))


@query
def answer_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieve, pack, prompt, answer and judge every question under a tight budget."""
    from gleaner.plugins.counters import CharCounter

    judged = ev.run_answer_eval(
        inp.index(spark, sf, LEXICAL), inp.questions(spark, sf), RetrievalConfig("bm25", 1),
        EchoGenerator(), _judge(spark), context_budget=360, counter=CharCounter(),
    )
    return judged.select(
        "query_id", _list("citations", "citations"),
        F.col("verdict.faithfulness").alias("faithfulness"),
        F.col("verdict.answer_relevance").alias("answer_relevance"),
        F.col("verdict.citation_support").alias("citation_support"),
    )


# ---------------------------------------------------------------- evaluation

def _metric_rows(scored: DataFrame, *extra: str) -> DataFrame:
    return scored.select(
        "query_id", *extra, "hit", *[_r(m, m) for m in ev.METRICS[1:]]
    )


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return ev.run_retrieval_eval(
        inp.index(spark, sf, LEXICAL), inp.gold(spark, sf), RetrievalConfig("bm25", 5)
    )


def _report_rows(report: DataFrame, *extra: str) -> DataFrame:
    return report.select(*extra, _n("n_questions", "n_questions"), *[
        _r(c, c) for c in ("hit_rate", "mrr", "mean_context_precision", "mean_context_recall")
    ])


@query
def gold_documents(spark: SparkSession, sf: str) -> DataFrame:
    return inp.gold(spark, sf).select("query_id", _list("gold_doc_ids", "gold_doc_ids"))


@query
def question_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metric_rows(_scored(spark, sf))


@query
def retrieval_report(spark: SparkSession, sf: str) -> DataFrame:
    return _report_rows(ev.eval_report(_scored(spark, sf)))


@query
def retrieval_report_text(spark: SparkSession, sf: str) -> DataFrame:
    return reports.eval_report_text(ev.eval_report(_scored(spark, sf)), 5, "bm25")


@query
def reranked_report(spark: SparkSession, sf: str) -> DataFrame:
    scored = ev.run_retrieval_eval(
        inp.index(spark, sf, LEXICAL), inp.gold(spark, sf), RetrievalConfig("bm25", 5, "length", 20),
        reranker=_length_reranker(),
    )
    return _report_rows(ev.eval_report(scored))


@query
def catalog_checks(spark: SparkSession, sf: str) -> DataFrame:
    checked = jsonl.catalog_check(_scored(spark, sf).withColumnRenamed("query_id", "question_id"))
    return checked.select(
        "question_id", _list("expected_document_ids", "expected_document_ids"),
        _list("retrieved_document_ids", "retrieved_document_ids"), "hit",
    )


@query
def configuration_comparison(spark: SparkSession, sf: str) -> DataFrame:
    compared = ev.run_comparison(
        inp.index(spark, sf, LEXICAL), inp.gold(spark, sf),
        RetrievalConfig("bm25", 3), RetrievalConfig("bm25", 5, "length", 20),
        reranker=_length_reranker(),
    )
    return _report_rows(ev.comparison_report(compared), "side")


@query
def preset_comparison(spark: SparkSession, sf: str) -> DataFrame:
    left, right = ev.PRESETS["bm25-vs-dense"]
    compared = ev.run_comparison(
        inp.index(spark, sf), inp.gold(spark, sf), left, right, inp.EMBEDDER
    )
    return _report_rows(ev.comparison_report(compared), "side")


def _config(config: RetrievalConfig) -> Column:
    return F.struct(*config.as_columns())


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """One failure case per question: k=1 against k=6."""
    no_gold = F.size("gold_doc_ids") == 0
    return inp.gold(spark, sf).select(
        F.col("query_id").alias("case_id"), "question", "gold_doc_ids",
        F.when(no_gold, "unanswerable_query").otherwise("missing_evidence").alias("expected_label"),
        _config(RetrievalConfig("bm25", 1)).alias("baseline"),
        _config(RetrievalConfig("bm25", 6)).alias("intervention"), F.lit("").alias("notes"),
        F.when(no_gold, "unsupported_answer").otherwise("").alias("answer_label_expected"),
        F.when(no_gold, prompts.ECHO_ABSTAIN).otherwise("").alias("baseline_answer"),
        F.lit("").alias("intervention_answer"),
    )


def _diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    return ev.run_diagnosis(inp.index(spark, sf, LEXICAL), _cases(spark, sf))


@query
def diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    return _diagnosis(spark, sf).select(
        "case_id", "expected_label", "baseline_label", "intervention_label", "fixed", "moved",
        "outcome", _r("baseline_context_precision", "baseline_context_precision"),
        _r("intervention_reciprocal_rank", "intervention_reciprocal_rank"),
    )


@query
def diagnosis_report(spark: SparkSession, sf: str) -> DataFrame:
    report = ev.diagnosis_report(_diagnosis(spark, sf))
    return report.select(*[_n(c, c) for c in report.columns])


@query
def diagnosis_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reports.diagnosis_lines(_diagnosis(spark, sf)).select(
        "case_id", _n("line_no", "line_no"), "line"
    )


@query
def answer_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    found = ev.run_answer_diagnosis(
        inp.index(spark, sf, LEXICAL), _cases(spark, sf), EchoGenerator(), _judge(spark)
    )
    return found.select(
        "case_id", "expected_label", "baseline_label", "intervention_label", "fixed", "moved",
        "outcome", "baseline_faithfulness", "intervention_faithfulness",
    )


@query
def ranking_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Exact scores against scores kept to four digits."""
    exact = _by_centroid(spark, sf, 10)
    rounded = exact.withColumn("score", F.round("score", 4))
    return parity.compare_rankings(exact, rounded, 5e-5).select(
        "query_id", "chunk_id", _n("left_rank", "left_rank"), _n("right_rank", "right_rank"),
        _r("left_score", "left_score"), _r("right_score", "right_score"), "equivalent",
    )


@query
def tie_groups(spark: SparkSession, sf: str) -> DataFrame:
    return parity.grouped_ranking(_by_centroid(spark, sf, 20), 0.01).select(
        "query_id", "chunk_id", _n("rank", "rank"), _n("tie_group", "tie_group")
    )


# ---------------------------------------------------------------- sources, collections, files

@query
def eval_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Questions through their JSON-lines form, mixed with lines that are no questions."""
    good = inp.gold(spark, sf).select(F.to_json(F.struct(
        F.col("query_id").cast("int").alias("question_id"), "question", "gold_doc_ids",
        F.lit("").alias("reference_answer"),
    )).alias("line"))
    bad = inp.table(spark, sf, "conversations").select(F.col("text").alias("line"))
    return jsonl.parse_eval_samples(good.unionByName(bad)).select(
        "question_id", tx.sha256_text(F.col("question")).alias("question_digest"),
        _list("gold_doc_ids", "gold_doc_ids"), "reference_answer",
    )


@query
def failure_cases(spark: SparkSession, sf: str) -> DataFrame:
    lines = inp.gold(spark, sf).select(F.to_json(F.struct(
        F.col("query_id").alias("case_id"), "question", "gold_doc_ids",
        F.struct(F.lit("bm25").alias("retriever"), F.lit(1).alias("top_k")).alias("baseline"),
    )).alias("line"))
    return jsonl.parse_failure_cases(lines).select(
        "case_id", _list("gold_doc_ids", "gold_doc_ids"), "expected_label",
        F.col("baseline.retriever").alias("baseline_retriever"),
        _n("baseline.top_k", "baseline_top_k"),
        F.col("intervention.retriever").alias("intervention_retriever"),
        _n("intervention.top_k", "intervention_top_k"),
    )


@query
def catalog_questions(spark: SparkSession, sf: str) -> DataFrame:
    items = inp.table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"),
        F.col("item_id").alias("position"),
    )
    return jsonl.catalog_view(items)


@query
def role_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.table(spark, sf, "conversations").withColumnRenamed("role", "category")
    return jsonl.category_counts(rows).select("category", _n("count", "count"))


@query
def point_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return collection.payload(inp.index(spark, sf, ()).chunks, "fp")


@query
def collection_check(spark: SparkSession, sf: str) -> DataFrame:
    """A stored copy whose first source lost its payload group."""
    ix = inp.index(spark, sf, ("vectors",))
    points = collection.payload(ix.chunks, "fp").join(
        ix.vectors.select("chunk_id", unit(F.col("embedding")).alias("embedding")), "chunk_id"
    ).withColumn("source_group", F.when(
        F.col("source_group") == "src0", "").otherwise(F.col("source_group")))
    checked = collection.verify_collection(points, ix.chunks, ix.vectors, "fp")
    return checked.select(_n("points", "points"), _n("mismatches", "mismatches"), "verified")


@query
def collection_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of all stored embeddings in id order."""
    vectors = inp.vectors(spark, sf).withColumn("position", F.col("vec_id"))
    value = collection.vector_fingerprint(vectors)
    return vectors.agg(_n(F.count("*"), "vectors")).withColumn("fingerprint", F.lit(value))


@query
def index_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of the vectors of the stored index."""
    value = collection.vector_fingerprint(inp.index(spark, sf, ("vectors",)).vectors)
    chunks = inp.index(spark, sf, ("vectors",)).chunks
    return chunks.agg(_n(F.count("*"), "chunks")).withColumn("fingerprint", F.lit(value))


@query
def file_status(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as promised files against labelled documents as files present."""
    docs = inp.table(spark, sf, "documents")
    expected = docs.select(
        F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256")
    )
    labels = inp.table(spark, sf, "labels")
    actual = docs.join(labels, "doc_id").select(
        F.when(F.col("quality") == 1, F.col("doc_id").cast("string"))
        .when(F.col("toxic") == 1, F.concat(F.lit("x"), F.col("doc_id").cast("string")))
        .otherwise(F.col("doc_id").cast("string")).alias("path"),
        F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise("changed"), 256)
        .alias("sha256"),
    )
    return files.compare_files(expected, actual)


@query
def retrieve_trace_lines(spark: SparkSession, sf: str) -> DataFrame:
    asks = ask(inp.questions(spark, sf), RetrievalConfig("bm25", 3))
    traces = reports.retrieve_traces(asks, retrieve(inp.index(spark, sf, LEXICAL), asks))
    return reports.retrieve_trace_lines(traces).select(
        "query_id", _n("line_no", "line_no"), "line"
    )


@query
def bundle_violations(spark: SparkSession, sf: str) -> DataFrame:
    """A question per label, checked against all documents; some ids, texts and values are wrong."""
    docs = inp.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    n, nowhere = F.col("doc_id"), F.concat(F.lit("absent-"), (F.col("doc_id") % 17).cast("string"))
    labels = inp.table(spark, sf, "labels")
    asked = labels.select(
        (n - F.when(n % 11 == 0, 1).otherwise(0)).cast("string").alias("question_id"),
        F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("category"),
        F.when(n % 13 == 0, "").otherwise(F.concat(F.lit("label "), n)).alias("question"),
        F.when(n % 5 == 0, F.array(n.cast("string"), nowhere)).otherwise(F.array(n.cast("string"))).alias("gold_doc_ids"),
    )
    none = F.lit(None).cast("string")

    def value(key: str, rows: DataFrame, off_by: int) -> DataFrame:
        n_rows = F.count("*")
        return rows.agg(F.lit(key).alias("key"), n_rows.cast("string").alias("actual"),
                        (n_rows + off_by).cast("string").alias("declared"), none.alias("trusted"))

    metric = spark.createDataFrame([("distance_metric", "cosine", "cosine", "dot")], "key string, actual string, declared string, trusted string")
    identity = value("document_count", docs, 0).unionByName(value("question_count", labels, 1)).unionByName(metric)
    wanted = {"q0t0": 4, "q0t1": 4, "q1t0": 4, "q2t0": 4}
    return bundle.bundle_violations(asked, docs, identity, wanted)


@query
def catalog_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Of a stored catalog of all documents, the rows of the labelled ones."""
    path = f"{shared_dir(spark)}/lookup-{uuid.uuid4().hex[:12]}"
    docs = inp.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("question_id"), F.sha2("text", 256).alias("digest"), "source")
    write_lookup(docs, path, "question_id")
    wanted = inp.table(spark, sf, "labels").select(F.col("doc_id").cast("string"))
    return look_up_all(wanted, spark.read.parquet(path), "question_id")
