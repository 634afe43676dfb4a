"""Text reports and trace records.

A report over many cases is a table of numbered lines, so its length never has to
fit one row; one-row aggregates become one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import fixed
from gleaner.operators.context import chunk_traces

# Rules of the printed reports.
_RULE_36, _RULE_44 = "─" * 36, "─" * 44


def _f3(column: str) -> Column:
    return fixed(F.coalesce(F.col(column).cast("double"), F.lit(0.0)), 3)


def _joined(*lines: Column) -> Column:
    """Lines of a text; null lines are left out."""
    return F.array_join(F.array(*lines), "\n")


def eval_report_text(
    report: DataFrame, top_k: int, retriever: str, reranker: str = "none",
    rerank_top_n: int | None = None,
) -> DataFrame:
    extra = []
    if reranker != "none":
        extra.append(F.lit(f"Reranker          :  {reranker}"))
        if rerank_top_n is not None:
            extra.append(F.lit(f"Rerank Top-N      :  {rerank_top_n}"))
        extra.append(F.lit(""))
    header = F.format_string(
        f"Evaluation report  (n=%d, top_k={top_k}, retriever={retriever})", "n_questions"
    )
    return report.select(_joined(
        header, F.lit(_RULE_36), *extra,
        F.concat(F.lit(f"Hit Rate @ {top_k:<6}:  "), _f3("hit_rate")),
        F.concat(F.lit("MRR               :  "), _f3("mrr")),
        F.concat(F.lit("Context Precision :  "), _f3("mean_context_precision")),
        F.concat(F.lit("Context Recall    :  "), _f3("mean_context_recall")),
    ).alias("report"))


def answer_report_text(report: DataFrame) -> DataFrame:
    correctness = F.when(
        F.col("mean_answer_correctness").isNotNull(),
        F.concat(F.lit("Answer Correctness:  "), _f3("mean_answer_correctness")),
    )
    return report.select(_joined(
        F.format_string("Answer quality report  (n=%d, judge=%s)", "n_questions", "judge"),
        F.lit(_RULE_36),
        F.concat(F.lit("Faithfulness      :  "), _f3("mean_faithfulness")),
        F.concat(F.lit("Answer Relevance  :  "), _f3("mean_answer_relevance")),
        F.concat(F.lit("Citation Support  :  "), _f3("mean_citation_support")),
        correctness,
    ).alias("report"))


def _side(side: str, shown: str, values: list[tuple[str, str]]) -> Column:
    return F.concat(
        F.lit(f"  {shown} : "), F.format_string("%-24s", f"{side}_label"),
        *[F.concat(F.lit(f"  {name}="), _f3(f"{side}_{column}")) for name, column in values],
    )


def _case_lines(per_case: DataFrame, values: list[tuple[str, str]]) -> DataFrame:
    """(case_id, line_no, line): four lines per case and the blank after them."""
    lines = F.array(
        F.concat(F.lit("Case "), "case_id", F.lit("  expected="), "expected_label"),
        _side("baseline", "baseline  ", values),
        _side("intervention", "interv.   ", values),
        F.concat(F.lit("  "), "outcome"),
        F.lit(""),
    )
    return per_case.select("case_id", F.posexplode(lines).alias("line_no", "line"))


def diagnosis_lines(per_case: DataFrame) -> DataFrame:
    return _case_lines(per_case, [
        ("hit", "hit"), ("prec", "context_precision"), ("recall", "context_recall"),
        ("mrr", "reciprocal_rank"),
    ])


def answer_diagnosis_lines(per_case: DataFrame) -> DataFrame:
    return _case_lines(per_case, [("faith", "faithfulness"), ("cit", "citation_support")])


def diagnosis_header(report: DataFrame, title: str = "Diagnosis report") -> DataFrame:
    return report.select(_joined(
        F.format_string(f"{title}  (n=%d)", "n_cases"), F.lit(_RULE_44),
        F.format_string("  Confirmed  : %d", "n_confirmed"),
        F.format_string("  Fixed      : %d", "n_fixed"),
        F.format_string("  Moved      : %d", "n_moved"), F.lit(_RULE_44),
    ).alias("report"))


# ---------------------------------------------------------------- traces

def retrieve_traces(
    asks: DataFrame, results: DataFrame, latency: dict[str, float] | None = None
) -> DataFrame:
    """One trace per ask with its chunk records in rank order."""
    chunks = chunk_traces(results).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "chunk_id", "doc_id", "title", "path", "score", "text_preview",
        "pre_rerank_rank", "pre_rerank_score",
    ))).alias("chunks"))
    times = F.from_json(F.to_json(F.create_map(
        *[F.lit(x) for pair in (latency or {}).items() for x in pair]
    )) if latency else F.lit("{}"), "map<string,double>")
    return asks.join(chunks, "query_id", "left").select(
        "query_id", F.col("question").alias("query"), "retriever", "top_k",
        F.coalesce("chunks", F.array().cast(_CHUNK_TRACES)).alias("chunks"),
        times.alias("latency_by_stage"), "reranker",
        F.when(F.col("reranker") != "none", F.col("rerank_top_n")).alias("rerank_top_n"),
    )


_CHUNK_TRACES = (
    "array<struct<rank:int,chunk_id:string,doc_id:string,title:string,path:string,score:double,"
    "text_preview:string,pre_rerank_rank:int,pre_rerank_score:double>>"
)


def ask_traces(traces: DataFrame, judged: DataFrame) -> DataFrame:
    """Retrieve traces extended by prompt, answer, citations, packing and verdict."""
    answers = judged.select(
        "query_id", "prompt", "answer", "citations", "verdict",
        F.struct("selected", "omitted", "estimated_tokens", "budget", "counter_name")
        .alias("context_pack"),
    )
    kept = F.filter("chunks", lambda c: F.array_contains("context_pack.selected", c["chunk_id"]))
    return traces.join(answers, "query_id").withColumn("chunks", kept)


def resolvable_citations(judged: DataFrame) -> DataFrame:
    """Keep only citations of chunks that were in the prompt."""
    return judged.withColumn("citations", F.array_intersect("citations", "selected"))


def lab_runs(
    traces: DataFrame, evidence: DataFrame, operation: str, index_id: str, manifest_json: str,
    mode: str = "live", config_json: str = "{}",
) -> DataFrame:
    """Replay records: trace, index snapshot and evidence of every ask."""
    shown = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", *[c for c in evidence.columns if c not in ("rank", "query_id")]
    ))).alias("evidence"))
    manifest = F.lit(manifest_json)
    counts = F.from_json(manifest, "document_count LONG, chunk_count LONG")
    return traces.join(shown, "query_id", "left").select(
        F.lit(operation).alias("operation"),
        F.struct(
            F.lit(index_id).alias("index_id"), manifest.alias("manifest"),
            counts["document_count"].alias("document_count"),
            counts["chunk_count"].alias("chunk_count"),
        ).alias("index"),
        F.to_json(F.struct(*[F.col(c) for c in traces.columns if c != "query_id"])).alias("trace"),
        "evidence", F.lit(config_json).alias("config"), F.lit(mode).alias("mode"),
        F.col("query_id").alias("run_id"), F.lit("1.1").alias("schema_version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"),
    )


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines through Spark's commit protocol."""
    records.write.mode("overwrite").json(path)


def retrieve_trace_lines(traces: DataFrame) -> DataFrame:
    """(query_id, line_no, line) of the printed trace."""
    times = F.array_join(F.transform(
        F.map_entries("latency_by_stage"),
        lambda e: F.concat(e["key"], F.lit("="), fixed(e["value"], 3), F.lit("s")),
    ), "  ")
    depth = F.when(F.col("rerank_top_n").isNotNull(), F.format_string(
        "  (rerank_top_n=%d)", "rerank_top_n")).otherwise("")
    head = F.array(
        F.lit("Retrieve trace"), F.lit(_RULE_44),
        F.concat(F.lit("  query     : '"), "query", F.lit("'")),
        F.when(F.col("reranker") != "none", F.concat(F.lit("  reranker  : "), "reranker", depth)),
        F.concat(F.lit("  retriever : "), "retriever"),
        F.format_string("  top_k     : %d", "top_k"),
        F.concat(F.lit("  latency   : "), times), F.lit(_RULE_44),
        F.when(F.size("chunks") == 0, F.lit("  No results found.")),
    )

    def block(c: Column) -> Column:
        return F.array(
            F.format_string("Rank %d  score=%s  chunk_id=%s", c["rank"], fixed(c["score"], 4), c["chunk_id"]),
            F.concat(F.lit("  doc_id  : "), c["doc_id"]),
            F.when(c["pre_rerank_rank"].isNotNull(), F.format_string(
                "  pre     : rank=%d  score=%s", c["pre_rerank_rank"], fixed(c["pre_rerank_score"], 4))),
            F.concat(F.lit("  title   : "), c["title"]), F.concat(F.lit("  path    : "), c["path"]),
            F.concat(F.lit("  preview : "), c["text_preview"]), F.lit(""),
        )

    lines = F.concat(head, F.flatten(F.transform("chunks", block)))
    return traces.select(
        "query_id", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("line_no", "line")
    )


def ask_trace_lines(traces: DataFrame) -> DataFrame:
    """(query_id, line_no, line) of the printed answer: packing, answer, citations, verdict."""
    pack, v = F.col("context_pack"), F.col("verdict")

    def plural(n: Column) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, " chunk").otherwise(" chunks"))

    packing = F.when(pack["budget"] > 0, F.concat(
        F.array(
            F.format_string("Context packing  (budget=%d, counter=%s)",
                            pack["budget"], pack["counter_name"]),
            F.concat(F.lit("  Selected  : "), plural(F.size(pack["selected"])),
                     F.format_string("   (~%d tokens used)", pack["estimated_tokens"])),
            F.concat(F.lit("  Omitted   : "), plural(F.size(pack["omitted"]))),
        ),
        F.transform(pack["omitted"], lambda c: F.concat(F.lit("    - "), c)),
        F.array(F.lit("")),
    )).otherwise(F.array().cast("array<string>"))
    verdict = F.when(v.isNotNull(), F.filter(F.array(
        F.lit(""), F.format_string("Judge verdict  (judge=%s)", v["judge_name"]),
        F.concat(F.lit("  Faithfulness     : "), fixed(v["faithfulness"], 3)),
        F.concat(F.lit("  Answer Relevance : "), fixed(v["answer_relevance"], 3)),
        F.concat(F.lit("  Citation Support : "), fixed(v["citation_support"], 3)),
        F.when(v["answer_correctness"].isNotNull(), F.concat(F.lit("  Answer Correct.  : "), fixed(v["answer_correctness"], 3))),
        F.when(v["notes"] != "", F.concat(F.lit("  Notes            : "), v["notes"])),
    ), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    answer = F.array(F.lit(_RULE_44), F.lit("Answer:"), F.col("answer"))
    cited = F.when(F.size("citations") > 0, F.array(
        F.lit(""), F.concat(F.lit("Citations: "), F.array_join("citations", ", "))
    )).otherwise(F.array().cast("array<string>"))
    return traces.select(
        "query_id",
        F.posexplode(F.concat(packing, answer, cited, verdict)).alias("line_no", "line"),
    )
