import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import labels, metrics, prompts
from gleaner.operators import context
from gleaner.plugins.generators import EchoGenerator, provider_url
from gleaner.plugins.judges import ScriptedJudge, parse_reply


def results(spark, texts, query_id="q"):
    rows = [(query_id, f"c{i}", f"d{i}", "T", "p", t, i + 1, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "query_id string, chunk_id string, doc_id string, title string, path string,"
              " text string, rank int, score double")


def asked(spark, question="What?", query_id="q"):
    return spark.createDataFrame([(query_id, question)], "query_id string, question string")


def tokens(text, chunk_id="c0"):
    return int(len(f"[Source: {chunk_id}]\nTitle: T\nPath: p\n\n{text}") * 0.25)


def test_packing_skips_what_does_not_fit_and_goes_on(spark):
    texts = ["a" * 100, "b" * 4000, "c" * 40]
    budget = 100 + int(len("What?") * 0.25) + tokens(texts[0]) + tokens(texts[2])
    row = context.pack_context(results(spark, texts), asked(spark), budget).first()
    assert row["selected"] == ["c0", "c2"] and row["omitted"] == ["c1"]
    assert row["estimated_tokens"] == tokens(texts[0]) + tokens(texts[2])
    assert row["counter_name"] == "char" and row["budget"] == budget
    tight = context.pack_context(results(spark, texts), asked(spark), budget - 1).first()
    assert tight["selected"] == ["c0"]


def test_no_budget_takes_everything_and_negative_fails(spark):
    row = context.pack_context(results(spark, ["x" * 9000, "y"]), asked(spark), 0).first()
    assert row["selected"] == ["c0", "c1"] and row["omitted"] == []
    none = context.pack_context(results(spark, ["x"]).limit(0), asked(spark), 50).first()
    assert none["selected"] == [] and none["estimated_tokens"] == 0
    with pytest.raises(ValueError, match="context_budget must be >= 0, got -1"):
        context.pack_context(results(spark, ["x"]), asked(spark), -1)


def test_prompt_and_echo(spark):
    packed = context.pack_context(results(spark, ["one", "two"]), asked(spark), 0)
    prompt = context.with_prompt(packed).first()["prompt"]
    assert prompt.endswith(
        "Question:\nWhat?\n\nContext:\n[Source: c0]\nTitle: T\nPath: p\n\none\n\n"
        "[Source: c1]\nTitle: T\nPath: p\n\ntwo\n\nAnswer:")
    answer = context.with_prompt(packed).select(EchoGenerator().answer(F.col("prompt"))).first()[0]
    assert answer == "Based on the provided context: [Source: c0] [Source: c1]"
    empty = context.with_prompt(
        context.pack_context(results(spark, ["x"]).limit(0), asked(spark), 0)
    ).select(EchoGenerator().answer(F.col("prompt"))).first()[0]
    assert empty == prompts.ECHO_ABSTAIN


@pytest.mark.parametrize("answer, ids", [
    ("[Source: a] and [Source: b] and [Source: a]", ["a", "b"]),
    ("[Source: a; Source: b, source: c]", ["a", "b", "c"]),
    ("[Source: Source: a ;; ]", ["a"]), ("[source: a] [Sources: b]", []), ("", []),
])
def test_citations(spark, answer, ids):
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(prompts.extract_citations(F.col("a"))).first()[0] == ids


@pytest.mark.parametrize("got, gold, want", [
    (["a", "b", "a"], ["a"], (True, 1.0, 2 / 3, 1.0)), (["x", "a"], ["a", "b"], (True, 0.5, 0.5, 0.5)),
    ([], ["a"], (False, 0.0, 0.0, 0.0)), (["a"], [], (False, 0.0, 0.0, 0.0)),
    (["a"], ["a", "a"], (True, 1.0, 1.0, 0.5)),
])
def test_metrics(spark, got, gold, want):
    df = spark.createDataFrame([(got, gold)], "r array<string>, g array<string>")
    row = df.select(*metrics.all_metrics(F.col("r"), F.col("g"))).first()
    assert tuple(row) == pytest.approx(want)


@pytest.mark.parametrize("got, gold, expected, want", [
    (["a"], [], "unanswerable_query", "unanswerable_query"), (["a"], [], "x", "no_failure"),
    (["b"], ["a"], "x", "missing_evidence"), (list("bcda"), ["a"], "x", "low_rank_evidence"),
    (list("bca"), ["a"], "x", "distractor_evidence"), (["a", "b"], ["a"], "x", "no_failure"),
])
def test_failure_labels(spark, got, gold, expected, want):
    df = spark.createDataFrame([(got, gold, expected)], "r array<string>, g array<string>, e string")
    row = df.select(labels.failure_label(F.col("r"), F.col("g"), F.col("e"))).first()
    assert row[0] == want


def test_answer_labels(spark):
    df = spark.createDataFrame([(0.49, 0.0), (0.5, 0.49), (0.5, 0.5)], "f double, c double")
    got = [r[0] for r in df.select(labels.answer_label(F.col("f"), F.col("c"))).collect()]
    assert got == ["unsupported_answer", "citation_mismatch", "no_failure"]


def test_judge_replies(spark):
    good = json.dumps({"faithfulness": 1, "answer_relevance": 0.5, "citation_support": "0.25",
                       "answer_correctness": None, "notes": "n"})
    df = spark.createDataFrame([(good,)], "r string")
    v = df.select(parse_reply(F.col("r"), "openai").alias("v")).first()["v"]
    assert (v["faithfulness"], v["citation_support"], v["answer_correctness"]) == (1.0, 0.25, None)
    for bad, message in [("nope", "not a JSON object"), ('{"faithfulness": 1}', "reply misses")]:
        broken = spark.createDataFrame([(bad,)], "r string")
        with pytest.raises(Exception, match=message):
            broken.select(parse_reply(F.col("r"), "openai")).collect()


def test_scripted_judge_falls_back(spark):
    table = spark.createDataFrame(
        [("bad", 0.1, 0.2, 0.3, None)], "answer string, faithfulness double,"
        " answer_relevance double, citation_support double, answer_correctness double")
    df = spark.createDataFrame([("bad",), ("other",)], "answer string")
    got = {r["answer"]: r["verdict"]["faithfulness"]
           for r in ScriptedJudge(table).judge(df).collect()}
    assert got == {"bad": 0.1, "other": 1.0}


def test_judge_message_leaves_no_trace_of_absent_parts(spark):
    df = spark.createDataFrame([("q", ["x", "y"], "a")], "q string, c array<string>, a string")
    none = F.lit(None)
    text = df.select(prompts.judge_message(
        F.col("q"), F.col("c"), F.col("a"), none.cast("array<string>"), none.cast("string"),
        none.cast("array<string>"),
    )).first()[0]
    assert text == "Question: q\n\nRetrieved context:\n[1] x\n\n[2] y\n\nGenerated answer: a\n"


def test_provider_url(spark):
    df = spark.createDataFrame([("http://h/v1/chat/completions/",), ("http://h/v1",)], "u string")
    assert [r[0] for r in df.select(provider_url(F.col("u"))).collect()] == ["http://h/v1"] * 2


def test_smallest_contrast_budget(spark):
    found = results(spark, ["a" * 100, "b" * 100])
    need = asked(spark).withColumn("must", F.array(F.lit("d1")))
    row = context.smallest_contrast_budget(found, need, "must").first()
    # d1 alone never fits where d0 does not, and both leave nothing out.
    assert row is None
    first = asked(spark).withColumn("must", F.array(F.lit("d0")))
    assert context.smallest_contrast_budget(found, first, "must").first()["budget"] == (
        100 + 1 + tokens("a" * 100))
