"""Answer judges: each adds a ``verdict`` struct to rows with question, context and answer."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.prompts import judge_message
from gleaner.session import broadcast_if_small

# Instruction and keys of a judging model's reply.
JUDGE_INSTRUCTION = """\
You are an expert evaluator of RAG (Retrieval-Augmented Generation) answers.
Given a question, the retrieved context passages, and a generated answer, score
the answer on the following dimensions. Respond ONLY with a JSON object — no
prose, no markdown fences.

JSON keys (all required):
  faithfulness       float 0.0-1.0  Is the answer grounded in the context?
  answer_relevance   float 0.0-1.0  Does the answer address the question?
  citation_support   float 0.0-1.0  Do cited passages support the claims?
  answer_correctness float 0.0-1.0 or null  How close to the reference answer?
                     Set to null when no reference_answer is provided.
  notes              string         One-sentence explanation.
"""
REPLY_KEYS = (
    "faithfulness", "answer_relevance", "citation_support", "answer_correctness", "notes",
)


def verdict(
    faithfulness: Column, answer_relevance: Column, citation_support: Column,
    answer_correctness: Column, judge_name: str, notes: Column | None = None,
    latency: Column | None = None,
) -> Column:
    return F.struct(
        faithfulness.cast("double").alias("faithfulness"),
        answer_relevance.cast("double").alias("answer_relevance"),
        citation_support.cast("double").alias("citation_support"),
        answer_correctness.cast("double").alias("answer_correctness"),
        F.lit(judge_name).alias("judge_name"),
        F.coalesce(latency if latency is not None else F.lit(0.0), F.lit(0.0)).alias("latency"),
        F.coalesce(notes if notes is not None else F.lit(""), F.lit("")).alias("notes"),
    )


def parse_reply(reply: Column, judge_name: str, latency: Column | None = None) -> Column:
    """Verdict from a model's JSON reply; bad JSON or a missing key is an error."""
    keys = F.json_object_keys(reply)
    missing = F.array_except(F.array(*[F.lit(k) for k in REPLY_KEYS]), keys)
    # Every value is read as text first, so that 1, 1.0 and "1" all count.
    data = F.from_json(reply, "map<string,string>")
    score = {k: F.try_element_at(data, F.lit(k)) for k in REPLY_KEYS}
    good = verdict(
        score["faithfulness"], score["answer_relevance"], score["citation_support"],
        score["answer_correctness"], judge_name, score["notes"], latency,
    )
    return (
        F.when(keys.isNull(), F.raise_error(F.concat(F.lit("reply is not a JSON object: "), reply)))
        .when(F.size(missing) > 0, F.raise_error(
            F.concat(F.lit("reply misses "), F.array_join(missing, ", "))))
        .otherwise(good)
    )


class ScriptedJudge:
    """Verdicts looked up by answer text; anything else gets the default verdict.

    ``verdicts`` has (answer, faithfulness, answer_relevance, citation_support,
    answer_correctness); without it every answer passes with full marks.
    """

    def __init__(
        self, verdicts: DataFrame | None = None,
        default: tuple[float, float, float, float | None] = (1.0, 1.0, 1.0, None),
        name: str = "fake",
    ) -> None:
        self.verdicts, self.default, self.name = verdicts, default, name

    def judge(self, answered: DataFrame) -> DataFrame:
        default = verdict(*[F.lit(v) for v in self.default], self.name)
        if self.verdicts is None:
            return answered.withColumn("verdict", default)
        scripted = self.verdicts.select("answer", verdict(
            F.col("faithfulness"), F.col("answer_relevance"), F.col("citation_support"),
            F.col("answer_correctness"), self.name,
        ).alias("scripted"))
        return (
            answered.join(broadcast_if_small(scripted), "answer", "left")
            .withColumn("verdict", F.coalesce("scripted", default)).drop("scripted")
        )


class ChatJudge:
    """A judging model behind a chat-completions endpoint in JSON mode."""

    name = "openai"

    def __init__(self, model: str, api_key: str, base_url: str | None = None) -> None:
        self.model, self.api_key, self.base_url = model, api_key, base_url

    def judge(self, answered: DataFrame) -> DataFrame:
        model, api_key, base_url = self.model, self.api_key, self.base_url

        @F.pandas_udf("reply string, seconds double")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            from openai import OpenAI

            client = OpenAI(api_key=api_key, base_url=base_url)
            for messages in batches:
                rows = []
                for message in messages:
                    began = time.monotonic()
                    reply = client.chat.completions.create(
                        model=model, response_format={"type": "json_object"},
                        messages=[{"role": "system", "content": JUDGE_INSTRUCTION},
                                  {"role": "user", "content": message}],
                    ).choices[0].message.content or ""
                    rows.append((reply, time.monotonic() - began))
                yield pd.DataFrame(rows, columns=["reply", "seconds"])

        def column(name: str, kind: str) -> Column:
            return F.col(name) if name in answered.columns else F.lit(None).cast(kind)

        message = judge_message(
            F.col("question"), F.col("context"), F.col("answer"),
            column("citations", "array<string>"), column("reference_answer", "string"),
            column("expected_facts", "array<string>"),
        )
        return (
            answered.withColumn("r", ask(message))
            .withColumn("verdict", parse_reply(F.col("r.reply"), self.name, F.col("r.seconds")))
            .drop("r")
        )
