"""Prompt text, source markers and the messages sent to models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import SPACE, strip

# Texts a model sees; they must not change by a single character.
PROMPT_HEAD = (
    "You are a retrieval-augmented assistant. Answer the question using only the\n"
    "provided context.\n"
    "\n"
    "If the context is insufficient, say that the provided context does not contain\n"
    "enough information to answer. Do not use outside knowledge.\n"
    "\n"
    "Cite every factual claim with the source marker for the context block that\n"
    "supports it.\n"
    "\n"
    "Question:\n"
)
PROMPT_CONTEXT = "\n\nContext:\n"
PROMPT_TAIL = "\n\nAnswer:"
ECHO_LEAD = "Based on the provided context: "
ECHO_ABSTAIN = (
    "Based on the provided context, "
    "the context does not contain enough information to answer."
)

# The source marker and what separates ids inside one marker.
MARKER = r"\[Source: ([^\]]+)\]"
MARKER_SEPARATOR = rf"(?i)[{SPACE}]*[;,][{SPACE}]*(?:Source:[{SPACE}]*)?"


def context_block(chunk_id: Column, title: Column, path: Column, text: Column) -> Column:
    """One context block as it stands in the prompt."""
    return F.concat(
        F.lit("[Source: "), chunk_id, F.lit("]\nTitle: "), title, F.lit("\nPath: "), path,
        F.lit("\n\n"), text,
    )


def assemble_prompt(question: Column, blocks: Column) -> Column:
    """Prompt from an array of context blocks in rank order; may be empty."""
    return F.concat(
        F.lit(PROMPT_HEAD), question, F.lit(PROMPT_CONTEXT), F.array_join(blocks, "\n\n"),
        F.lit(PROMPT_TAIL),
    )


def extract_citations(answer: Column) -> Column:
    """Distinct source ids in the order they are first cited."""
    markers = F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1))
    ids = F.flatten(F.transform(markers, lambda m: F.split(m, MARKER_SEPARATOR)))
    clean = F.transform(ids, lambda i: strip(F.regexp_replace(i, r"\ASource:", "")))
    return F.array_distinct(F.filter(clean, lambda i: i != ""))


def echo_answer(prompt: Column) -> Column:
    """Deterministic answer that cites every marker of the prompt, or abstains."""
    ids = extract_citations(prompt)
    cited = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("[Source: "), i, F.lit("]"))), " ")
    return F.when(F.size(ids) == 0, F.lit(ECHO_ABSTAIN)).otherwise(
        F.concat(F.lit(ECHO_LEAD), cited)
    )


def char_tokens(text: Column, tokens_per_char: float = 0.25) -> Column:
    """Token estimate from the number of characters, rounded down."""
    return F.floor(F.char_length(text) * F.lit(tokens_per_char)).cast("int")


def source_table(chunks: Column) -> Column:
    """Printable source list from array<struct<chunk_id,title,path>>."""
    lines = F.transform(chunks, lambda c: F.concat(
        F.lit("  [Source: "), c["chunk_id"], F.lit("]  "), c["title"],
        F.lit("  ("), c["path"], F.lit(")"),
    ))
    return F.when(F.size(chunks) == 0, F.lit("Sources: (none)")).otherwise(
        F.array_join(F.concat(F.array(F.lit("Sources:")), lines), "\n")
    )


def numbered_context(texts: Column) -> Column:
    """"[1] first", "[2] second", separated by blank lines."""
    return F.array_join(
        F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)),
        "\n\n",
    )


def judge_message(
    question: Column, context: Column, answer: Column,
    citations: Column, reference_answer: Column, expected_facts: Column,
) -> Column:
    """User message for a judging model; empty optional parts leave no trace."""
    def optional(present: Column, text: Column) -> Column:
        return F.when(F.coalesce(present, F.lit(False)), text).otherwise(F.lit(""))

    facts = F.array_join(F.transform(expected_facts, lambda f: F.concat(F.lit("- "), f)), "\n")
    return F.concat(
        F.lit("Question: "), question, F.lit("\n\nRetrieved context:\n"),
        numbered_context(context), F.lit("\n\nGenerated answer: "), answer, F.lit("\n"),
        optional(F.size(citations) > 0, F.concat(
            F.lit("\nCitations: "), F.array_join(citations, ", "), F.lit("\n"))),
        optional(reference_answer != "", F.concat(
            F.lit("\nReference answer: "), reference_answer, F.lit("\n"))),
        optional(F.size(expected_facts) > 0, F.concat(
            F.lit("\nExpected facts:\n"), facts, F.lit("\n"))),
    )
