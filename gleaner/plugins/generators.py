"""Answer generators as Columns over prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.prompts import echo_answer


def provider_url(url: Column) -> Column:
    """Base URL of a chat provider: no closing slash, no endpoint path."""
    bare = F.regexp_replace(url, r"/+\z", "")
    return F.regexp_replace(F.regexp_replace(bare, r"/chat/completions\z", ""), r"/+\z", "")


class EchoGenerator:
    """Cites every source of the prompt; deterministic and offline."""

    name = "fake"

    def answer(self, prompt: Column) -> Column:
        return echo_answer(prompt)


class ChatGenerator:
    """Any chat-completions endpoint, called from the tasks."""

    name = "openai"

    def __init__(
        self, model: str | None = None, api_key: str | None = None, base_url: str | None = None,
        timeout: float | None = None, max_retries: int | None = None,
        max_tokens: int | None = None,
    ) -> None:
        self.model = model or "gpt-4o-mini"
        options = {
            "api_key": api_key, "base_url": base_url, "timeout": timeout,
            "max_retries": max_retries,
        }
        self.options = {k: v for k, v in options.items() if v is not None}
        self.max_tokens = max_tokens

    def answer(self, prompt: Column) -> Column:
        model, options, max_tokens = self.model, self.options, self.max_tokens

        @F.pandas_udf("string")
        def complete(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from openai import OpenAI

            client = OpenAI(**options)
            extra = {} if max_tokens is None else {"max_tokens": max_tokens}
            for prompts in batches:
                yield prompts.map(lambda p: client.chat.completions.create(
                    model=model, messages=[{"role": "user", "content": p}], **extra
                ).choices[0].message.content)

        return complete(prompt)
