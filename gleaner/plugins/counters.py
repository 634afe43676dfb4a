"""Token counters as Columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.prompts import char_tokens


class CharCounter:
    """Four characters count as one token."""

    name = "char"

    def __init__(self, tokens_per_char: float = 0.25) -> None:
        self.tokens_per_char = tokens_per_char

    def count(self, text: Column) -> Column:
        return char_tokens(text, self.tokens_per_char)


class TiktokenCounter:
    """Byte-pair counts from tiktoken; one encoder per Python worker."""

    def __init__(self, model: str = "gpt-4o-mini") -> None:
        import tiktoken

        # A missing package or vocabulary shows here, not in a task.
        tiktoken.encoding_for_model(model)
        self.model = model
        self.name = f"tiktoken-{model}"

    def count(self, text: Column) -> Column:
        model = self.model

        @F.pandas_udf("int")
        def count_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import tiktoken

            encoder = tiktoken.encoding_for_model(model)
            for texts in batches:
                yield texts.map(lambda t: len(encoder.encode(t))).astype("int32")

        return count_batches(text)
