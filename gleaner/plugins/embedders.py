"""Embedding back ends: models run on Arrow batches, everything else is a Column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.vectors import cosine

# The pinned default model.
DEFAULT_EMBEDDING_MODEL = "sentence-transformers/all-MiniLM-L6-v2"
DEFAULT_EMBEDDING_REVISION = "1110a243fdf4706b3f48f1d95db1a4f5529b4d41"


class Embedder:
    """Anything that turns a batch of texts into a float32 matrix."""

    name = "custom"
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def vector(self, text: Column) -> Column:
        """array<float> for a text column."""

        @F.pandas_udf("array<float>")
        def embed_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(list(self.embed(texts.tolist())), dtype=object)

        return embed_batches(text)

    def neighbour_similarity(self, sentences: Column) -> Column:
        """array<double>: cosine of every sentence with the one before; null first.

        The sentences of a whole Arrow batch go through the model in one call.
        """

        @F.pandas_udf("array<double>")
        def compare_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for lists in batches:
                vectors = self.embed([s for one in lists for s in one])
                rows, at = [], 0
                for one in lists:
                    v = vectors[at:at + len(one)]
                    at += len(one)
                    near = np.einsum("ij,ij->i", v[:-1], v[1:]).astype(float)
                    rows.append([None, *near.tolist()] if len(one) else [])
                yield pd.Series(rows, dtype=object)

        return compare_batches(sentences)


class HashEmbedder(Embedder):
    """Deterministic unit vectors seeded by the text's digest; needs no model."""

    name = "fake"

    def __init__(self, dim: int = 8) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in enumerate(texts):
            seed = np.frombuffer(hashlib.sha256(text.encode()).digest()[:4], "<u4")[0]
            out[row] = np.random.default_rng(int(seed)).standard_normal(self.dim)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, np.float32(1), norms)


class LetterEmbedder(Embedder):
    """Counts of letters, either case, as plain Column functions: no Python worker, the same in SQL."""

    name = "letters"

    def __init__(self, letters: str = "abcdefghijklmnopqrstuvwxyz") -> None:
        self.letters, self.dim = letters, len(letters)

    def embed(self, texts: list[str]) -> np.ndarray:
        counts = [[t.count(c) + t.count(c.upper()) for c in self.letters] for t in texts]
        return np.array(counts, dtype=np.float32).reshape(len(texts), self.dim)

    def vector(self, text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        return F.array(*[
            (F.char_length(text) - F.char_length(F.translate(text, c + c.upper(), ""))).cast("float")
            for c in self.letters
        ])

    def neighbour_similarity(self, sentences: Column) -> Column:
        def near(v: Column) -> Column:
            places = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1))
            return F.coalesce(
                F.transform(places, lambda i: F.when(i > 0, cosine(F.get(v, i - 1), F.get(v, i)))),
                F.array().cast("array<double>"),
            )

        # Wrapped in an array, so that the vectors are bound once.
        return F.transform(F.array(F.transform(sentences, self.vector)), near)[0]


class SentenceTransformerEmbedder(Embedder):
    """Sentence-transformers model, loaded once per Python worker."""

    name = "sentence_transformers"

    def __init__(
        self,
        model_name: str = DEFAULT_EMBEDDING_MODEL,
        *,
        revision: str | None = None,
        local_files_only: bool = False,
        dim: int = 384,
    ) -> None:
        self.model_name = model_name
        pinned = DEFAULT_EMBEDDING_REVISION if model_name == DEFAULT_EMBEDDING_MODEL else None
        self.revision = revision or pinned
        self.local_files_only = local_files_only
        self.dim = dim
        self._model = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_model": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._model is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as exc:
                raise RuntimeError("sentence-transformers is not installed") from exc
            self._model = SentenceTransformer(
                self.model_name, revision=self.revision, local_files_only=self.local_files_only
            )
        if not texts:
            return np.empty((0, self.dim), dtype=np.float32)
        return np.asarray(
            self._model.encode(texts, normalize_embeddings=True, show_progress_bar=False),
            dtype=np.float32,
        )
