"""SQL counterparts against the queries; chunked encoding against whole texts."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest

from gleaner.llm.oracle import ORACLE
from gleaner.llm.packing import ChunkEncoder
from gleaner.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    want = duck.execute(ORACLE[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == rows


@pytest.fixture(scope="module")
def spec():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_chunks_encode_as_whole_texts(spec):
    encoder, rng = ChunkEncoder(spec), random.Random(1)
    assert encoder.by_chunk
    signs = "ab!'s1 \n\t\r\x0b\x0c\x00\x1c\x1f\x85\xa0 ᠎  　﻿​é🙂"
    texts = ["".join(rng.choice(signs) for _ in range(40)) for _ in range(3000)]
    texts += ["", " ", "\n\n", "<|endoftext|> a <|endoftext|>", " <|endoftext|>b<|endoftext|>c d", "x" * 5000 + " y"]
    for got, want in zip(encoder.encode(texts), encoder._whole(texts), strict=True):
        assert np.array_equal(got, want)


def test_known_chunks_are_bounded(spec):
    encoder = ChunkEncoder(spec)
    encoder.KNOWN_CHARS = 50
    for k in range(20):
        text = f"word{k} other{k} and more{k}"
        assert np.array_equal(encoder.encode([text])[0], encoder._whole([text])[0])
        assert encoder.chars < 150


def test_other_tokenizers_get_whole_texts(spec):
    encoder = ChunkEncoder(spec.replace('"add_prefix_space": false', '"add_prefix_space": true', 1)
                           .replace('"add_prefix_space":false', '"add_prefix_space":true', 1))
    assert not encoder.by_chunk
    assert np.array_equal(encoder.encode(["two words"])[0], encoder._whole(["two words"])[0])
