"""Bit packing against one bit at a time, chunks that outlive a generation, null and repeated ids."""

import numpy as np
import public_tokenizers
import pytest

from gleaner.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_packing_equals_single_bits(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        plain = [(int(x) >> k) & 1 for x in ids for k in range(bits)]
        data = packing.pack(ids, bits)
        assert data == np.packbits(np.array(plain, np.uint8), bitorder="little").tobytes()
        assert (packing.unpack(data, n, bits) == ids).all()


def test_generations_of_chunks(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing.ChunkEncoder, "KNOWN_CHARS", 60)
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.ChunkEncoder(f.read())
    tok = Tokenizer.from_file(PATH)
    for k in range(40):
        texts = [f"the cat number{k} sat on mat{k % 7}", "", f"  the cat {'x' * k}\n\n again"]
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in encoder.encode(texts)] == want
        assert sum(map(len, encoder.known)) < 200


def test_null_and_repeated_ids(spark):
    rows = [(2, "b"), (None, "null id"), (1, None), (2, "a"), (2, "b"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = packing.write_tokens(docs, PATH, packing.token_folder(spark))
    got = packing.read_documents(made).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 2, 2, 2]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert got[4]["ids_crc32"] == got[5]["ids_crc32"] != got[3]["ids_crc32"]
