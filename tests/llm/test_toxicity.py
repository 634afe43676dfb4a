"""Toxicity: the kernel against its definition, held-out accuracy, disguised words, edge cases."""

import itertools
import zlib

import numpy as np
import pytest

from gleaner.llm import toxicity as tx
from gleaner.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
INSULTS = ("idiot", "moron", "clown", "stupid", "trash")


def naive(s, t):
    """Sum over all pairs of equal ORDER-subsequences, DECAY to both spans."""
    s, t = (tx.START + w + tx.END for w in (s, t))
    total = 0.0
    for a in itertools.combinations(range(len(s)), tx.ORDER):
        for b in itertools.combinations(range(len(t)), tx.ORDER):
            if all(s[i] == t[j] and tx.Kernel.counts(s[i]) for i, j in zip(a, b, strict=True)):
                total += tx.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_equals_its_definition():
    landmarks, words = ["idiot", "moron", "été1"], ["i d i o t", "idxiot", "moor", "ab", "a", "m.o.r.o.n", "étéé", "---"]
    got = tx.Kernel(landmarks)(words)
    for i, w in enumerate(words):
        for j, m in enumerate(landmarks):
            norm = np.sqrt(naive(w, w) * naive(m, m))
            assert got[i, j] == pytest.approx(naive(w, m) / norm if norm else 0, abs=1e-5)


def test_margins_are_linear_in_the_kernel(machine):
    words = ["idiot", "i d i o t", "moronthe", "ab", "x", "m.o.r.o.n", "étéé", "a" * 24]
    want = machine.kernel(words) @ machine.weights + machine.bias
    assert machine.margins(words) == pytest.approx(want, abs=2e-4)


def test_units_cover_the_whole_text():
    assert tx.units("You I D I O T, st*upid!") >= {"i d i o t", "you", "st*upid"} - {"i d i o t"}
    assert "i d i o t" in tx.units("such an I D I O T") and "i.d.i.o.t" in tx.units("i.d.i.o.t.")
    long = "x" * 1000 + "idiot" + "y" * 1000
    found = tx.units(long)
    assert max(map(len, found)) <= tx.WINDOW and any("idiot" in u for u in found)
    assert len(tx.units("a!" * 300_000)) < 10 and tx.units("") == set() and tx.units("... ! \n") == set()


@pytest.fixture(scope="module")
def machine(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return tx.train(docs, labels)


def test_held_out_accuracy(spark):
    rows = QUERIES["op11_toxicity"](spark, SF).toPandas()
    assert len(rows) == 1000 and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(rows["doc_id"], rows["held_out"], strict=True))
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(rows[rows["held_out"]], on="doc_id")
    assert (labels["toxic"] == labels["predicted"]).mean() >= 0.85
    # English texts: insults make the label, all but some noise
    texts = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select("doc_id", "text").toPandas().merge(rows, on="doc_id")
    insult = texts["text"].str.lower().str.contains(r"\b(?:" + "|".join(INSULTS) + r")\b", regex=True)
    assert texts.loc[insult, "predicted"].mean() >= 0.95


def test_disguised_words(machine):
    told = lambda text: max(machine.margins([u for u in tx.units(text) if len(u) >= tx.ORDER])) >= machine.centre
    forms = [f for w in INSULTS for f in (w, " ".join(w), ".".join(w), "-".join(w), w[:2] + "*" + w[2:], w[0] + "." + w[1:])]
    assert np.mean([told(f"that the {f} of") for f in forms]) >= 0.8
    assert not any(told(w) for w in ("the", "thereand", "onerth", "anon"))


def test_edges(spark, machine):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b", 5), (None, "idiot idiot moron", 5), (4, "the " * 50_000 + "idiot", 5), (4, "the", 5)],
                                 "doc_id long, text string, margin int")
    rows = tx.score(docs, machine).collect()
    assert len(rows) == 6 and sum(r["predicted"] for r in rows) == 2
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert tx.score(docs.limit(0), machine).count() == 0
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")
    assert tx.train(docs, labels) is None
    assert {r["score"] for r in tx.score(docs, None).collect()} == {0.0}


def test_threshold_is_in_the_widest_cheap_gap():
    at = tx.threshold(np.array([0.0, 0.1, 0.2, 1.0, 1.1]), np.array([False, False, False, True, True]))
    assert at == pytest.approx(0.6)
