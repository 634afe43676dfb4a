"""Every registered query against a brute-force version over the smallest tables."""

import hashlib
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest

from gleaner.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(spark, name, key):
    got = QUERIES[name](spark, SF).collect()
    return {r[key]: r for r in got}


@pytest.fixture(scope="module")
def docs():
    return duckdb.connect().execute(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def test_decontamination(spark, docs):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = {i: re.findall(pattern, lower(t)) for i, t in duckdb.connect().execute(f"SELECT * FROM '{SF}/benchmark.parquet'").fetchall()}
    grams = {}
    for i, w in items.items():
        for k in range(max(1, len(w) - 12)) if w else ():
            grams.setdefault(tuple(w[k:k + 13]), set()).add(str(i))
    got = rows(spark, "op1_decontamination", "doc_id")
    for doc_id, text, _ in docs:
        w, hit, seen = re.findall(pattern, lower(text)), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k:k + n])) in grams:
                    hit |= set(range(k, k + n))
                    seen |= grams[g]
        want = (doc_id, len(w), len(hit), len(seen), sha(",".join(sorted(seen))), bool(hit) and 20 * len(hit) >= len(w))
        assert tuple(got[doc_id]) == want
    assert any(r["contaminated"] for r in got.values())


def test_secrets(spark, docs):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    got = rows(spark, "op2_secret_scan", "doc_id")
    total = 0
    for doc_id, text, _ in docs:
        found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        spans = [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]
        total += len(spans)
        r = got[doc_id]
        assert r["base_sha256"] == sha(",".join(spans))
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(spans)
        assert set(spans) <= set(r["spans"].split(",")) | {""}
    assert total > 0


def _components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_embeddings(spark):
    data = duckdb.connect().execute(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    v = np.array([r[1] for r in data], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.98
    links = [(data[a][0], data[b][0]) for a, b in zip(*np.nonzero(near)) if a != b and data[a][2] == data[b][2]]
    group = _components([r[0] for r in data], links)
    got = rows(spark, "op3_embedding_near_dedup", "vec_id")
    for i in group:
        assert tuple(got[i]) == (i, sum(a == i for a, _ in links), group[i], group[i] == i)


def test_planted_vectors(spark):
    """The tables hold no links, so groups are planted: copies, a chain, a group wider than the beam."""
    from gleaner.llm import embeddings

    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 32))
    v = [*base, *(base[0] + rng.standard_normal((150, 32)) * 0.05), *(base[1] + rng.standard_normal((40, 32)) * 0.18), *[base[2]] * 60]
    data = [(i, [float(x) for x in w], i % 2) for i, w in enumerate(v)]
    data += [(9000, None, 0), (9001, [0.0] * 32, 0), (9002, [float("nan")] * 32, 1), (9003, data[2][1], None), (9004, [], 1)]
    unit = np.array([w / np.linalg.norm(w) for w in v])
    near = unit @ unit.T >= 0.98
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a != b and a % 2 == b % 2]
    group = _components([r[0] for r in data], links)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(df).collect()}
    assert len(links) > 10_000 and len(got) == len(data)
    for i in group:
        assert tuple(got[i]) == (i, sum(a == i for a, _ in links), group[i], group[i] == i)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_minhash(spark, docs):
    sets = {}
    for doc_id, text, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[doc_id] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a, b in combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    group = _components(sets, links)
    got = rows(spark, "op4_minhash_near_dedup", "doc_id")
    for i in sets:
        assert tuple(got[i]) == (i, len(sets[i]), group[i], group[i] == i)
    assert links


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, at = rows(spark, "op5_token_files", "doc_id"), 0
    for doc_id, text, _ in docs:
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert tuple(got[doc_id]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_language(spark, docs):
    got = rows(spark, "op7_language_id", "doc_id")
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in docs)
    right = [got[i]["lang_pred"] == lang for i, _, lang in docs if got[i]["held_out"]]
    assert np.mean(right) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_lines(spark, docs):
    got = rows(spark, "op8_line_dedup", "doc_id")
    variable, seen = re.compile(r"[0-9]|@|://|^[A-Za-z0-9+/_=-]{24,}$"), {}
    split = {i: [tuple("<*>" if variable.search(x) else x for x in re.split("[ \t\r\f\v]+", line) if x)
                 for line in text.split("\n")] for i, text, _ in docs}
    for i, lines in split.items():
        for k, t in enumerate(lines):
            if len(t) >= 6:
                seen.setdefault(t, []).append((i, k))
    gone = {p for at in seen.values() if len({i for i, _ in at}) > 1 for p in sorted(at)[1:]}
    assert gone
    for i, text, _ in docs:
        lines = text.split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if (i, k) not in gone)
        assert tuple(got[i]) == (i, len(lines) if text else 0, sum(d == i for d, _ in gone), sha(kept))


def test_licenses(spark, docs):
    got = rows(spark, "op6_license_scan", "doc_id")
    for i, text, _ in docs:
        if "\nReleased under the MIT License." in text:
            assert "MIT" in got[i]["licenses"].split(",")
        if "icense" not in text and "Licensed" not in text:
            assert got[i]["licenses"] == ""


def test_urls(spark):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    got = rows(spark, "op9_url_filter", "page_id")
    for page, url in duckdb.connect().execute(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for r, v in rules for h, p in [r.split("/", 1)]
                if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        r = got[page]
        assert (r["host"], r["path"]) == (host, path)
        if fits:
            assert (r["rule"], r["verdict"]) == max(fits)[1:]
        else:
            assert r["rule"] is None and r["verdict"] in ("allow", "block")


def test_sentencepiece(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows(spark, "op10_sentencepiece", "doc_id")
    for i, text, _ in docs:
        ids = sp.encode(text)
        assert tuple(got[i]) == (i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_pipeline(spark, docs):
    import corpus_pipeline

    got = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert 0 < len(got) < len(docs)
