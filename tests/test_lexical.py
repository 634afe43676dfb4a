import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.operators import lexical as L
from gleaner.operators.chunking import chunk_fixed
from gleaner.session import write_and_reread
from gleaner.sources.index_store import read_lexical, write_lexical


class Okapi:
    """Plain restatement of the scoring formula."""

    def __init__(self, texts):
        self.docs = [Counter(t.lower().split()) for t in texts]
        n = len(texts)
        df = Counter(t for d in self.docs for t in d)
        raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
        floor = 0.25 * sum(raw.values()) / len(raw)
        self.idf = {t: v if v >= 0 else floor for t, v in raw.items()}
        self.mean_len = sum(sum(d.values()) for d in self.docs) / n

    def score(self, query):
        out = []
        for d in self.docs:
            norm = 1.5 * (0.25 + 0.75 * sum(d.values()) / self.mean_len)
            out.append(sum(
                self.idf.get(t, 0.0) * d[t] * 2.5 / (d[t] + norm)
                for t in query.lower().split() if d[t]
            ))
        return out

    def top(self, query, k):
        s = self.score(query)
        return sorted(range(len(s)), key=lambda i: (-s[i], i))[:k] if query.split() else []


def in_memory(make_docs, texts):
    docs = make_docs({f"{i:03d}.txt": t for i, t in enumerate(texts)})
    chunks = write_and_reread(L.with_position(chunk_fixed(docs)), "chunks")
    blocks = write_and_reread(L.build_blocks(chunks), "blocks")
    lengths, terms = L.build_chunk_lengths(chunks), L.document_frequency(blocks)
    return L.LexicalIndex(lengths, blocks, terms, L.corpus_stats(lengths, terms))


def ranked(index, queries, k):
    return L.with_ids(index, L.bm25_top_k(index, queries, k), 1000)


def ask(spark, questions):
    return spark.createDataFrame(
        [(f"q{i}", q) for i, q in enumerate(questions)], "query_id string, question string"
    )


TEXTS = {
    "three": ["rare term appears twice rare", "common words only", "rare once"],
    # Every word stands in most texts: the idf floor is negative.
    "negative floor": ["a b c", "a b c", "a b", "a c z"],
    "two": ["alpha beta", "gamma delta"],
    "copies": ["same words here"] * 5 + ["other thing", "one more here", "same again", "x y z", "q"],
}
QUESTIONS = ["rare rare term", "a z", "alpha", "unknown words", "  ", "same here here", "c", "q x"]


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("k", [1, 4, 20])
def test_ranking_matches_formula(spark, make_docs, name, k):
    texts = TEXTS[name]
    index, okapi = in_memory(make_docs, texts), Okapi(texts)
    rows = ranked(index, ask(spark, QUESTIONS), k).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((int(r["doc_id"][:3]), r["score"], r["rank"]))
    for i, q in enumerate(QUESTIONS):
        want, scores = okapi.top(q, k), okapi.score(q)
        found = got.get(f"q{i}", [])
        assert [d for d, _, _ in found] == want, (name, q)
        assert [r for *_, r in found] == list(range(1, len(want) + 1))
        assert [s for _, s, _ in found] == pytest.approx([scores[d] for d in want], abs=1e-9)


def test_many_chunks_with_zero_fill_from_the_front(spark, make_docs):
    texts = [f"word{i} filler" if i % 7 else f"word{i} needle" for i in range(60)]
    index, okapi = in_memory(make_docs, texts), Okapi(texts)
    rows = ranked(index, ask(spark, ["word33", "needle", "nothing"]), 12).collect()
    for i, q in enumerate(["word33", "needle", "nothing"]):
        found = [int(r["doc_id"][:3]) for r in sorted(rows, key=lambda r: r["rank"])
                 if r["query_id"] == f"q{i}"]
        assert found == okapi.top(q, 12)


def test_bounds(spark, make_docs):
    index = in_memory(make_docs, ["a", "b"])
    assert L.bm25_top_k(index, ask(spark, ["a"]), 0).count() == 0
    with pytest.raises(ValueError, match="top_k must be non-negative, got -1"):
        L.bm25_top_k(index, ask(spark, ["a"]), -1)
    empty = in_memory(make_docs, [""])
    assert empty.stats.is_empty and L.bm25_top_k(empty, ask(spark, ["a"]), 3).count() == 0


def test_explanation_adds_up_to_the_score(spark, make_docs):
    index = in_memory(make_docs, TEXTS["three"] + ["filler %d" % i for i in range(9)])
    asked = ask(spark, ["rare rare term absent"])
    rows = L.bm25_explain(index, asked, L.bm25_top_k(index, asked, 4)).collect()
    assert len(rows) == 4
    for r in rows:
        assert [t["term"] for t in r["terms"]] == ["rare", "term", "absent"]
        assert sum(t["contribution"] for t in r["terms"]) == pytest.approx(r["score"], abs=1e-12)
    best = next(r for r in rows if r["rank"] == 1)
    assert [(t["query_frequency"], t["term_frequency"], t["document_frequency"])
            for t in best["terms"]] == [(2, 2, 2), (1, 1, 1), (1, 0, 0)]
    assert best["document_length"] == 5 and best["k1"] == 1.5 and best["b"] == 0.75


def test_unknown_results_are_errors(spark, make_docs):
    index, asked = in_memory(make_docs, TEXTS["three"]), ask(spark, ["rare term", "common"])
    ranked_rows = L.bm25_top_k(index, asked, 1)
    lost = ranked_rows.withColumn("position", F.col("position") + 1_000_000)
    with pytest.raises(Exception, match="unknown chunk position: 1000"):
        L.bm25_explain(index, asked, lost).collect()
    with pytest.raises(Exception, match="unknown query: q1"):
        L.bm25_explain(index, asked.where("query_id = 'q0'"), ranked_rows).collect()


def stored(spark, make_docs, texts, path, shards=4):
    docs = make_docs({f"{i:04d}.txt": t for i, t in enumerate(texts)})
    chunks = write_and_reread(L.with_position(chunk_fixed(docs)), "chunks")
    write_lexical(chunks, path, shards=shards)
    return read_lexical(spark, path)


def test_term_frequencies_are_counts(spark):
    texts = ["b a b", "", "x", "é a é é"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", L.term_frequencies(F.split("text", " ")).alias("tf")).collect()
    for r in rows:
        assert {x["term"]: x["tf"] for x in r["tf"]} == dict(Counter(r["text"].split(" ")))
    assert spark.range(1).select(L.term_frequencies(F.array().cast("array<string>")).alias("t")).first()["t"] is None


def test_stored_index_reads_the_folders_of_query_terms(spark, make_docs, tmp_path):
    texts = [f"word{i % 9} other{i} the" for i in range(40)]
    index = stored(spark, make_docs, texts, str(tmp_path / "lex"))
    terms = write_and_reread(L.weighted_terms(index, L.query_terms(ask(spark, ["word3 the"]))), "terms")
    plan = L._bounds(index, terms, True)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "max_tf" in line and "FileScan" in line)
    assert "dynamicpruning" in scan and "entries" not in scan
    rows = ranked(index, ask(spark, ["word3 the"]), 6).orderBy("rank").collect()
    assert [int(r["doc_id"][:4]) for r in rows] == Okapi(texts).top("word3 the", 6)


@pytest.fixture(scope="module")
def zipf(spark, make_docs, tmp_path_factory):
    """Chunks whose words are frequent or rare, and questions that mix both."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(5, 60))) for _ in range(2000)]
    questions = [" ".join(rng.choices(words, weights, k=6) + [f"w{rng.randint(100, 399)}"] * 2) for _ in range(12)] + ["w0 w1 w2", "w399"]
    return stored(spark, make_docs, texts, str(tmp_path_factory.mktemp("lex") / "z"), shards=8), texts, questions


@pytest.mark.parametrize("broadcast", [True, False])
def test_pruned_ranking_equals_the_formula(spark, zipf, monkeypatch, broadcast):
    index, texts, questions = zipf
    if not broadcast:
        monkeypatch.setattr(L, "BROADCAST_ROW_LIMIT", 3)
    okapi = Okapi(texts)
    rows = L.with_ids(index, L.bm25_top_k(index, ask(spark, questions), 5), 1000).collect()
    for i, q in enumerate(questions):
        found = [int(r["doc_id"][:4]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == f"q{i}"]
        assert found == okapi.top(q, 5), q


def test_most_pairs_are_never_scored(spark, zipf):
    index, _, questions = zipf
    terms = write_and_reread(L.weighted_terms(index, L.query_terms(ask(spark, questions))), "terms")
    cells = L._bounds(index, terms, True).select("query_id", "cell").distinct()
    every = L._scores(index.blocks, L._wanted(cells, terms, index.shards), index.stats)
    added = L._sums(index, terms, 5, True).count()
    assert added < 0.5 * every.count()
    assert L._pruned_scores(index, terms, 5, True).count() <= 2 * 5 * len(questions)


def test_scores_add_up_in_the_order_of_the_question(spark, zipf):
    """Bit for bit: parts are added token by token."""
    index, texts, questions = zipf
    okapi, rows = Okapi(texts), L.with_ids(index, L.bm25_top_k(index, ask(spark, questions), 5), 1000).collect()
    for r in rows:
        # The floor of frequent words rests on a mean, whose own order of addition is free.
        assert r["score"] == pytest.approx(okapi.score(questions[int(r["query_id"][1:])])[int(r["doc_id"][:4])], rel=1e-14)


def test_blocks_are_made_where_the_chunks_lie(spark):
    """Counts over any batches, one exchange, no grouping of postings; wordless chunks have none."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdeé", k=rng.randint(0, 12))) for _ in range(60)] + ["", "  ", None, "A a"]
    rows = [(i + (5 << 33) * (i > 30), t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = L.build_blocks(spark.createDataFrame(rows, "position long, text string"), 3, 2)
        got = made.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = {(t, p): (n, len((x or "").split())) for p, x in rows for t, n in Counter((x or "").lower().split()).items()}
    assert {(b["term"], e["position"]): (e["tf"], e["dl"]) for b in got for e in b["entries"]} == want
    for b in got:
        assert {e["position"] >> L.GRID_BITS for e in b["entries"]} == {b["cell"]} and b["n"] == len(b["entries"])
        assert (b["max_tf"], b["min_dl"]) == (max(e["tf"] for e in b["entries"]), min(e["dl"] for e in b["entries"]))
    assert {r["term"]: r["df"] for r in L.document_frequency(made).collect()} == Counter(t for t, _ in want)
    assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()


def unposted(spark, make_docs, texts, path):
    """An index without postings, over chunks in several files."""
    docs = make_docs({f"{i:04d}.txt": t for i, t in enumerate(texts)})
    chunks = write_and_reread(L.cut_in_order(docs, chunk_fixed), "chunks")
    write_lexical(chunks, path, postings=False)
    with pytest.raises(ValueError, match="has no postings"):
        read_lexical(spark, path)
    return read_lexical(spark, path, chunks)


@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("name", TEXTS)
def test_reading_the_texts_ranks_as_the_formula(spark, make_docs, tmp_path, monkeypatch, name, tiled):
    texts = TEXTS[name]
    index, okapi = unposted(spark, make_docs, texts, str(tmp_path / "lex")), Okapi(texts)
    if tiled:
        monkeypatch.setattr(L, "SCAN_TERMS", 2)
        monkeypatch.setattr(L, "SCAN_SHARD", 2)
    rows = ranked(index, ask(spark, QUESTIONS), 4).collect()
    for i, q in enumerate(QUESTIONS):
        found = [(int(r["doc_id"][:4]), r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == f"q{i}"]
        assert [d for d, _ in found] == okapi.top(q, 4), q
        assert [s for _, s in found] == pytest.approx([okapi.score(q)[d] for d, _ in found], abs=1e-9)


def test_both_rankings_and_explanations_agree_bit_for_bit(spark, zipf, make_docs, tmp_path, monkeypatch):
    """Postings and texts give the same rows; of the texts no task hands over more than k chunks a question."""
    index, texts, questions = zipf
    other, asked = unposted(spark, make_docs, texts, str(tmp_path / "lex")), ask(spark, questions)
    other = L.LexicalIndex(other.chunks, None, index.terms, index.stats, texts=other.texts)
    monkeypatch.setattr(L, "SCAN_RUN", 33)
    want, got = ([tuple(r) for r in ranked(ix, asked, 5).select("query_id", "rank", "doc_id", "score").orderBy("query_id", "rank").collect()]
                 for ix in (index, other))
    assert got == want
    explained = [sorted((r["query_id"], r["rank"], r["document_length"], tuple(map(tuple, r["terms"]))) for r in
                        L.bm25_explain(ix, asked, L.bm25_top_k(ix, asked, 3)).collect()) for ix in (index, other)]
    assert explained[0] == explained[1]
    terms = write_and_reread(L.weighted_terms(other, L.query_terms(asked.withColumn("query_id", F.substring("query_id", 2, 9).cast("long")))), "terms")
    found = L._scanned(other, terms, 5)
    assert found.count() <= 5 * len(questions) * found.rdd.getNumPartitions()


def test_frequent_questions_read_the_texts(spark, make_docs, tmp_path):
    chunks = write_and_reread(L.with_position(chunk_fixed(make_docs({f"{i:02d}": f"the w{i} a b c d e f g h" for i in range(60)}))), "chunks")
    write_lexical(chunks, str(tmp_path / "lex"))
    index = read_lexical(spark, str(tmp_path / "lex"), chunks)
    for question, scans in (("the", True), ("w7", False)):
        assert L._scans(index, L.weighted_terms(index, L.query_terms(ask(spark, [question])))) is scans
        assert [int(r["doc_id"]) for r in ranked(index, ask(spark, [question]), 2).orderBy("rank").collect()] == (
            [0, 1] if scans else [7, 0])


def test_arrow_and_spark_cut_the_same_words(spark):
    """Every blank, blank edges, blank texts, capitals of special lower case; counts over any batches."""
    from gleaner.functions.text import tokenize

    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = ["\u200b\ufeff".join(["x", *blanks, "y"]), " ".join(blanks) + "ΟΔΟΣ İx", "".join(blanks), "", None, " a b", "a b ", "b a a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = [r[0] or [] for r in df.select(tokenize(F.col("text"))).collect()]
    length, coded = L.coded_words(df.select(F.lower("text").alias("t")).coalesce(1).toArrow().column("t").combine_chunks())
    words = iter(coded.to_pylist())
    assert [[next(words) for _ in range(n)] for n in length] == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        terms, stats = L.corpus_terms(df)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert {r["term"]: r["df"] for r in terms.collect()} == Counter(t for w in want for t in set(w))
    assert (stats.chunk_count, stats.token_count) == (len(texts), sum(map(len, want)))


def test_documents_cut_once_keep_the_order_of_chunks(spark, make_docs):
    docs = make_docs({f"{d}/{i}": "word and more. " * (1 + 37 * i % 300) for d in ("a", "a-b", "a/b", "b") for i in range(9)})
    rows = [[r["chunk_id"] for r in write_and_reread(made, "chunks").orderBy("position").collect()]
            for made in (L.with_position(chunk_fixed(docs)), L.cut_in_order(docs, chunk_fixed))]
    assert rows[0] == rows[1] and len(rows[0]) > 36
    plan = L.cut_in_order(docs, chunk_fixed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")  # cut after the one shuffle, not before
