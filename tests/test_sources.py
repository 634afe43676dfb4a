import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import collection, files
from gleaner.operators.chunking import chunk_fixed
from gleaner.operators.digest import ordered_digest
from gleaner.operators.prepare import extract_documents, extract_qa_pairs, first_per_key
from gleaner.plugins.embedders import HashEmbedder
from gleaner.session import shared_dir
from gleaner.sources import catalog, corpus, jsonl
from gleaner.sources.index_store import check_vectors, load_index, write_index


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "corpus"
    (root / "sub dir").mkdir(parents=True)
    (root / "a.md").write_bytes(b"intro\r\n# Title A\r\n\r\ntext  \r\n")
    (root / "sub dir" / "b+c.TXT").write_text("plain é\n\n\n\n\nend", encoding="utf-8")
    (root / "skip.rst").write_text("no")
    return root


def test_folder_scan(spark, folder):
    rows = {r["doc_id"]: r for r in corpus.load_documents(spark, str(folder)).collect()}
    assert set(rows) == {"a.md", "sub dir/b+c.TXT"}
    a, b = rows["a.md"], rows["sub dir/b+c.TXT"]
    assert (a["title"], a["format"], b["title"], b["format"]) == ("Title A", "markdown", "b+c", "text")
    # Text files are read with universal newlines before they are hashed.
    assert a["raw_hash"] == hashlib.sha256(b"intro\n# Title A\n\ntext  \n").hexdigest()
    assert a["normalized_text"] == "intro\n# Title A\n\ntext\n"
    assert b["normalized_text"] == "plain é\n\n\nend" and b["path"].endswith("sub dir/b+c.TXT")


def test_pinned_and_manifest(spark, folder):
    pinned = corpus.load_pinned(spark, str(folder), ["a.md"]).first()
    digest = hashlib.sha256((folder / "a.md").read_bytes()).hexdigest()
    assert (pinned["source_path"], pinned["sha256"]) == ("a.md", digest)
    manifest = corpus.file_manifest(spark, str(folder))
    assert {r["path"] for r in manifest.collect()} == {"a.md", "sub dir/b+c.TXT", "skip.rst"}
    one, two = files.directory_digest(manifest), files.directory_digest(manifest.repartition(3))
    assert one == two and len(one) == 64
    assert files.directory_digest(manifest.where("path <> 'a.md'")) != one


def test_upload_limits(spark):
    def upload(rows):
        corpus.check_upload(spark.createDataFrame(rows, "name string, length long"))

    upload([("a.md", 5), ("b.txt", 6)])
    for rows, message in [
        ([(f"{i}.md", 1) for i in range(101)], "1 to 100 files"), ([("a.md", 2**27)], "bytes"),
        ([("a.md", 1), ("a.md", 1)], "unique"), ([("a.pdf", 1)], "only .md, .txt"), ([], "1 to 100"),
    ]:
        with pytest.raises(ValueError, match=message):
            upload(rows)


def test_eval_lines_are_read_with_tolerance(spark, tmp_path):
    lines = [
        '{"question_id": 7, "question": " Q? ", "answer": "A", "gold_doc_ids": ["a", "b"],'
        ' "reference_answer": " R ", "expected_facts": ["f"]}',
        "", "not json", "[1, 2]", '{"question": "", "gold_doc_ids": ["a"]}',
        '{"question": "x", "gold_doc_ids": []}', '{"question": "x", "gold_doc_ids": "a"}',
        '{"question": "x"}', '{"question": null, "gold_doc_ids": ["n"], "expected_facts": "no"}',
    ]
    path = tmp_path / "qa.jsonl"
    path.write_text("\n".join(lines))
    rows = {r["question"]: r for r in jsonl.load_eval_samples(spark, str(path)).collect()}
    assert set(rows) == {"Q?", "None"}
    q = rows["Q?"]
    assert (q["question_id"], q["gold_doc_ids"], q["reference_answer"], q["expected_facts"]) == (
        "7", ["a", "b"], "R", ["f"])
    assert rows["None"]["expected_facts"] == [] and rows["None"]["reference_answer"] is None


def test_failure_case_defaults(spark, tmp_path):
    rows = [
        {"case_id": "c1", "question": "q", "baseline": {"retriever": "bm25", "top_k": 1},
         "intervention": {"reranker": "cross-encoder", "rerank_top_n": 9}},
        {"case_id": "", "question": "q"}, {"case_id": "c2", "question": " "},
    ]
    path = tmp_path / "cases.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    (row,) = jsonl.load_failure_cases(spark, str(path)).collect()
    assert tuple(row["baseline"]) == ("bm25", 1, "none", None)
    assert tuple(row["intervention"]) == ("dense", 5, "cross-encoder", 9)
    assert (row["gold_doc_ids"], row["expected_label"], row["notes"]) == ([], "no_failure", "")


def test_reviewed_questions(spark, tmp_path):
    rows = [{"question_id": f"{c}{i}", "category": c, "question": "q", "gold_doc_ids": ["d"]}
            for c in jsonl.REVIEWED_CATEGORIES for i in range(4)]
    path = tmp_path / "reviewed.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    found = jsonl.load_reviewed_questions(spark, str(path))
    assert found.count() == 16
    assert jsonl.find_question(found, "dense2").first()["category"] == "dense"
    with pytest.raises(ValueError, match="16 unique"):
        jsonl.check_reviewed(found.limit(15))
    with pytest.raises(ValueError, match="four questions per category"):
        jsonl.check_reviewed(found.withColumn("category", F.lit("dense")))
    with pytest.raises(ValueError, match="text and gold"):
        jsonl.check_reviewed(found.withColumn("question", F.lit("")))


def test_dataset_preparation(spark):
    rows = spark.createDataFrame(
        [(0, " D1 ", "T", "# H\nbody", None, "u"), (1, "D1", "later", "x", None, "u"),
         (2, "D 2", None, "  ", "plain", None), (3, "", "none", "x", None, "u"),
         (4, "D3", "T", None, None, "u")],
        "input_pos int, doc_id string, title string, md_document string, document string, url string")
    docs = {r["doc_id"]: r for r in extract_documents(rows).collect()}
    assert set(docs) == {"D1", "D 2"}
    assert (docs["D1"]["title"], docs["D1"]["prepared_id"]) == ("T", "docs/d1.md")
    assert (docs["D 2"]["title"], docs["D 2"]["text"], docs["D 2"]["slug"]) == ("D 2", "plain", "d-2")
    assert docs["D1"]["markdown"] == "# T\n\n# H\nbody\n"
    qa = spark.createDataFrame(
        [(0, "q0", "Q", "A", None, "D1, nope ,,D1"), (1, "q1", " ", "A", None, "D1"),
         (2, "q2", "Q", None, ["D 2 ", ""], "ignored"), (3, "q3", "Q", "A", None, None)],
        "input_no int, question_id string, question string, correct_answer string,"
        " correct_answer_document_ids array<string>, ground_truths_contexts_ids string")
    id_map = extract_documents(rows).select("doc_id", "prepared_id")
    got = {r["question_id"]: (r["gold_doc_ids"], r["unknown_ids"], r["answer"])
           for r in extract_qa_pairs(qa, id_map).collect()}
    assert got == {"q0": (["docs/d1.md", "nope", "docs/d1.md"], 1, "A"),
                   "q2": (["docs/d-2.md"], 0, ""), "q3": ([], 0, "A")}


def test_first_per_key_keeps_whole_rows(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 3, None)], "k string, n int, v string")
    assert sorted(map(tuple, first_per_key(df, "k", "n").collect())) == [("j", 3, None), ("k", 1, "a")]


@pytest.fixture(scope="module")
def stored(spark, make_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ix"))
    docs = make_docs({f"s{i % 3}/d{i}.md": f"# Doc {i}\n\nabout topic{i} and words. " * 9 for i in range(9)})
    write_index(path, docs, chunk_fixed(docs, 120, 20), corpus_root="x", chunk_size=120,
                chunk_overlap=20, embedder=HashEmbedder(8))
    return path


def test_index_round_trip(spark, stored):
    index = load_index(spark, stored)
    m = index.manifest
    assert (m["schema_version"], m["document_count"], m["embedding_dim"]) == ("2.0", 9, 8)
    assert m["chunk_count"] == index.chunks.count() == index.vectors.count() == index.lexical.stats.chunk_count
    joined = index.documents.join(index.chunks, "doc_id").select(
        (F.substr("normalized_text", F.col("char_start") + 1, F.char_length("text")) == F.col("text"))
        .alias("same"))
    assert joined.where("not same").count() == 0
    order = [(r["doc_id"], r["char_start"]) for r in index.chunks.orderBy("position").collect()]
    assert order == sorted(order)
    listed = catalog.list_indexes(spark, stored.rsplit("/", 1)[0]).collect()
    assert any(r["chunk_count"] == m["chunk_count"] for r in listed)


def test_positions_compare_paths_by_component(spark, make_docs):
    from gleaner.operators.lexical import with_position

    docs = make_docs({k: "text" for k in ["a/b.md", "a-b.md", "a/1/z.md", "a1/b.md"]})
    got = [r["doc_id"] for r in with_position(chunk_fixed(docs)).orderBy("position").collect()]
    assert got == ["a/1/z.md", "a/b.md", "a-b.md", "a1/b.md"]


def test_vector_consistency_is_checked(spark, stored):
    index = load_index(spark, stored)
    with pytest.raises(ValueError, match="mismatch"):
        check_vectors(index.chunks, index.vectors.limit(3), 8)
    with pytest.raises(ValueError, match="width"):
        check_vectors(index.chunks, index.vectors, 9)


def test_collection_life_cycle(spark, stored, tmp_path):
    index = load_index(spark, stored)
    box = collection.CollectionCatalog(spark, str(tmp_path / "points"))
    assert box.status("lab", index.chunks, index.vectors) is None
    first = box.prepare("lab", index.chunks, index.vectors)
    assert first.verified and not first.reused and first.dimension == 8
    assert box.prepare("lab", index.chunks, index.vectors).reused
    assert collection.payload_filters_available(box.read(first.collection), index.chunks)
    # Damage the published copy: it is rebuilt beside and the alias moves.
    damaged = box.read(first.collection).withColumn("source_group", F.lit("")).collect()
    spark.createDataFrame(damaged, box.read(first.collection).schema).write.mode("overwrite").parquet(
        str(tmp_path / "points" / first.collection))
    assert not collection.payload_filters_available(box.read(first.collection), index.chunks)
    assert box.status("lab", index.chunks, index.vectors) is None
    second = box.prepare("lab", index.chunks, index.vectors)
    assert not second.reused and second.collection != first.collection
    assert box.status("lab", index.chunks, index.vectors).collection == second.collection
    other = collection.vector_fingerprint(index.vectors.withColumn("position", -F.col("position")))
    assert other != second.source_fingerprint


def test_digest_repeats_over_calls_partitions_and_files(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 16).select(
        F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("position"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    rows.write.parquet(str(tmp_path / "many"))
    rows.coalesce(3).sort("digest").write.parquet(str(tmp_path / "few"))
    many, few = (spark.read.parquet(str(tmp_path / n)) for n in ("many", "few"))
    values = {ordered_digest(t, "position") for t in (many, many, many.repartition(7), few)}
    level = [r["digest"] for r in rows.orderBy("position").collect()]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i:i + 1024]).encode()).hexdigest() for i in range(0, len(level), 1024)]
    assert values == set(level)
    assert ordered_digest(many.limit(0), "position") == ""


def test_two_publishers_one_wins(spark, stored, tmp_path):
    index = load_index(spark, stored)
    box, other = (collection.CollectionCatalog(spark, str(tmp_path / "points")) for _ in range(2))
    first = box.prepare("lab", index.chunks, index.vectors)
    pinned = box.snapshot("lab")
    reader = box.read(pinned.collection)
    n = index.chunks.count()
    # Both start from the first snapshot; the second commit finds the log moved on.
    moved = index.vectors.withColumn("embedding", F.transform("embedding", lambda x: x * 2 + 1))
    slow, build = other.snapshot("lab"), other.build

    def overtaken(*args):
        build(*args)
        box.prepare("lab", index.chunks, moved)

    other.build = overtaken
    third = index.vectors.withColumn("embedding", F.transform("embedding", lambda x: x - 3))
    with pytest.raises(collection.PublishConflict):
        other.prepare("lab", index.chunks, third)
    with pytest.raises(collection.PublishConflict):
        other.commit(slow, "lab__stale")
    now = box.snapshot("lab")
    assert (slow.version, now.version) == (1, 2) and now.collection not in (first.collection, "lab__stale")
    assert box.status("lab", index.chunks, moved).collection == now.collection
    # The loser's folder is gone, the pinned reader goes on, old collections leave on request only.
    assert len([p for p in (tmp_path / "points").iterdir() if p.name.startswith("lab__")]) == 2
    assert reader.count() == n and box.expire("lab", keep=2) == []
    assert box.expire("lab", keep=1) == [first.collection] and box.read(now.collection).count() == n


def test_cluster_needs_a_shared_folder():
    class Context:
        applicationId, master = "app", "spark://host:7077"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_file_status(spark):
    def table(rows):
        return spark.createDataFrame(rows, "path string, sha256 string")

    def status(actual):
        return files.files_status(files.compare_files(table([("a", "1"), ("b", "2")]), table(actual))).first()[0]

    assert status([("a", "1"), ("b", "2")]) == "matches"
    assert status([("a", "1"), ("b", "x")]) == "digest_mismatch"
    assert status([("a", "x")]) == "missing_files"
    assert status([("c", "1")]) == "unexpected_files"


def test_lesson_and_seed_catalogs(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "manifest.json").write_text(json.dumps({"id": "p1", "schema_version": 1, "lessons": [
        {"id": "l2", "order": 2, "title": "b"}, {"id": "l1", "order": 1, "title": "a"}]}))
    (tmp_path / "p1" / "corpus.json").write_text('{"id": "c", "name": "n", "kind": "k", "file_count": 3}')
    assert [r["id"] for r in catalog.list_lessons(spark, str(tmp_path)).collect()] == ["l1", "l2"]
    assert catalog.list_corpora(spark, str(tmp_path)).first()["file_count"] == 3
    (tmp_path / "seed.json").write_text(json.dumps({"assets": [
        {"id": "x", "path": "p", "target": "t", "files": [{"path": "f", "sha256": "s"}]}]}))
    assert tuple(catalog.seed_assets(spark, str(tmp_path / "seed.json")).first()) == ("x", "t", "f", "s")
    assert catalog.safe_name("ok-1") == "ok-1"
    for bad in ("../x", "a/b", "", "a..b"):
        with pytest.raises(ValueError, match="invalid identifier"):
            catalog.safe_name(bad)
