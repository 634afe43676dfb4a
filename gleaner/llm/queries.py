"""Registered queries of the package: the contract's columns over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, embeddings, langid, licenses, lines, manifest, minhash, packing, pieces, secrets, toxicity, tries, urls

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decontamination(spark, sf_dir):
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        decontaminate.contaminated().alias("contaminated"))


def secret_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.log_ratios(secrets.train(docs)))
    kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", kind("assign"), kind("access"), kind("hex"),
                        F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"),
                        secrets.digest(F.col("found")).alias("spans"))


def embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def token_files(spark, sf_dir):
    manifest = packing.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), packing.token_folder(spark))
    return packing.read_documents(manifest)


def license_scan(spark, sf_dir):
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.train(docs)).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def url_filter(spark, sf_dir):
    return urls.judge_urls(_table(spark, sf_dir, "pages"), urls.rules_table(spark)).select(
        "page_id", "host", "path", "rule", "verdict")


def sentencepiece_codec(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_pieces(docs, public_tokenizers.path(PIECE_BPE)).drop("text")


def toxicity_scores(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = manifest.manifest(_table(spark, sf_dir, "documents"), tampered, F.replace("text", F.lit("\n"), F.lit("")))
    return found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")


def conversation_trie(spark, sf_dir):
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return tries.prefix_nodes(tries.rebuilt(_table(spark, sf_dir, "conversations"), taken.cast("int"))).drop("key")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontamination": decontamination,
    "op2_secret_scan": secret_scan,
    "op3_embedding_near_dedup": embedding_near_dedup,
    "op4_minhash_near_dedup": minhash_near_dedup,
    "op5_token_files": token_files,
    "op6_license_scan": license_scan,
    "op7_language_id": language_id,
    "op8_line_dedup": line_dedup,
    "op9_url_filter": url_filter,
    "op10_sentencepiece": sentencepiece_codec,
    "op11_toxicity": toxicity_scores,
    "op12_merkle_manifest": merkle_manifest,
    "op13_conversation_trie": conversation_trie,
    "pipeline": pipeline,
}
