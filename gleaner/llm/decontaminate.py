"""Benchmark decontamination: broadcast hash set of test n-grams, hits verified, rows judged.

Words are hashed 13 at a time inside each document's row; positions whose hash is in the
benchmark's hash set become candidates, which are verified by joining hash and words with the
windows. Only candidates leave the row, so no text is shuffled. Above WINDOW_LIMIT windows the set is
not broadcast: every position is joined, with the same rows.

Cases: null or wordless texts have no words and are clean; items without words are ignored;
rows equal in id and text are one document; an empty benchmark marks nothing; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N = 13
WINDOW_LIMIT = 200_000  # windows (hashes of 8 bytes, words of some 100) that may be broadcast
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), BREAK), lambda w: w != "")


def windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, gram, len, items): distinct windows and the ids of the items that have them."""
    w = F.col("w")
    grams = F.when(F.size(w) < n, F.array(w)).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.slice(w, i, n)))
    return (benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
            .where(F.size("w") > 0).select("item", F.explode(grams).alias("g"))
            .select("item", F.xxhash64("g").alias("h"), F.array_join("g", " ").alias("gram"), F.size("g").alias("len"))
            .groupBy("h", "gram", "len").agg(F.sort_array(F.collect_set("item")).alias("items")))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: id, key (hash of the text), n_words, n_hit, items, spans (start, len in words)."""
    from gleaner.session import write_and_reread

    grams = write_and_reread(windows(benchmark, n, item_col, item_text_col), "windows")
    small = grams.limit(WINDOW_LIMIT + 1).count() <= WINDOW_LIMIT
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # at most n values
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), words(F.col(text_col)).alias("w"))
    parts = []
    for size in lengths:
        test = "true"
        if small:
            hashes = [r[0] for r in grams.where(F.col("len") == size).select("h").distinct().collect()]
            test = f"xxhash64(slice(w, i, {size})) IN ({','.join(f'{h}L' for h in hashes)})".replace(
                "-9223372036854775808L", "(-9223372036854775807L - 1L)")
        parts.append(f"""CASE WHEN size(w) >= {size} THEN transform(
            filter(sequence(1, greatest(size(w) - {size - 1}, 1)), i -> {test}),
            i -> struct(i AS pos, {size} AS len, xxhash64(slice(w, i, {size})) AS h,
                        array_join(slice(w, i, {size}), ' ') AS gram))
            ELSE array() END""")
    empty = "CAST(array() AS array<struct<pos:int,len:int,h:bigint,gram:string>>)"
    cands = base.select("doc_id", "key", F.size("w").alias("n_words"),
                        F.expr(f"concat({', '.join([empty, *parts])})").alias("c"))
    rows = cands.select("doc_id", "key", "n_words", F.explode_outer("c").alias("c")).select(
        "doc_id", "key", "n_words", "c.pos", "c.len", "c.h", "c.gram")
    hit = rows.join(F.broadcast(grams) if small else grams, ["h", "gram", "len"], "left")
    merged = hit.groupBy("doc_id", "key", "n_words").agg(
        F.array_sort(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("pos", "len")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(1).alias("next"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["next"], s["pos"] + s["len"]).alias("next"),
            (acc["n"] + F.greatest(s["pos"] + s["len"] - F.greatest(acc["next"], s["pos"]), F.lit(0))).alias("n")),
        lambda acc: acc["n"])
    return merged.withColumn("n_hit", covered)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit").cast("long") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that are not contaminated, all their columns as they were."""
    bad = scan(docs, benchmark, **kw).where(contaminated()).select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    id_col, text_col = kw.get("id_col", "doc_id"), kw.get("text_col", "text")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text_col]) == bad["__key"]), "left_anti")
