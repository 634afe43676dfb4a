"""Okapi BM25 over chunk tables, pruned without losing a rank.

Chunks are known by ``position``, a number that grows in document order and so also
decides ties. The postings of a term are cut into blocks by position: a block holds the
chunks of one grid cell (GRID numbers in a row) and, beside them, their largest term
frequency and smallest length, from which an upper bound of any score in it follows.
Blocks are partitioned by a hash of the term, so that a query reads the folders of its own
terms only, and a frequent term is as many rows as there are cells.

A ranking takes four steps: block headers alone give every query an upper bound per
cell; the cells with the highest bounds are added up, and the k-th best sum is the
threshold; only cells that can still reach it are added up as well; the chunks that
come out on top get their exact scores.

Questions that ask for much of the corpus, and indexes without postings, are ranked by one
reading of the texts instead: a task holds all questions, counts their words in runs of chunks
and keeps each question's k best, so that work and output grow with the corpus alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.checks import known
from gleaner.functions.text import has_text, path_order, token_count, tokenize
from gleaner.session import BROADCAST_ROW_LIMIT, broadcast_if_small, row_count_within, write_and_reread

# The defaults of Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25

# Similarities that agree to this many steps per unit count as ties, so that the order
# in which a block product adds up doubles cannot change a ranking.
TIE_STEPS = 1e9

# Positions in a cell of the grid (a power of two), and cells scored to find a threshold.
GRID_BITS = 3
SEED_CELLS = 8
# Bounds and scores are sums of the same parts in another order; a bound counts as
# reached this much below the threshold.
SLACK = 1e-9
# Tokens in a file of the stored index, folders at least, and parts of a frequent term
# where query terms are too many to broadcast.
FILE_POSTINGS, LEAST_SHARDS, SLICES = 1_000_000, 8, 16
# Wanted blocks, with their lists, that go to every task; more of them meet the blocks by a shuffle.
WANTED_ROWS = 200_000
# Blocks that a task hands over at a time.
BATCH_BLOCKS = 20_000
_MADE_BLOCKS = (
    "term STRING, cell BIGINT, n BIGINT, max_tf INT, min_dl INT, "
    "entries ARRAY<STRUCT<position: BIGINT, dl: INT, tf: INT>>"
)

# Chunks remembered from the start of a corpus: enough for a top 100.
HEAD_CHUNKS = 200

# A reading of the texts is worth it from asked postings of one in that many tokens on.
SCAN_SHARE = 20
# Terms of questions that every task holds; more of them are cut into tiles that meet shards of chunks.
SCAN_TERMS, SCAN_SHARD = 100_000, 50_000
# Bytes of the parts of a run of chunks, and chunks in a run at most.
SCAN_BYTES, SCAN_RUN = 8 << 20, 512


@dataclass(frozen=True)
class CorpusStats:
    """Scalars of the whole corpus and its first few chunk ids; all the driver sees."""

    chunk_count: int
    token_count: int
    vocabulary: int
    mean_idf: float
    # The first chunks of the corpus; they take the ranks no score claims.
    head: tuple = ()

    @property
    def average_length(self) -> float:
        return self.token_count / self.chunk_count if self.chunk_count else 0.0

    @property
    def is_empty(self) -> bool:
        return self.token_count == 0


@dataclass(frozen=True)
class LexicalIndex:
    """chunks(position, chunk_id, doc_id, char_start, dl), terms(term, df),
    blocks(shard, term, cell, n, max_tf, min_dl, entries), texts(position, text); one of the last two may be absent"""

    chunks: DataFrame
    blocks: DataFrame | None
    terms: DataFrame
    stats: CorpusStats
    shards: int = LEAST_SHARDS
    texts: DataFrame | None = None


def tie_key(score: Column) -> Column:
    return F.floor(score * TIE_STEPS + F.lit(0.5))


# ---------------------------------------------------------------- index tables

def with_position(chunks: DataFrame) -> DataFrame:
    """Number chunks in document order.

    The numbers have gaps and depend on how the sort was split, so the result has to
    be stored before it is read twice.
    """
    return _numbered(chunks.orderBy(path_order(F.col("doc_id")), "char_start"))


def cut_in_order(documents: DataFrame, cut) -> DataFrame:
    """``with_position(cut(documents))`` for a chunker that works inside each document: documents are dealt by ranges, then cut once."""
    dealt = documents.repartitionByRange(path_order(F.col("doc_id")))
    return _numbered(cut(dealt).sortWithinPartitions(path_order(F.col("doc_id")), "char_start"))


def _numbered(ordered: DataFrame) -> DataFrame:
    return ordered.withColumn("position", F.monotonically_increasing_id())


def shard_of(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def cell_of(position: Column) -> Column:
    return F.shiftright(position, GRID_BITS)


def shards_for(tokens: int) -> int:
    return min(max(LEAST_SHARDS, -(-tokens // FILE_POSTINGS)), 4096)


def term_frequencies(tokens: Column) -> Column:
    """array<struct<term, tf>> of a token array: runs of the sorted tokens."""
    def bind(value: Column, of) -> Column:
        return F.transform(F.array(value), of)[0]

    def runs(t: Column) -> Column:
        n = F.size(t)
        last = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == n) | (t[i - 1] != F.get(t, i)))
        return bind(last, lambda e: F.transform(e, lambda i, k: F.struct(
            t[i - 1].alias("term"), (i - F.when(k == 0, 0).otherwise(e[k - 1])).cast("int").alias("tf"))))

    return F.when(F.size(tokens) > 0, bind(F.array_sort(tokens), runs))


def build_blocks(chunks: DataFrame, shards: int = LEAST_SHARDS, slices: int = 1) -> DataFrame:
    """(shard, term, cell, n, max_tf, min_dl, entries) of (position, text).

    Blocks are made where the chunks lie, a batch at a time; the one shuffle deals them into
    folders, a frequent term into ``slices`` parts by ranges of cells. A cell that two batches
    share has a block of a term in each; bounds and scores add up the same.
    """
    tokens = chunks.select("position", tokenize(F.col("text")).alias("tokens"))
    blocks = tokens.mapInArrow(_blocks_of_batches, _MADE_BLOCKS)
    part = F.pmod(F.xxhash64(F.shiftright("cell", 10)), F.lit(slices))
    made = blocks.withColumn("shard", shard_of(F.col("term"), shards)).withColumn("slice", part)
    return made.repartition(shards * slices, "shard", "slice").select("shard", *blocks.columns)


def _blocks_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each batch counted over numbered terms, cut where term or cell changes."""
    for batch in batches:
        lists, where = batch.column("tokens"), batch.column("position").to_numpy()
        order = np.argsort(where, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        length, coded = _coded(lists)
        if not len(coded):
            continue
        # A posting is a term's number and the rank of its chunk.
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(order) + np.repeat(rank, length), return_counts=True)
        term, row = key // len(order), order[key % len(order)]
        position, dl, tf = where[row], length[row].astype(np.int32), tf.astype(np.int32)
        cell = position >> GRID_BITS
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (cell[1:] != cell[:-1])])
        ends = np.r_[starts[1:], len(term)]
        entries = pa.StructArray.from_arrays([pa.array(position), pa.array(dl), pa.array(tf)], ["position", "dl", "tf"])
        made = pa.RecordBatch.from_arrays([
            coded.dictionary.take(pa.array(term[starts])), pa.array(cell[starts]), pa.array(ends - starts),
            pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(dl, starts)),
            pa.ListArray.from_arrays(pa.array(np.r_[starts, len(term)].astype(np.int32)), entries),
        ], ["term", "cell", "n", "max_tf", "min_dl", "entries"])
        for at in range(0, made.num_rows, BATCH_BLOCKS):
            yield made.slice(at, BATCH_BLOCKS)


def build_chunk_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "position", "chunk_id", "doc_id", "char_start",
        token_count(F.col("text")).alias("dl"),
    )


def document_frequency(blocks: DataFrame) -> DataFrame:
    """How many chunks hold each term; read from block headers, combined map-side."""
    return blocks.groupBy("term").agg(F.sum("n").alias("df"))


def raw_idf(df: Column, chunk_count: Column) -> Column:
    return F.log(chunk_count - df + 0.5) - F.log(df + 0.5)


def floored_idf(df: Column, stats: CorpusStats) -> Column:
    """A negative idf is replaced by a share of the vocabulary's mean idf."""
    raw = raw_idf(df, F.lit(float(stats.chunk_count)))
    return F.when(raw < 0, F.lit(EPSILON * stats.mean_idf)).otherwise(raw)


def corpus_stats(chunk_lengths: DataFrame, terms: DataFrame) -> CorpusStats:
    """Two one-row aggregates."""
    n, tokens = chunk_lengths.agg(
        F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long")
    ).first()
    return CorpusStats(n, tokens, *_vocabulary(terms, n), tuple(_head(chunk_lengths, HEAD_CHUNKS)))


def _vocabulary(terms: DataFrame, chunk_count: int) -> tuple[int, float]:
    """Size and mean idf. Terms with equal df share an idf: the shuffle carries a histogram, not a vocabulary."""
    by_df = terms.groupBy("df").agg(F.count("*").alias("n"))
    size, idf_sum = by_df.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.coalesce(F.sum(raw_idf(F.col("df"), F.lit(float(chunk_count))) * F.col("n")), F.lit(0.0)),
    ).first()
    return size, idf_sum / size if size else 0.0


def corpus_terms(chunks: DataFrame) -> tuple[DataFrame, CorpusStats]:
    """terms(term, df) and the scalars of ``chunks(text)`` in one reading, for who needs no postings; no head.

    A batch counts its terms before Spark sees them; a row without a term stands for its chunks and their length.
    """
    rows = chunks.select(F.lower("text").alias("lowered")).mapInArrow(_terms_of_batches, "term STRING, df BIGINT, dl BIGINT")
    counted = write_and_reread(rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")), "terms")
    totals = counted.where("term is null").first()
    n, length = (totals["df"], totals["dl"]) if totals else (0, 0)
    terms = counted.where("term is not null").select("term", "df")
    return terms, CorpusStats(n, length, *_vocabulary(terms, n))


def _terms_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks per term of each batch, and without a term its chunks and tokens."""
    names = ["term", "df", "dl"]
    for batch in batches:
        length, coded = coded_words(batch.column("lowered"))
        totals = [pa.array([None], pa.string()), pa.array([len(length)], pa.int64()), pa.array([length.sum()], pa.int64())]
        yield pa.RecordBatch.from_arrays(totals, names)
        if not len(coded):
            continue
        # Sorting is much cheaper here than numpy's unique.
        key = np.sort(coded.indices.to_numpy().astype(np.int64) * len(length) + np.repeat(np.arange(len(length)), length))
        df = np.bincount(key[np.r_[True, key[1:] != key[:-1]]] // len(length), minlength=len(coded.dictionary))
        made = pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df), pa.array(np.zeros_like(df))], names)
        for at in range(0, made.num_rows, BATCH_BLOCKS):
            yield made.slice(at, BATCH_BLOCKS)


def _coded(lists: pa.ListArray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Lengths of the lists, and all their tokens as numbers of distinct ones."""
    length = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    return length, lists.flatten().dictionary_encode()


def coded_words(lowered: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """``_coded`` of ``tokenize``, for texts that Spark has lower-cased: Arrow splits at the same characters."""
    length, coded = _coded(pc.utf8_split_whitespace(lowered))
    blank = pc.index_in(pa.scalar("", coded.type.value_type), value_set=coded.dictionary).as_py()
    if blank is None:
        return length, coded
    # Only a blank edge makes an empty piece.
    codes = coded.indices.to_numpy()
    empty = codes == blank
    length = length - np.bincount(np.repeat(np.arange(len(length)), length)[empty], minlength=len(length))
    return length, pa.DictionaryArray.from_arrays(pa.array(codes[~empty] - (codes[~empty] > blank)), pa.concat_arrays(
        [coded.dictionary[:blank], coded.dictionary[blank + 1:]]))


def _head(chunk_lengths: DataFrame, n: int) -> list[int]:
    rows = chunk_lengths.select("position").orderBy("position").limit(n).collect()
    return [r["position"] for r in rows]


# ---------------------------------------------------------------- queries

def query_terms(queries: DataFrame, text: str = "question") -> DataFrame:
    """(query_id, term, term_no, places, query_frequency); blank queries have no rows."""
    return (
        queries.select("query_id", F.posexplode(tokenize(F.col(text))).alias("pos", "term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").cast("int").alias("query_frequency"), F.min("pos").alias("term_no"),
             F.sort_array(F.collect_list("pos")).alias("places"))
    )


def weighted_terms(index: LexicalIndex, terms: DataFrame, small: bool = True) -> DataFrame:
    """Query terms with df and idf; terms outside the vocabulary get zeros."""
    asked = terms.select("term").distinct()
    found = index.terms.join(F.broadcast(asked) if small else asked, "term", "left_semi")
    return terms.join(found, "term", "left").select(
        "query_id", "term", "term_no", "places", "query_frequency",
        F.coalesce("df", F.lit(0)).alias("df"),
        F.coalesce(floored_idf(F.col("df"), index.stats), F.lit(0.0)).alias("idf"),
    )


def contribution(idf: Column, tf: Column, dl: Column, stats: CorpusStats, k1=K1, b=B) -> Column:
    """Score of one occurrence of a query term in one chunk."""
    norm = k1 * (1.0 - b + b * dl / F.lit(stats.average_length or 1.0))
    return idf * (tf * (k1 + 1.0) / (tf + norm))


def _met(index: LexicalIndex, terms: DataFrame, small: bool, *columns: str) -> DataFrame:
    """Block columns beside the query terms that ask for them; only their folders are read."""
    blocks = index.blocks.select("shard", "term", "cell", *columns)
    asked = terms.where("df > 0").select(
        "query_id", "term", "query_frequency", "idf", shard_of(F.col("term"), index.shards).alias("shard"))
    if small:
        return blocks.join(F.broadcast(asked), ["shard", "term"])
    # A frequent term meets its many queries in SLICES places.
    part = F.pmod("cell", F.lit(SLICES)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("part")
    return blocks.withColumn("part", part).join(asked.select("*", parts), ["shard", "term", "part"])


def _bounds(index: LexicalIndex, terms: DataFrame, small: bool) -> DataFrame:
    """(query_id, cell, bound): no chunk of the cell scores more; reads headers only."""
    bound = F.col("query_frequency") * contribution(F.col("idf"), F.col("max_tf"), F.col("min_dl"), index.stats)
    return _met(index, terms, small, "max_tf", "min_dl").groupBy("query_id", "cell").agg(F.sum(bound).alias("bound"))


def _scores(blocks: DataFrame, wanted: DataFrame, stats: CorpusStats) -> DataFrame:
    """(query_id, position, score) of ``wanted(query_id, cell, shard, term, places, idf)``.

    Parts are added in the order of the question's tokens, a repeated one each time. With
    a column ``candidates`` only the positions in it are scored.
    """
    found = blocks.select("shard", "term", "cell", F.col("entries").alias("found"))
    parts = found.join(broadcast_if_small(wanted, WANTED_ROWS), ["shard", "term", "cell"])
    if "candidates" in wanted.columns:
        parts = parts.withColumn("found", F.filter("found", lambda e: F.array_contains("candidates", e["position"])))
    part = contribution(F.col("idf"), F.col("e.tf"), F.col("e.dl"), stats).alias("part")
    rows = parts.select("query_id", "places", "idf", F.explode("found").alias("e")).select(
        "query_id", F.col("e.position").alias("position"), "places", part)
    in_order = F.sort_array(F.flatten(F.collect_list(
        F.transform("places", lambda p: F.struct(p.alias("place"), F.col("part").alias("part"))))))
    return rows.groupBy("query_id", "position").agg(in_order.alias("parts")).select(
        "query_id", "position", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"]).alias("score"))


def _wanted(cells: DataFrame, terms: DataFrame, shards: int) -> DataFrame:
    return cells.join(terms.where("df > 0"), "query_id").select(
        *cells.columns, shard_of(F.col("term"), shards).alias("shard"), "term", "places", "idf")


def _sums(index: LexicalIndex, terms: DataFrame, top_k: int, small: bool) -> DataFrame:
    """(query_id, position, part): added-up scores of every chunk that can be among a query's top k."""
    cells = write_and_reread(_bounds(index, terms, small), "cells")
    best = W.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
    seeds = write_and_reread(
        cells.withColumn("no", F.row_number().over(best)).where(F.col("no") <= max(SEED_CELLS, top_k))
        .select("query_id", "cell"), "seeds")
    first = write_and_reread(_partial_sums(index, terms, seeds, small), "sums")
    # Ties with the threshold may stand in front of it, so equal bounds stay.
    reach = F.col("threshold").isNull() | (F.col("bound") * (1 + SLACK) >= F.col("threshold"))
    open_cells = (
        cells.join(_thresholds(first, top_k), "query_id", "left").where(reach)
        .join(seeds, ["query_id", "cell"], "left_anti").select("query_id", "cell")
    )
    return first.unionByName(_partial_sums(index, terms, write_and_reread(open_cells, "open"), small))


def _thresholds(sums: DataFrame, k: int) -> DataFrame:
    """(query_id, threshold): the k-th best sum, where there are as many positive ones."""
    order = W.partitionBy("query_id").orderBy(F.desc("part"))
    kth = sums.withColumn("no", F.row_number().over(order)).where((F.col("no") == k) & (F.col("part") > 0))
    return kth.select("query_id", F.col("part").alias("threshold"))


def _pruned_scores(index: LexicalIndex, terms: DataFrame, top_k: int, small: bool) -> DataFrame:
    """Exact scores of the chunks whose sums reach a query's k-th best."""
    sums = write_and_reread(_sums(index, terms, top_k, small), "sums")
    reach = F.col("threshold").isNull() | (F.col("part") * (1 + SLACK) >= F.col("threshold"))
    chunks = (
        sums.join(write_and_reread(_thresholds(sums, top_k), "thresholds"), "query_id", "left").where(reach)
        .groupBy("query_id", cell_of(F.col("position")).alias("cell")).agg(F.collect_list("position").alias("candidates"))
    )
    return _scores(index.blocks, _wanted(write_and_reread(chunks, "candidates"), terms, index.shards), index.stats)


def _partial_sums(index: LexicalIndex, terms: DataFrame, cells: DataFrame, small: bool) -> DataFrame:
    """(query_id, position, part): what the query terms add up to in chunks of ``cells``, in any order."""
    part = F.col("query_frequency") * contribution(F.col("idf"), F.col("e.tf"), F.col("e.dl"), index.stats)
    met = _met(index, terms, small, "entries").join(broadcast_if_small(cells), ["query_id", "cell"])
    return (met.select("query_id", "idf", "query_frequency", F.explode("entries").alias("e"))
            .groupBy("query_id", F.col("e.position").alias("position")).agg(F.sum(part).alias("part")))


def _top(scores: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "position")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "position", "score", "rank")


def _first_chunks(index: LexicalIndex, n: int) -> Column:
    """Positions of the first ``n`` chunks of the corpus as one array literal."""
    enough = n <= len(index.stats.head) or len(index.stats.head) == index.stats.chunk_count
    head = index.stats.head if enough else _head(index.chunks, n)
    return F.from_json(F.lit(json.dumps(list(head[:max(n, 0)]))), "array<bigint>")


def bm25_top_k(
    index: LexicalIndex, queries: DataFrame, top_k: int = 5, text: str = "question"
) -> DataFrame:
    """(query_id, position, score, rank) for all queries at once; see ``with_ids``.

    Chunks without any query term score zero and still take the ranks that no
    positive score claims. With p < k positive scores, the k zero scores that come
    first are among the first k + p chunks, so 2k - 1 candidates are always enough.
    Only where the idf floor is negative can a zero beat a match; then every chunk
    competes with a zero posting of its own.
    """
    if top_k < 0:
        raise ValueError(f"top_k must be non-negative, got {top_k}")
    asked = queries.where(has_text(F.col(text)))
    if index.stats.is_empty or top_k == 0:
        asked = asked.limit(0)
    # Scoring groups by two longs; the caller's ids come back with the few ranked rows.
    numbered = write_and_reread(asked.select(
        F.monotonically_increasing_id().alias("query_no"), "query_id",
        F.col(text).alias("question"),
    ), "questions")
    ranked = _ranked(
        index, numbered.select(F.col("query_no").alias("query_id"), "question"), top_k
    )
    names = numbered.select("query_no", F.col("query_id").alias("name"))
    return ranked.join(names, F.col("query_id") == F.col("query_no")).select(
        F.col("name").alias("query_id"), "position", "score", "rank"
    )


def _ranked(index: LexicalIndex, asked: DataFrame, top_k: int) -> DataFrame:
    raw = query_terms(asked)
    small = row_count_within(raw, BROADCAST_ROW_LIMIT)
    terms = write_and_reread(weighted_terms(index, raw, small), "terms")
    if _scans(index, terms):
        return _top(_scanned(index, terms, top_k), top_k)
    if index.stats.mean_idf < 0:
        return _top(_all_scores(index, asked, terms), top_k)
    best = _top(_pruned_scores(index, terms, top_k, small), top_k)
    zeros = asked.select(
        "query_id", F.explode(_first_chunks(index, 2 * top_k - 1)).alias("position"),
        F.lit(0.0).alias("score"),
    )
    both = (
        best.drop("rank").unionByName(zeros)
        .groupBy("query_id", "position").agg(F.sum("score").alias("score"))
    )
    return _top(both, top_k)


def _scans(index: LexicalIndex, terms: DataFrame) -> bool:
    """True where reading all texts once beats meeting every posting that is asked for."""
    if index.texts is None or index.blocks is None:
        return index.blocks is None
    asked = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    return asked * SCAN_SHARE > index.stats.token_count


def _scanned(index: LexicalIndex, terms: DataFrame, top_k: int) -> DataFrame:
    """(query_id, position, score): each task's best chunks of every question, scores as in ``_scores``.

    Every chunk competes, one without a question's words at zero, so nothing has to be filled in.
    """
    average, schema = index.stats.average_length or 1.0, "query_id BIGINT, position BIGINT, score DOUBLE"
    chunks = index.texts.select("position", F.lower("text").alias("lowered"))
    asked = terms.select("query_id", "term", "places", "idf")
    if row_count_within(asked, SCAN_TERMS):
        shipped = terms.sparkSession.sparkContext.broadcast(asked.toArrow())

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = BestChunks(shipped.value, average, top_k)
            for batch in batches:
                best.add(batch.column("position").to_numpy(), batch.column("lowered"))
            yield from best.rows().to_batches()

        return chunks.mapInArrow(score, schema)

    def score_pair(found: pa.Table, questions: pa.Table) -> pa.Table:
        best = BestChunks(questions, average, top_k)
        for batch in found.to_batches():
            best.add(batch.column("position").to_numpy(), batch.column("lowered"))
        return best.rows()

    # Every (tile of questions, shard of chunks) pair is one group of bounded size.
    tiles, shards = -(-asked.count() * 2 // SCAN_TERMS), max(1, -(-index.stats.chunk_count // SCAN_SHARD))

    def dealt(rows: DataFrame, key: str, by: str, n: int, other: str, of: int) -> DataFrame:
        return rows.select("*", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(by),
                           F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(other)).groupBy("tile", "shard")

    left = dealt(chunks, "position", "shard", shards, "tile", tiles)
    return left.cogroup(dealt(asked, "query_id", "tile", tiles, "shard", shards)).applyInArrow(score_pair, schema)


class BestChunks:
    """Each question's k best chunks of those added, by score and then position."""

    def __init__(self, asked: pa.Table, average: float, top_k: int) -> None:
        """``asked``: query_id, term, places, idf of every question's terms."""
        self.average, self.top_k = average, top_k
        self.names, query = np.unique(asked.column("query_id").to_numpy(), return_inverse=True)
        coded = asked.column("term").combine_chunks().dictionary_encode()
        self.terms, number = coded.dictionary, coded.indices.to_numpy()
        self.idf = np.zeros(len(self.terms))
        self.idf[number] = asked.column("idf").to_numpy()
        places = asked.column("places").combine_chunks()
        times = places.value_lengths().to_numpy()
        order = np.lexsort((places.flatten().to_numpy(), np.repeat(query, times)))
        self.tokens, self.owners = np.repeat(number, times)[order], np.repeat(query, times)[order]
        self.scores = np.full((len(self.names), top_k), -np.inf)
        self.positions = np.full((len(self.names), top_k), np.iinfo(np.int64).max)

    def add(self, position: np.ndarray, lowered: pa.Array) -> None:
        if not len(self.names) or not len(position):
            return
        length, coded = coded_words(lowered)
        found = pc.index_in(coded.dictionary, value_set=self.terms).fill_null(-1).to_numpy()
        number = found[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
        ends = np.r_[0, np.cumsum(length)]
        run = int(min(SCAN_RUN, max(16, SCAN_BYTES // (8 * max(1, (found >= 0).sum())))))
        for a in range(0, len(position), run):
            b = min(a + run, len(position))
            self._keep(self._score(number[ends[a]:ends[b]], length[a:b]), position[a:b])

    def _score(self, number: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Scores of every question (rows) in a run of chunks; parts added in the order of the question's tokens."""
        n, asked = len(length), number >= 0
        number, row = number[asked], np.repeat(np.arange(n), length)[asked]
        present = np.zeros(len(self.terms), bool)
        present[number] = True
        place = np.cumsum(present) - 1
        tf = np.bincount(place[number] * n + row, minlength=int(present.sum()) * n).reshape(-1, n)
        norm = K1 * (1.0 - B + B * length / self.average)
        part = self.idf[present][:, None] * (tf * (K1 + 1.0) / (tf + norm))
        scores = np.zeros((len(self.names), n))
        here = present[self.tokens]
        for owner, at in zip(self.owners[here].tolist(), place[self.tokens[here]].tolist(), strict=True):
            np.add(scores[owner], part[at], out=scores[owner])
        return scores

    def _keep(self, scores: np.ndarray, position: np.ndarray) -> None:
        worst, last = self.scores[:, -1:], self.positions[:, -1:]
        better = (scores > worst) | ((scores == worst) & (position < last))
        for q in np.flatnonzero(better.any(axis=1)):
            s = np.r_[self.scores[q], scores[q, better[q]]]
            p = np.r_[self.positions[q], position[better[q]]]
            first = np.lexsort((p, -s))[:self.top_k]
            self.scores[q], self.positions[q] = s[first], p[first]

    def rows(self) -> pa.Table:
        q, place = np.nonzero(np.isfinite(self.scores))
        return pa.table({"query_id": pa.array(self.names[q], pa.int64()), "position": pa.array(self.positions[q, place]),
                         "score": pa.array(self.scores[q, place])})


def with_ids(index: LexicalIndex, ranked: DataFrame, result_limit: int) -> DataFrame:
    """Attach chunk_id, doc_id and char_start to a ranking of at most that many rows."""
    ids = index.chunks.select("position", "chunk_id", "doc_id", "char_start")
    return ids.join(
        F.broadcast(ranked) if result_limit <= BROADCAST_ROW_LIMIT else ranked, "position"
    )


def _all_scores(index: LexicalIndex, asked: DataFrame, terms: DataFrame) -> DataFrame:
    """Scores of all chunks, where a match can be worth less than none."""
    blank = F.lit("")
    lengths = index.chunks.groupBy(cell_of(F.col("position")).alias("cell")).agg(
        F.collect_list(F.struct("position", "dl", F.lit(0).alias("tf"))).alias("entries"))
    everywhere = lengths.select(shard_of(blank, index.shards).alias("shard"), blank.alias("term"), "cell", "entries")
    blocks = index.blocks.select("shard", "term", "cell", "entries").unionByName(everywhere)
    nothing = asked.select("query_id", blank.alias("term"), F.array(F.lit(0)).alias("places"), F.lit(0.0).alias("idf"))
    matching = terms.where("df > 0").select("query_id", "term", "places", "idf").unionByName(nothing)
    cells = blocks.select("shard", "term", "cell").distinct().join(matching, "term")
    return _scores(blocks, cells, index.stats)


def bm25_explain(
    index: LexicalIndex, queries: DataFrame, results: DataFrame, text: str = "question"
) -> DataFrame:
    """Per result: chunk length and, per distinct query term, every factor of its score.

    Results ask for the blocks of their query's terms in their own cell. A result whose
    query or chunk is unknown is an error.
    """
    raw = query_terms(queries, text)
    terms = write_and_reread(weighted_terms(index, raw, row_count_within(raw, BROADCAST_ROW_LIMIT)), "terms")
    per_query = terms.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("term_no", "term", "query_frequency", "df", "idf")))
        .alias("query_terms")
    )
    ranked = write_and_reread(results.select("query_id", "position", "rank", "score"), "ranked")
    positions = broadcast_if_small(ranked.select("position").distinct())
    found = (
        ranked.join(_lengths_and_hits(index, positions), "position", "left") if index.blocks is None else
        ranked.join(index.chunks.join(positions, "position", "left_semi").select("position", F.col("dl").alias("document_length")),
                    "position", "left").join(_hits(index, ranked, terms), ["query_id", "position"], "left")
    )
    found = (
        found.join(per_query, "query_id", "left")
        .withColumn("document_length", known(F.col("document_length"), "chunk position", F.col("position")))
        .withColumn("query_terms", known(F.col("query_terms"), "query", F.col("query_id")))
        .withColumn("hits", F.coalesce("hits", F.from_json(F.lit("{}"), "map<string,int>")))
    )

    def explained(q: Column) -> Column:
        tf = F.coalesce(F.try_element_at(F.col("hits"), q["term"]), F.lit(0))
        one = F.when(
            tf > 0, contribution(q["idf"], tf, F.col("document_length"), index.stats)
        ).otherwise(F.lit(0.0))
        return F.struct(
            q["term"].alias("term"), q["query_frequency"].alias("query_frequency"),
            tf.alias("term_frequency"), q["df"].alias("document_frequency"),
            q["idf"].alias("inverse_document_frequency"),
            (one * q["query_frequency"]).alias("contribution"),
        )

    return found.select(
        "query_id", "position", "rank", "score", "document_length",
        F.lit(index.stats.average_length).alias("average_document_length"),
        F.lit(index.stats.chunk_count).alias("corpus_size"),
        F.lit(K1).alias("k1"), F.lit(B).alias("b"),
        F.transform("query_terms", explained).alias("terms"),
    )


def _hits(index: LexicalIndex, ranked: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, position, hits) by the blocks of the queries' terms; hits maps terms to frequencies."""
    wanted = ranked.select("query_id", "position", cell_of(F.col("position")).alias("cell")).join(
        terms.where("df > 0").select("query_id", "term", shard_of(F.col("term"), index.shards).alias("shard")), "query_id")
    entry = F.get(F.filter("entries", lambda e: e["position"] == F.col("position")), F.lit(0))
    return (
        index.blocks.select("shard", "term", "cell", "entries")
        .join(broadcast_if_small(wanted, WANTED_ROWS), ["shard", "term", "cell"])
        .select("query_id", "position", "term", entry["tf"].alias("tf")).where("tf is not null")
        .groupBy("query_id", "position").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("hits"))
    )


def _lengths_and_hits(index: LexicalIndex, positions: DataFrame) -> DataFrame:
    """(position, document_length, hits) counted in the texts at ``positions``, stored."""
    tokens = F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>"))
    texts = write_and_reread(index.texts.join(positions, "position", "left_semi").select("position", tokens.alias("tokens")), "texts")
    return texts.select("position", F.size("tokens").alias("document_length"),
                        F.map_from_entries(term_frequencies(F.col("tokens"))).alias("hits"))
