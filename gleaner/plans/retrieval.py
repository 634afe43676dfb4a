"""Retrieval for many questions at once, each with its own configuration."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.dense import dense_top_k
from gleaner.operators.fusion import reciprocal_rank_fusion, source_components
from gleaner.operators.lexical import bm25_top_k
from gleaner.operators.rerank import apply_rerank
from gleaner.session import BROADCAST_ROW_LIMIT, write_and_reread

RETRIEVERS = ("bm25", "dense", "hybrid")
# Up to this many results, chunks are looked up by a filter instead of a join.
LOOKUP_LIMIT = 1000
SCORE_SEMANTICS = {
    "bm25": "bm25_score", "dense": "cosine_similarity[-1,1]",
    "hybrid": "reciprocal_rank_fusion", "cross-encoder": "cross_encoder_relevance",
}


@dataclass(frozen=True)
class RetrievalConfig:
    retriever: str = "dense"
    top_k: int = 5
    reranker: str = "none"
    rerank_top_n: int | None = None

    def validate(self) -> RetrievalConfig:
        """Checks that hold for every run; raised before any job starts."""
        if self.retriever not in RETRIEVERS:
            raise ValueError(
                f"retriever must be one of {sorted(RETRIEVERS)}, got {self.retriever!r}"
            )
        if self.top_k < 0:
            raise ValueError(f"top_k must be >= 0, got {self.top_k}")
        if self.reranker != "none":
            if self.rerank_top_n is None:
                raise ValueError("rerank_top_n must be set when reranker is provided")
            if self.rerank_top_n < self.top_k:
                raise ValueError(
                    f"rerank_top_n ({self.rerank_top_n}) must be >= top_k ({self.top_k})"
                )
        return self

    def validate_ranges(self) -> RetrievalConfig:
        """The narrower limits of interactive comparisons."""
        if not 1 <= self.top_k <= 20:
            raise ValueError("top_k must be between 1 and 20")
        if self.rerank_top_n is not None and not 1 <= self.rerank_top_n <= 50:
            raise ValueError("rerank_top_n must be between 1 and 50")
        if self.reranker != "none" and (self.rerank_top_n or 0) < self.top_k:
            raise ValueError("rerank_top_n must be greater than or equal to top_k")
        return self

    @property
    def identity(self) -> tuple:
        """What the run depends on: the depth counts only where a reranker reads it."""
        depth = self.rerank_top_n if self.reranker != "none" else None
        return (self.retriever, self.top_k, self.reranker, depth)

    def as_columns(self) -> list[Column]:
        kinds = {"retriever": "string", "top_k": "int", "reranker": "string", "rerank_top_n": "int"}
        return [F.lit(v).cast(kinds[k]).alias(k) for k, v in asdict(self).items()]


def ask(questions: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Give every question the same configuration."""
    config.validate()
    return questions.select(*questions.columns, *config.as_columns())


def _depth() -> Column:
    reranked = (F.col("reranker") != "none") & F.col("rerank_top_n").isNotNull()
    return F.when(reranked, F.col("rerank_top_n")).otherwise(F.col("top_k"))


@dataclass(frozen=True)
class AskSummary:
    """What has to be known about a set of asks before it is planned."""

    depths: dict[str, int]
    count: int
    reranked: int

    @property
    def result_limit(self) -> int:
        """No more results than this can come out."""
        return self.count * max(self.depths.values(), default=0)


def summarize(asks: DataFrame, embedder, reranker) -> AskSummary:
    """One small job that refuses runs some configuration makes impossible."""
    active = F.col("reranker") != "none"
    # At most three rows, or the run is refused.
    rows = asks.groupBy("retriever").agg(
        F.max(_depth()).alias("depth"), F.count("*").alias("n"), F.count_if(active).alias("again"),
        F.min(F.when(active & (F.col("rerank_top_n") < F.col("top_k")), F.col("query_id")))
        .alias("shallow"),
    ).limit(len(RETRIEVERS) + 1).collect()
    depths = {r["retriever"]: r["depth"] for r in rows}
    unknown = set(depths) - set(RETRIEVERS)
    if unknown:
        raise ValueError(f"retriever must be one of {sorted(RETRIEVERS)}, got {sorted(unknown)}")
    if embedder is None and set(depths) & {"dense", "hybrid"}:
        raise ValueError("embedder must not be None when dense or hybrid retrieval is asked for")
    reranked = sum(r["again"] for r in rows)
    if reranked and reranker is None:
        raise ValueError("reranker must not be None when any case uses a non-none reranker")
    for r in rows:
        if r["shallow"] is not None:
            raise ValueError(f"{r['shallow']}: rerank_top_n must be >= top_k")
    return AskSummary(depths, sum(r["n"] for r in rows), reranked)


def base_ranking(
    index, asks: DataFrame, embedder=None, summary: AskSummary | None = None, explain: bool = False
) -> DataFrame:
    """(query_id, position, score, rank) at each ask's own depth, before reranking.

    With ``explain`` also ``score_components``: what each retriever gave the chunk, taken
    along from the lists that are ranked anyway.

    Each retriever ranks its distinct questions in one job, at the greatest depth asked
    for; every ask of a question then keeps its own prefix of the list.
    """
    modes = (summary or summarize(asks, embedder, reranker=True)).depths
    asks = asks.select(
        "query_id", "question", "retriever", _depth().alias("depth"),
        F.sha2("question", 256).alias("question_key"),
    )

    def distinct(sub: DataFrame) -> DataFrame:
        return sub.select(F.col("question_key").alias("query_id"), "question").distinct()

    def lexical(sub: DataFrame, k: int) -> DataFrame:
        return bm25_top_k(index.lexical, distinct(sub), k)

    def dense(sub: DataFrame, k: int) -> DataFrame:
        queries = distinct(sub).select(
            "query_id", embedder.vector(F.col("question")).alias("vector")
        )
        return dense_top_k(index.vectors, queries, k, order_by=("position",))

    def fan_out(ranked: DataFrame, sub: DataFrame) -> DataFrame:
        found = ranked.select(
            F.col("query_id").alias("question_key"), "position", "score", "rank"
        )
        return (
            found.join(sub.select("question_key", "query_id", "depth"), "question_key")
            .where(F.col("rank") <= F.col("depth"))
            .select("query_id", "position", "score", "rank")
        )

    def with_components(found: DataFrame, components: Column) -> DataFrame:
        return found.withColumn("score_components", components) if explain else found

    def own_components(name: str) -> Column:
        return F.create_map(
            F.lit(f"{name}_score"), F.col("score"), F.lit(f"{name}_rank"), F.col("rank").cast("double")
        )

    ranked = []
    for mode, k in modes.items():
        sub = asks.where(F.col("retriever") == mode)
        if mode == "bm25":
            ranked.append(with_components(fan_out(lexical(sub, k), sub), own_components("bm25")))
        elif mode == "dense":
            ranked.append(with_components(fan_out(dense(sub, k), sub), own_components("dense")))
        else:
            # How far a list reaches changes what is fused, so lists are cut before.
            lists = [fan_out(dense(sub, k), sub), fan_out(lexical(sub, k), sub)]
            fused = with_components(reciprocal_rank_fusion(
                lists, k, source_names=["dense", "bm25"], key="position"
            ), source_components()).drop("sources")
            ranked.append(
                fused.join(sub.select("query_id", "depth"), "query_id")
                .where(F.col("rank") <= F.col("depth")).drop("depth")
            )
    if not ranked:
        return index.chunks.sparkSession.createDataFrame(
            [], "query_id string, position long, score double, rank int"
            + (", score_components map<string,double>" if explain else "")
        )
    return reduce(DataFrame.unionByName, ranked)


def with_chunks(index, ranked: DataFrame, result_limit: int) -> DataFrame:
    """Attach text and metadata to a stored ranking.

    A few positions become a filter on the chunk table, which is kept in their order;
    more are joined, broadcast while their number is within bounds.
    """
    payload = index.chunks.select(
        "position", "chunk_id", "doc_id", "text", F.coalesce("metadata.title", F.lit("")).alias("title"),
        F.coalesce("metadata.path", "doc_id").alias("path"),
    )
    if result_limit <= LOOKUP_LIMIT:
        wanted = [r["position"] for r in ranked.select("position").distinct().collect()]
        payload = payload.where(F.col("position").isin(wanted))
    return payload.join(
        F.broadcast(ranked) if result_limit <= BROADCAST_ROW_LIMIT else ranked, "position"
    )


def score_semantics(retriever: Column, reranker: Column) -> Column:
    """What the final score of a result means."""
    names = F.create_map(*[F.lit(x) for pair in SCORE_SEMANTICS.items() for x in pair])
    second = F.coalesce(names[reranker], F.concat(reranker, F.lit("_score")))
    return F.when(reranker == "none", names[retriever]).otherwise(second)


def retrieve(index, asks: DataFrame, embedder=None, reranker=None, explain: bool = False) -> DataFrame:
    """Final results of every ask: (query_id, question, chunk_id, doc_id, text, title,
    path, score, rank, pre_rerank_rank, pre_rerank_score).

    ``asks`` has query_id, question, retriever, top_k, reranker, rerank_top_n. With ``explain``
    also ``score_components``, a map of every score and rank behind the final one, and
    ``score_semantics``; the components travel with the ranking, nothing is scored again.
    """
    summary = summarize(asks, embedder, reranker)
    # Stored once: the ranking is the costly part and feeds more than one branch.
    base = write_and_reread(base_ranking(index, asks, embedder, summary, explain), "ranking")
    meaning = [score_semantics(F.col("retriever"), F.col("reranker")).alias("score_semantics")] if explain else []
    settings = asks.select("query_id", "question", "reranker", "top_k", *meaning)
    found = with_chunks(index, base, summary.result_limit).join(
        F.broadcast(settings) if summary.result_limit <= BROADCAST_ROW_LIMIT else settings,
        "query_id",
    )
    plain = found.where(F.col("reranker") == "none").select(
        "*", F.lit(None).cast("int").alias("pre_rerank_rank"),
        F.lit(None).cast("double").alias("pre_rerank_score"),
    )
    if not summary.reranked:
        return plain.drop("reranker", "top_k")
    again = found.where(F.col("reranker") != "none")
    second = apply_rerank(again, reranker, max(summary.depths.values())).where(
        F.col("rank") <= F.col("top_k")
    )
    if explain:
        second = second.withColumn("score_components", F.map_concat("score_components", F.create_map(
            F.lit("reranker_score"), F.col("score").cast("double"),
            F.lit("pre_rerank_score"), F.col("pre_rerank_score"),
            F.lit("pre_rerank_rank"), F.col("pre_rerank_rank").cast("double"),
        )))
    return plain.unionByName(second).drop("reranker", "top_k")


def retrieved_docs(asks: DataFrame, results: DataFrame) -> DataFrame:
    """``asks`` with the document ids retrieved for each, in rank order."""
    lists = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("ranked")
    )
    docs = F.transform(F.col("ranked"), lambda r: r["doc_id"])
    return asks.join(lists, "query_id", "left").select(
        *asks.columns,
        F.coalesce(docs, F.array().cast("array<string>")).alias("retrieved_doc_ids"),
    )
