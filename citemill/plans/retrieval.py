"""Questions to ranked chunks: the modes dense, hybrid and hybrid_rerank as plans over an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.functions.text import terms
from citemill.operators import bm25, dense, fusion

MODES = ("dense", "hybrid", "hybrid_rerank")


def retrieve(
    questions: DataFrame, chunks: DataFrame, vectors: DataFrame, index: bm25.Index, mode: str = "hybrid_rerank",
    top_k: int = 5, candidates: int = 30, rerank_candidates: int = 20, rrf_k: int = 60, encode=None, query_prefix: str = "", reranker: Callable | None = None,
    bm25_candidates: int | None = None,
) -> DataFrame:
    """questions(qid, text), chunks(id, text), vectors(id, vector) -> (qid, rank, id, score, dense_rank, bm25_rank, rerank_score).

    ``candidates`` of the dense search and as many of the lexical one, or ``bm25_candidates``, are fused.
    ``reranker()`` makes, once in each worker, a function from (query, passages) to their scores;
    without it the share of a query's terms in the passage is the score.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    asked = dense.embed(questions.select(F.col("qid").alias("id"), F.concat(F.lit(query_prefix), F.col("text")).alias("text")), encode)
    near = dense.top_k(asked.select(F.col("id").alias("qid"), "vector"), vectors, top_k if mode == "dense" else candidates)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    if mode == "dense":
        return near.select("qid", "rank", "id", "score", F.col("rank").alias("dense_rank"), none("int", "bm25_rank"), none("double", "rerank_score"))
    words = bm25.search(questions, index, candidates if bm25_candidates is None else bm25_candidates)
    found = fusion.candidates(near, words, top_k if mode == "hybrid" else rerank_candidates, rrf_k)
    if mode == "hybrid":
        return found.withColumn("rerank_score", none("double", "rerank_score"))
    texts = found.join(chunks.select("id", F.col("text").alias("body")), "id").join(questions.select("qid", "text"), "qid")
    score = fusion.model_score(reranker)(F.col("text"), F.col("body")) if reranker else fusion.overlap_score(terms(F.col("text")), terms(F.col("body")))
    scored = fusion.rerank(texts, score, top_k)
    return scored.select("qid", "rank", "id", F.col("rerank_score").alias("score"), "dense_rank", "bm25_rank", "rerank_score")
