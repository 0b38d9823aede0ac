"""Rank fusion, candidate merging and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def close_up(rankings: DataFrame) -> DataFrame:
    """rankings(qid, list_id, rank, id): an id that a list repeats keeps its best place, and ranks close up."""
    best = rankings.groupBy("qid", "list_id", "id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("qid", "list_id").orderBy("rank")
    return best.withColumn("rank", F.row_number().over(order))


def reciprocal_rank_fusion(rankings: DataFrame, k: int = 60, weights: dict | None = None) -> DataFrame:
    """rankings(qid, list_id, rank, id) -> (qid, rank, id, score): score adds up weight / (k + rank).

    Ties go to the better single rank, then the smaller id.
    """
    if k < 0:
        raise ValueError("k must be non-negative")
    weight: Column = F.lit(1.0)
    if weights is not None:
        for list_id, w in weights.items():
            weight = F.when(F.col("list_id") == list_id, float(w)).otherwise(weight)
    # The least list first, so that sums don't depend on the order of rows.
    parts = F.sort_array(F.collect_list(F.struct("list_id", (weight / (k + F.col("rank"))).alias("part"))))
    fused = close_up(rankings).groupBy("qid", "id").agg(parts.alias("parts"), F.min("rank").alias("best"))
    fused = fused.withColumn("score", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"]))
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "best", "id")
    return fused.select("qid", F.row_number().over(order).alias("rank"), "id", "score")


def candidates(dense: DataFrame, lexical: DataFrame, n: int, k: int = 60) -> DataFrame:
    """Two rankings(qid, rank, id) -> the best n fused: qid, rank, id, score, dense_rank, bm25_rank (null where absent)."""
    lists = dense.select("qid", F.lit(0).alias("list_id"), "rank", "id").unionByName(lexical.select("qid", F.lit(1).alias("list_id"), "rank", "id"))
    fused = reciprocal_rank_fusion(lists, k).where(F.col("rank") <= n)
    ranks = dense.select("qid", "id", F.col("rank").alias("dense_rank")).join(lexical.select("qid", "id", F.col("rank").alias("bm25_rank")), ["qid", "id"], "full")
    return fused.join(ranks, ["qid", "id"]).select("qid", "rank", "id", "score", "dense_rank", "bm25_rank")


def rerank(found: DataFrame, score: Column, k: int) -> DataFrame:
    """found(qid, rank, ...) -> the best k by a new score; equal scores keep the order they had."""
    order = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), "rank")
    scored = found.withColumn("rerank_score", score)
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).drop("rank").withColumnRenamed("new_rank", "rank")


def overlap_score(query_terms: Column, text_terms: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of distinct query terms that the text has."""
    asked = F.array_distinct(query_terms)
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(asked, text_terms)).cast("double"), F.size(asked)), F.lit(0.0)), 6)


def model_score(reranker: Callable[[], Callable[[str, list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A cross-encoder as a column function of query and passage; passages of one query in a batch are scored together."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = reranker()
        for queries, passages in parts:
            out = pd.Series(0.0, index=queries.index)
            for query, rows in passages.fillna("").groupby(queries.fillna("")):
                out[rows.index] = [float(x) for x in model(query, rows.tolist())]
            yield out

    return score


def first_of_other_document(found: DataFrame, own_doc: Column, doc: Column) -> DataFrame:
    """The first hit of each query that is of another document."""
    return found.where(doc != own_doc).groupBy("qid").agg(F.min_by("id", "rank").alias("id"), F.min("rank").alias("rank"))
