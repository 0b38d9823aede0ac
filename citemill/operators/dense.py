"""Dense retrieval: a pluggable embedder, a content-addressed cache and exact top-k."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions.text import embedding_key, terms
from citemill.sources.store import stored

#: Queries whose vectors go to the executors at once: 4,096 of 1,024 dimensions are 32 MB.
QUERY_BLOCK = 4096
HASHED_DIM = 64


@lru_cache(maxsize=500_000)
def _bucket(term: str) -> tuple[int, float]:
    h = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
    return h % HASHED_DIM, 1.0 if h // HASHED_DIM % 2 else -1.0


def hashed_vector(found: list[str]) -> np.ndarray:
    """The default embedder: signed feature hashing of terms, not normalised."""
    v = np.zeros(HASHED_DIM)
    for term in found:
        i, sign = _bucket(term)
        v[i] += sign
    return v


def embed(texts: DataFrame, encode: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """texts(id, text) -> (id, vector). ``encode`` maps texts to rows of floats; without it terms are hashed."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "vector": [hashed_vector(list(t)) for t in pdf["terms"]]})

    def by_model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "vector": list(encode(pdf["text"].fillna("").tolist()))})

    kind = dict(texts.dtypes)["id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    if encode:
        return texts.select("id", text.alias("text")).mapInPandas(by_model, f"id {kind}, vector array<double>")
    return texts.select("id", terms(text).alias("terms")).mapInPandas(hashed, f"id {kind}, vector array<double>")


def embed_counts(counts: DataFrame) -> DataFrame:
    """``embed``'s default vectors from ``bm25.term_counts``, for texts that have a term: in the JVM, and from one tokenising for both indexes."""
    h = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("bigint")
    sign = F.when(F.floor(h / HASHED_DIM) % 2 == 1, F.col("tf")).otherwise(-F.col("tf"))
    buckets = counts.select("id", (h % HASHED_DIM).cast("int").alias("bucket"), sign.alias("v")).groupBy("id", "bucket").agg(F.sum("v").cast("double").alias("v"))
    held = F.map_from_entries(F.collect_list(F.struct("bucket", "v")))
    vector = F.transform(F.sequence(F.lit(0), F.lit(HASHED_DIM - 1)), lambda b: F.coalesce(F.element_at("held", b), F.lit(0.0)))
    return buckets.groupBy("id").agg(held.alias("held")).select("id", vector.alias("vector"))


def keyed(texts: DataFrame, model: str) -> DataFrame:
    """texts(text, ...) with the cache's key: model and text decide it."""
    return texts.withColumn("key", embedding_key(model, F.col("text")))


def missing(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """The rows of texts(text, ...) that cache(key, ...) lacks, with their key."""
    return keyed(texts, model).join(cache.select("key"), "key", "left_anti")


def embed_missing(texts: DataFrame, cache: DataFrame, model: str, encode=None) -> DataFrame:
    """The rows to append to ``cache(key, vector)``: one for each distinct text it lacks."""
    fresh = missing(texts, cache, model).dropDuplicates(["key"]).select(F.col("key").alias("id"), "text")
    return embed(fresh, encode).withColumnRenamed("id", "key")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """queries(qid, vector), vectors(id, vector) -> (qid, rank, id, score): exact cosine, best first, then id.

    Queries are a stated set, not a corpus: they pass through the driver and go to the executors block
    by block, a block's results being written before the next is read; each batch of vectors keeps its own
    best k for a query (and those that tie with its k-th), and a ranked limit merges them. Null,
    empty and zero vectors have no cosine and never appear.
    """
    kinds = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["id"]
    schema = f"qid {kinds[0]}, id {kinds[1]}, score double"
    own = vectors.where("vector is not null").select("id", "vector")
    found, block = None, []

    def scored() -> DataFrame | None:
        part = [(q, v / np.linalg.norm(v)) for q, v in block if len(v) and np.isfinite(v).all() and np.linalg.norm(v) > 0]
        return own.mapInPandas(_scorer(part, k + exclude_self), schema) if part else None

    for row in queries.where("vector is not null").select("qid", "vector").toLocalIterator():
        if len(block) == QUERY_BLOCK:  # a block's results are written, so that the driver holds one block
            done = scored()
            if done is not None:
                found = stored(done, "nearest") if found is None else found.union(stored(done, "nearest"))
            block = []
        block.append((row.qid, np.array(row.vector, float)))
    last = scored()
    if last is not None:
        found = last if found is None else found.union(last)
    if found is None:
        return queries.sparkSession.createDataFrame([], f"qid {kinds[0]}, rank int, id {kinds[1]}, score double")
    if exclude_self:
        found = found.where("qid <> id")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def _scorer(queries: list[tuple], k: int) -> Callable:
    """Vectors are scored by the queries of their own length; others have no product with them."""
    sizes: dict[int, list[tuple]] = {}
    for q, v in queries:
        sizes.setdefault(len(v), []).append((q, v))
    sets = {n: (np.array([q for q, _ in some], dtype=object), np.stack([v for _, v in some])) for n, some in sizes.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: dict[int, list] = {}
            for i, v in enumerate(pdf["vector"]):
                v = np.asarray(v, float)
                if len(v) in sets and np.isfinite(v).all() and v.any():
                    rows.setdefault(len(v), []).append((i, v))
            for n, some in rows.items():
                qids, matrix = sets[n]
                x, ids = np.stack([v for _, v in some]), pdf["id"].to_numpy()[[i for i, _ in some]]
                scores = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ matrix.T, 6)
                at_least = np.partition(scores, max(len(x) - k, 0), axis=0)[max(len(x) - k, 0)]
                found, cols = np.nonzero(scores >= at_least)
                yield pd.DataFrame({"qid": qids[cols], "id": ids[found], "score": scores[found, cols]})

    return run
