"""Corpus to index: markup, chunks, vectors and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.functions.text import estimated_tokens
from citemill.operators import bm25, chunking, dense
from citemill.sources import sinks


def chunk_corpus(corpus: DataFrame, manifest: DataFrame, cfg: chunking.ChunkingConfig = chunking.ChunkingConfig(), count: chunking.Counter = chunking.count_words) -> DataFrame:
    """corpus(doc_id, text), manifest -> chunks of the documents both have."""
    text = chunking.normalize_markup(corpus.select(F.col("doc_id").alias("page_id"), F.col("text").alias("source"))).withColumnRenamed("page_id", "doc_id")
    slug = F.regexp_replace(F.regexp_replace("doc_id", r"\.mdx?$", ""), "/", "-")
    docs = text.join(manifest.select("doc_id", F.col("published_url").alias("url"), "source_url"), "doc_id").withColumn("slug", slug)
    return chunking.chunk_documents(docs, cfg, count)


def build_index(chunks: DataFrame, path: str, meta: dict, encode=None) -> None:
    """Vectors and postings over each chunk's path and text, written with what they were built from."""
    texts = chunks.select(F.col("chunk_id").alias("id"), chunking.embed_text(F.col("heading_path"), F.col("text")).alias("text"))
    sinks.write_index(path, chunks, dense.embed(texts, encode), bm25.build(texts).postings, meta)


def context_size(chunks: DataFrame) -> DataFrame:
    """(doc_id, tokens): an estimate of a document's tokens, for quotas."""
    return chunks.groupBy("doc_id").agg(F.sum(estimated_tokens(F.col("text"))).alias("tokens"))
