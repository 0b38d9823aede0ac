"""Chunk sizes tried out: probes against the chunks of each configuration, by dense retrieval alone."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.functions.text import match_text
from citemill.operators import chunking, dense, evidence, metrics
from citemill.sources.store import stored

#: Ranks at which hits are counted, tokens within which they are, and the rank to which a probe's evidence is looked for.
KS, BUDGETS, DEPTH = (1, 3, 5, 10), (1000, 2000), 50


def probe_ranks(probes: DataFrame, chunks: DataFrame, depth: int, encode=None) -> DataFrame:
    """probes(pid, question, evidence), chunks(chunk_id, heading_path, text, n_tokens) -> (pid, rank, chunk_id, n_tokens, is_hit): the ranking of each probe to ``depth``."""
    texts = chunks.select(F.col("chunk_id").alias("id"), chunking.embed_text(F.col("heading_path"), F.col("text")).alias("text"))
    asked = dense.embed(probes.select(F.col("pid").alias("id"), F.col("question").alias("text")), encode).withColumnRenamed("id", "qid")
    found = dense.top_k(asked, dense.embed(texts, encode), depth)
    bodies = chunks.select(F.col("chunk_id").alias("id"), "n_tokens", match_text(F.col("text")).alias("body"))
    wanted = probes.select(F.col("pid").alias("qid"), match_text(F.col("evidence")).alias("q"))
    return found.join(bodies, "id").join(wanted, "qid").select("qid", "rank", F.col("id").alias("chunk_id"), "n_tokens", F.contains("body", "q").alias("is_hit"))


def score(probes: DataFrame, chunks: DataFrame, encode=None) -> DataFrame:
    """One row: hit_1 to hit_10, mrr_10, hits within token budgets, n_chunks, median_tokens, top5_tokens, n_probes.

    Within a budget the whole ranking counts; as a chunk has a token at least, the rank that is the
    largest budget bounds it and loses nothing. top5_tokens are what a prompt pays for a question.
    """
    chunks = stored(chunks.where("n_tokens > 0"), "chunks")
    ranked = stored(probe_ranks(probes, chunks, max(DEPTH, *BUDGETS), encode), "ranked")
    first = ranked.where(F.col("rank") <= DEPTH).groupBy("qid").agg(F.min(F.when(F.col("is_hit"), F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= 5, F.col("n_tokens"))).alias("top5"))
    rows = probes.select(F.col("pid").alias("qid")).join(first, "qid", "left")
    for budget in BUDGETS:
        rows = rows.join(evidence.hit_within_tokens(ranked, budget).withColumnRenamed("hit", f"hit_{budget}tok"), "qid", "left")
    told = [F.round(F.avg(metrics.hit_at(F.col("first"), k)), 6).alias(f"hit_{k}") for k in KS]
    told += [F.round(F.avg(metrics.reciprocal_rank(F.col("first"))), 6).alias("mrr_10")]
    told += [F.round(F.avg(F.coalesce(f"hit_{b}tok", F.lit(0.0))), 6).alias(f"hit_{b}tok") for b in BUDGETS]
    told += [F.round(F.avg("top5"), 6).alias("top5_tokens"), F.count("*").alias("n_probes")]
    sizes = chunks.agg(F.count("*").alias("n_chunks"), F.median("n_tokens").alias("median_tokens"))
    return rows.agg(*told).crossJoin(sizes)  # one row by one row


def grid(docs: DataFrame, probes: DataFrame, configs: tuple[chunking.ChunkingConfig, ...] | None = None, count: chunking.Counter = chunking.count_words, encode=None) -> DataFrame:
    """``score`` of each configuration with max_tokens, overlap_tokens and min_section_tokens: four sizes, overlaps of none and an eighth."""
    if configs is None:
        configs = tuple(replace(chunking.ChunkingConfig(), max_tokens=n, overlap_tokens=o) for n in (128, 256, 512, 1024) for o in (0, n // 8))
    out = None
    for cfg in configs:
        sizes = [F.lit(getattr(cfg, c)).alias(c) for c in ("max_tokens", "overlap_tokens", "min_section_tokens")]
        row = score(probes, chunking.chunk_documents(docs, cfg, count), encode).select(*sizes, "*")
        out = row if out is None else out.unionByName(row)
    return out


def markdown(scores: DataFrame) -> str:
    """The grid's rows, one for each configuration, as a table."""
    columns = ("max_tokens", "overlap_tokens", "min_section_tokens", "hit_1", "hit_5", "mrr_10", "hit_2000tok", "n_chunks", "median_tokens", "top5_tokens")
    shown = lambda c, v: f"{v:.0f}" if c.endswith(("chunks", "tokens")) else f"{v:.3f}"
    rows = [[shown(c, r[c]) for c in columns] for r in scores.orderBy(*columns[:3]).collect()]
    return "\n".join("| " + " | ".join(x) + " |" for x in [columns, ["---"] * len(columns), *rows]) + "\n"
