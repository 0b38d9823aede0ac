"""Questions to grounded answers over an index, as one plan each for retrieval, prompts, calls and decisions."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.operators import answering, bm25
from citemill.sources.store import stored

from .retrieval import retrieve


def found_for(questions: DataFrame, index: dict[str, DataFrame], mode: str, top_k: int, **retrieval) -> tuple[DataFrame, float]:
    """questions(qid, question) -> (ranked chunks, written; seconds of the batch over its questions)."""
    begin = time.perf_counter()
    texts = index["chunks"].select(F.col("chunk_id").alias("id"), "text")
    found = stored(retrieve(questions.select("qid", F.col("question").alias("text")), texts, index["vectors"], bm25.Index(index["postings"]), mode, top_k, **retrieval), "retrieved")
    return found, (time.perf_counter() - begin) / max(questions.count(), 1)


def shown(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, rank, heading, url, text): what a prompt quotes and a reply links to."""
    return found.join(chunks, found.id == chunks.chunk_id).select("qid", "rank", F.array_join("heading_path", " > ").alias("heading"), "url", "text")


def with_sources(questions: DataFrame, found: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions(qid, ...) with n_sources, sources, retrieved_ids and top_rerank_score; none found gives none."""
    ids = found.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved_ids"), F.max("rerank_score").alias("top_rerank_score"))
    asked = questions.join(answering.sources_text(shown(found, chunks)), "qid", "left").join(ids, "qid", "left")
    return asked.withColumns({
        "n_sources": F.coalesce("n_sources", F.lit(0)), "sources": F.coalesce("sources", F.lit("")),
        "retrieved_ids": F.coalesce("retrieved_ids", F.array().cast("array<string>")),
    })


def cited_ids() -> Column:
    """The chunks that an answer cites, of its columns cited and retrieved_ids."""
    return F.transform("cited", lambda a: F.col("retrieved_ids")[F.substring(a, 2, 9).cast("int") - 1])


@dataclass(frozen=True)
class Assistant:
    """An index, a client and what decides an answer."""

    index: dict[str, DataFrame]
    client: answering.Client
    template: str
    system: str = ""
    product: str = "product"
    mode: str = "hybrid_rerank"
    top_k: int = 5
    retries: int = 1
    temperature: float = 0.0
    max_output_tokens: int = 1024
    #: citation_check, require_coverage, abstain_on_violation, min_score: as ``answering.decide`` takes them.
    policy: dict = field(default_factory=dict)
    #: Sizes, an encoder, a reranker: as ``retrieve`` takes them.
    retrieval: dict = field(default_factory=dict)

    def answer(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """questions(qid, question) -> (answers, what they were shown).

        answers(qid, question, ``answering.answer``'s columns, retrieved_ids, cited_ids, citation_valid,
        retrieval_s), written; shown(qid, rank, heading, url, text).
        """
        found, each = found_for(questions, self.index, self.mode, self.top_k, **self.retrieval)
        asked = with_sources(questions.select("qid", "question"), found, self.index["chunks"])
        said = answering.answer(
            asked.withColumn("top_score", F.col("top_rerank_score")), self.client, self.template, self.product, self.retries, self.system,
            self.temperature, self.max_output_tokens, **self.policy,
        )
        whole = asked.select("qid", "question", "retrieved_ids").join(said, "qid")
        whole = whole.withColumns({"cited_ids": cited_ids(), "citation_valid": F.col("check.valid"), "retrieval_s": F.lit(each)})
        return stored(whole, "answers"), shown(found, self.index["chunks"])
