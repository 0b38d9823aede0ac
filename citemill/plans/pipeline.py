"""One configuration from corpus to index, answers, requests and evaluation: what the settings say is what runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from citemill.operators import answering, chunking
from citemill.sources import files, sinks
from citemill.sources.settings import PipelineConfig, PromptTemplate, load_template

from . import ingest, service
from .assistant import Assistant

#: Encoders and rerankers by the names that settings give; None stands for the library's own.
ENCODERS: dict[str, Callable | None] = {"hashed-terms": None}
RERANKERS: dict[str, Callable | None] = {"term-overlap": None}


def _named(known: dict, name: str, what: str):
    if name not in known:
        raise ValueError(f"no {what} is registered as {name}")
    return known[name]


@dataclass(frozen=True)
class Pipeline:
    """``path`` holds the index; ``templates`` is the folder of prompt templates."""

    spark: SparkSession
    cfg: PipelineConfig
    path: str
    templates: str
    count: chunking.Counter = chunking.count_words

    def built_from(self) -> dict:
        """What decides an index; an index that was built from something else is an error when it is read."""
        return {"corpus": asdict(self.cfg.corpus), "chunking": asdict(self.cfg.chunking), "embedding": self.cfg.embedding.model}

    def build(self, folder: str) -> DataFrame:
        """A mirror of the repository -> the manifest, the chunks and the index; gives the chunks."""
        corpus = files.read_corpus(self.spark, folder, self.cfg.corpus)
        manifest = files.manifest_of(corpus, self.cfg.corpus)
        sinks.write_manifest(manifest, f"{self.path}/manifest")
        chunks = ingest.chunk_corpus(corpus, manifest, self.cfg.chunking, self.count)
        ingest.build_index(chunks, self.path, self.built_from(), _named(ENCODERS, self.cfg.embedding.model, "encoder"))
        return self.index()["chunks"]

    def index(self) -> dict[str, DataFrame]:
        return sinks.read_index(self.spark, self.path, self.built_from())

    def retrieval(self) -> dict:
        r = self.cfg.retrieval
        return {
            "candidates": r.dense_candidates, "bm25_candidates": r.bm25_candidates, "rerank_candidates": r.rerank_candidates, "rrf_k": r.rrf_k,
            "query_prefix": self.cfg.embedding.query_prefix, "encode": _named(ENCODERS, self.cfg.embedding.model, "encoder"),
            "reranker": _named(RERANKERS, r.reranker_model, "reranker"),
        }

    def template(self) -> PromptTemplate:
        return load_template(self.templates, self.cfg.generation.prompt_version)

    def assistant(self, client: answering.Client) -> Assistant:
        g, t = self.cfg.generation, self.template()
        policy = {
            "citation_check": g.citation_check, "require_coverage": g.require_sentence_coverage, "abstain_on_violation": g.on_violation == "abstain",
            "min_score": g.min_rerank_score,
        }
        return Assistant(
            self.index(), client, t.user, t.system, g.protocol_name, self.cfg.retrieval.mode, self.cfg.retrieval.top_k, g.max_citation_retries,
            g.temperature, g.max_output_tokens, policy, self.retrieval(),
        )

    def answer(self, questions: DataFrame, client: answering.Client) -> tuple[DataFrame, DataFrame]:
        """questions(qid, question) -> ``Assistant.answer``."""
        return self.assistant(client).answer(questions)

    def ask(self, requests: DataFrame, client: answering.Client, salt: str = "") -> tuple[DataFrame, DataFrame]:
        """requests -> ``service.ask`` under the settings' limits."""
        return service.ask(requests, self.assistant(client), self.cfg.bot_limits, salt)
