"""What a run is configured by: a YAML file, the environment, and prompt templates. All small, all on the driver."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from citemill.operators.chunking import ChunkingConfig
from citemill.plans.service import RateLimits

from .files import CorpusConfig


@dataclass(frozen=True)
class EmbeddingConfig:
    model: str = "hashed-terms"
    query_prefix: str = ""


@dataclass(frozen=True)
class RetrievalConfig:
    mode: str = "hybrid_rerank"
    top_k: int = 5
    dense_candidates: int = 30
    bm25_candidates: int = 30
    rrf_k: int = 60
    rerank_candidates: int = 20
    reranker_model: str = "term-overlap"


@dataclass(frozen=True)
class GenerationConfig:
    protocol_name: str = "product"
    prompt_version: str = "answer"
    temperature: float = 0.0
    max_output_tokens: int = 1024
    citation_check: bool = True
    max_citation_retries: int = 1
    require_sentence_coverage: bool = False
    on_violation: str = "abstain"
    min_rerank_score: float | None = None


@dataclass(frozen=True)
class PipelineConfig:
    """One configuration of corpus, index, retrieval and answers."""

    corpus: CorpusConfig
    chunking: ChunkingConfig = ChunkingConfig()
    embedding: EmbeddingConfig = EmbeddingConfig()
    retrieval: RetrievalConfig = RetrievalConfig()
    generation: GenerationConfig = GenerationConfig()
    bot_limits: RateLimits = RateLimits()

    def told(self) -> dict:
        return asdict(self)


#: Names of corpus fields in the file that differ from ours.
_CORPUS = {"include_prefixes": "include", "exclude_prefixes": "exclude", "published_url_template": "url_template"}


def _made(kind: type, given: dict | None) -> object:
    """A block of the file; a key it doesn't know is an error, lists become tuples."""
    known = {f.name for f in fields(kind)}
    given = {_CORPUS.get(k, k) if kind is CorpusConfig else k: tuple(v) if isinstance(v, list) else v for k, v in (given or {}).items()}
    if kind is CorpusConfig:
        given = {k: v for k, v in given.items() if k not in ("name", "license_file")}
    if unknown := sorted(set(given) - known):
        raise ValueError(f"{kind.__name__} has no {', '.join(unknown)}")
    return kind(**given)


_BLOCKS = {
    "corpus": CorpusConfig, "chunking": ChunkingConfig, "embedding": EmbeddingConfig, "retrieval": RetrievalConfig,
    "generation": GenerationConfig, "bot_limits": RateLimits,
}


def load_pipeline(path: str) -> PipelineConfig:
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    return PipelineConfig(**{name: _made(kind, data[name]) for name, kind in _BLOCKS.items() if name in data})


@dataclass(frozen=True)
class Settings:
    """Choices and secrets that don't belong in a file of the repository: the environment, then ``.env``, then these."""

    llm_provider: str = ""
    generator_model: str = ""
    judge_provider: str = ""
    judge_model: str = ""
    user_salt: str = ""
    secrets: dict[str, str] = field(default_factory=dict, repr=False)


def load_settings(env_file: str = ".env", environ: dict[str, str] | None = None) -> Settings:
    """Names in capitals; what ends in _KEY or _TOKEN is a secret."""
    found: dict[str, str] = {}
    if os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as f:
            for line in f:
                name, sign, value = line.strip().partition("=")
                if sign and not name.startswith("#"):
                    found[name.strip()] = value.strip().strip("\"'")
    found |= os.environ if environ is None else environ
    own = {f.name: found[f.name.upper()] for f in fields(Settings) if f.name != "secrets" and f.name.upper() in found}
    return Settings(**own, secrets={k: v for k, v in found.items() if k.endswith(("_KEY", "_TOKEN"))})


def required(settings: Settings, name: str) -> str:
    """A secret that a client needs; an error names it where it is missing."""
    if not settings.secrets.get(name):
        raise ValueError(f"{name} is not set")
    return settings.secrets[name]


@dataclass(frozen=True)
class PromptTemplate:
    version: str
    system: str
    user: str


def load_template(folder: str, version: str, end: str = "") -> PromptTemplate:
    """The parts below the lines ``## System`` and ``## User`` of a Markdown file; the user's part ends at ``end`` if it is given and there."""
    with open(f"{folder}/{version}.md", encoding="utf-8") as f:
        text = f.read()
    _, system_found, rest = text.partition("## System\n")
    system, user_found, user = rest.partition("## User\n")
    if not (system_found and user_found):
        raise ValueError(f"{version}.md needs the headings System and User")
    return PromptTemplate(version, system.strip(), (user.partition(end)[0] if end else user).strip())


def make_client(settings: Settings, judge: bool = False) -> Callable:
    """The registered factory that the settings name, with their model."""
    from citemill.operators.answering import make_model

    provider = (settings.judge_provider if judge else "") or settings.llm_provider
    model = settings.judge_model if judge else settings.generator_model
    return lambda: make_model(provider, model=model)
