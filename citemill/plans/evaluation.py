"""Questions, configurations and clients to records, and records to a report."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.functions.text import expected_text
from citemill.operators import answering, bootstrap, drafting, evidence, metrics
from citemill.sources import sinks
from citemill.sources.store import stored

from .assistant import cited_ids, found_for, with_sources


@dataclass(frozen=True)
class EvalConfig:
    name: str
    mode: str = "hybrid_rerank"
    citation_check: bool = True
    citations_requested: bool = True
    min_score: float | None = None
    #: The configuration's own prompt, if it isn't the run's.
    template: str | None = None


#: The configurations of a run: no safeguards at all, then the retrieval modes, then no citation check.
DEFAULT_CONFIGS = (
    EvalConfig("naive_rag", "dense", citation_check=False, citations_requested=False),
    EvalConfig("baseline_dense", "dense"),
    EvalConfig("hybrid", "hybrid"),
    EvalConfig("hybrid_rerank", "hybrid_rerank"),
    EvalConfig("hybrid_rerank_no_citecheck", "hybrid_rerank", citation_check=False),
)


def gold(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, gold_groups): for each quote of evidence the chunks that hold it; an empty list where none does."""
    quotes = questions.select(F.col("id").alias("qid"), F.posexplode("evidence").alias("pos", "e")).select("qid", "pos", "e.doc_id", "e.quote")
    return evidence.gold_groups(evidence.resolve(quotes, chunks))


def fingerprint(pipeline: dict, configs: list[EvalConfig], questions: DataFrame, templates: dict[str, str], models: dict[str, str]) -> dict:
    """All that decides a run's records: settings, configurations, prompts and questions by digest, models.

    The questions' digest doesn't depend on their order.
    """
    row = questions.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(questions.columns)))).cast("decimal(38,0)")).alias("s")).first()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()[:12]
    return {
        **pipeline, "models": models, "questions": digest(f"{row.n}:{row.s}"), "prompts": {k: digest(v) for k, v in sorted(templates.items())},
        "configs": [asdict(c) for c in configs],
    }


def run_id(told: dict) -> str:
    """A run is named by its fingerprint, so the same run resumes and another one starts afresh."""
    return "run-" + hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:10]


def evaluate(
    questions: DataFrame, configs: list[EvalConfig], index: dict[str, DataFrame], client: answering.Client,
    judge_client: answering.Client, template: str, judge_template: str, done: DataFrame | None = None, top_k: int = 5,
    **retrieval,
) -> DataFrame:
    """One record per question and configuration that has none in ``done(config, qid)``.

    Each configuration is one plan over all its questions; configurations of one mode share its search.
    Retrieval is a batch: a question's retrieval_s is the batch's seconds over its questions. Behind
    ``answering.Cached`` clients a second run asks nothing. Calls, tokens and seconds of generation
    and of the judge are those of the clients (``answering.measured``). ``retrieval`` goes to
    ``retrieve``: an encoder, a reranker, sizes.
    """
    chunks, groups, out = index["chunks"], gold(questions, index["chunks"]), None
    searched: dict[str, tuple[DataFrame, float]] = {}
    for cfg in configs:
        todo = questions
        if done is not None:
            todo = questions.join(done.where(F.col("config") == cfg.name).select(F.col("qid").alias("id")), "id", "left_anti")
        if cfg.mode not in searched:  # one search for all configurations of a mode
            searched[cfg.mode] = found_for(questions.select(F.col("id").alias("qid"), "question"), index, cfg.mode, top_k, **retrieval)
        found, each = searched[cfg.mode]
        asked = with_sources(todo.withColumnRenamed("id", "qid"), found, chunks).join(groups, "qid", "left")
        asked = asked.withColumn("gold_groups", F.coalesce("gold_groups", F.array().cast("array<array<string>>")))
        answers = stored(answering.answer(asked.withColumn("top_score", F.col("top_rerank_score")), client, cfg.template or template, citation_check=cfg.citation_check, min_score=cfg.min_score), "answers")
        told = asked.join(answers, "qid").select(
            "qid", "abstained", "question", expected_text(F.col("expected")).alias("expected"), F.col("reference_answer").alias("reference"), F.col("sources").alias("context"), F.col("text").alias("answer")
        )
        verdicts = drafting.judge(told, judge_client, judge_template)
        rows = asked.join(answers, "qid").join(verdicts, "qid", "left").select(
            "qid", F.lit(cfg.name).alias("config"), "split", "category", "subtype", "expected", "question", F.col("reference_answer").alias("reference"),
            "retrieved_ids", "top_rerank_score", "gold_groups", F.col("text").alias("answer"), "abstained", F.col("reason").alias("abstain_reason"),
            cited_ids().alias("cited_ids"),
            F.col("check.valid").alias("citation_valid"), F.col("first_valid").alias("citation_first_attempt_valid"),
            F.size("check.uncited_sentences").alias("n_uncited_sentences"), F.lit(cfg.citations_requested).alias("citations_requested"),
            "n_llm_calls", "input_tokens", "output_tokens", F.lit(each).alias("retrieval_s"), "generation_s", "verdict",
            F.col("error").alias("judge_error"), F.coalesce("judge_tokens", F.lit(0)).alias("judge_tokens"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def of_split(records: DataFrame, split: str) -> DataFrame:
    return records if split == "all" else records.where(F.col("split") == split)


def report(records: DataFrame, split: str = "all", n_boot: int = bootstrap.N_BOOT) -> DataFrame:
    """records -> (config, metric, mean, low, high, n) of the chosen split."""
    return metrics.summarize(metrics.per_question(of_split(records, split)), n_boot=n_boot)


#: The configurations that others are compared with, and by which metrics.
BASELINES = ("naive_rag", "baseline_dense")
COMPARED = ("hit_5", "mrr_10", "correctness", "any_unsupported", "correct_abstention", "false_abstention")


def results(records: DataFrame, split: str = "test", baselines: tuple[str, ...] = BASELINES, n_boot: int = bootstrap.N_BOOT) -> dict:
    """A run's results as one small document: each configuration's summary, and paired differences from each baseline that is there."""
    measured = stored(metrics.per_question(of_split(records, split)), "measured")
    summaries: dict[str, dict] = {r.config: {"n_questions": r["count"]} for r in measured.groupBy("config").count().collect()}
    for r in metrics.summarize(measured, n_boot=n_boot).collect():
        summaries[r.config][r.metric] = {"mean": r["mean"], "ci95": [r.low, r.high], "n": r.n}
    for r in metrics.hallucination(measured).collect():
        summaries[r.config]["hallucination_rate"] = {"mean": r.rate, "unsupported_claims": int(r.unsupported or 0), "total_claims": int(r.claims or 0), "n": r.n}
    for r in metrics.costs(measured).collect():
        summaries[r.config] |= {"latency_s": {"p50": r.latency_p50, "p95": r.latency_p95}, "tokens_per_question": r.mean_tokens, "judge_tokens_per_question": r.mean_judge_tokens}
    for r in metrics.by_category(measured).collect():
        summaries[r.config].setdefault("by_category", {})[r.category] = {"n": r.n, "correctness": r.correctness, "correct_abstention": r.correct_abstention}
    versus: dict = {}
    for r in bootstrap.against(metrics.long_form(measured, COMPARED), baselines, n_boot=n_boot).collect():
        versus.setdefault(r.baseline, {}).setdefault(r.config, {})[r.metric] = {"diff": r.difference, "ci95": [r.low, r.high]}
    return {"split": split, "summaries": summaries, "vs_baseline": versus}


#: Columns of the results table.
SHOWN = {
    "hit_5": "Hit@5", "mrr_10": "MRR@10", "correctness": "Answer correctness", "hallucination_rate": "Hallucination rate (claims)",
    "correct_abstention": "Correct abstention (unanswerable)", "false_abstention": "False abstention (answerable)", "citation_valid": "Citation validity",
}


def results_markdown(told: dict) -> str:
    """The table of all configurations, and under it the differences from each baseline."""

    def cell(summary: dict, key: str) -> str:
        own = summary.get(key) or {}
        if own.get("mean") is None:
            return "n/a"
        if "ci95" not in own:
            return f"{own['mean']:.1%} ({own['unsupported_claims']}/{own['total_claims']})"
        return f"{own['mean']:.1%} [{own['ci95'][0]:.0%}, {own['ci95'][1]:.0%}]"

    def row(cells: list[str]) -> str:
        return "| " + " | ".join(cells) + " |"

    seconds = lambda s: f"{s['p50']:.1f}s / {s['p95']:.1f}s" if s and s["p50"] is not None else "n/a"
    lines = [f"Split `{told['split']}`, 95% bootstrap intervals in brackets.", "", row(["Configuration", *SHOWN.values(), "Latency p50 / p95", "Tokens/q"]), "|---" * (len(SHOWN) + 3) + "|"]
    for name, s in sorted(told["summaries"].items()):
        tokens = s.get("tokens_per_question")
        lines.append(row([f"`{name}`", *(cell(s, k) for k in SHOWN), seconds(s.get("latency_s")), "n/a" if tokens is None else f"{tokens:.0f}"]))
    for base, others in sorted(told["vs_baseline"].items()):
        lines += ["", f"Paired differences from `{base}`:", "", row(["Configuration", *COMPARED]), "|---" * (len(COMPARED) + 1) + "|"]
        for name, found in sorted(others.items()):
            shown = lambda d: f"{d['diff']:+.1%} [{d['ci95'][0]:+.0%}, {d['ci95'][1]:+.0%}]" if d else "n/a"
            lines.append(row([f"`{name}`", *(shown(found.get(k)) for k in COMPARED)]))
    return "\n".join(lines) + "\n"


def write_results(records: DataFrame, run_dir: str, split: str = "test", **options) -> dict:
    """results.json and results.md of a run, on the driver: they are small documents."""
    told = results(records, split, **options)
    sinks.write_json(told, f"{run_dir}/results.json")
    with open(f"{run_dir}/results.md", "w", encoding="utf-8", newline="\n") as f:
        f.write(results_markdown(told))
    return told
