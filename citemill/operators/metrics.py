"""Evaluation metrics over a fact table with one row per (config, question)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bootstrap
from .quantiles import percentiles

MEAN_METRICS = (
    "hit_1", "hit_5", "mrr_10", "evidence_recall_5", "correctness", "fully_correct", "any_unsupported",
    "correct_abstention", "false_abstention", "citation_valid", "citation_first_try_valid", "fully_cited",
)


def first_hit_rank(ids: Column, gold: Column) -> Column:
    """1-based place of the first id that is gold; null without one."""
    places = F.filter(F.transform(ids, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda p: p.isNotNull())
    return F.array_min(places)


def hit_at(first_rank: Column, k: int) -> Column:
    return F.when(first_rank <= k, 1.0).otherwise(0.0)


def reciprocal_rank(first_rank: Column, cutoff: int = 10) -> Column:
    return F.when(first_rank <= cutoff, 1.0 / first_rank).otherwise(0.0)


def evidence_recall_at(ids: Column, groups: Column, k: int) -> Column:
    """The share of groups that meet the first k ids; an empty group is a miss, no group gives 0."""
    met = F.size(F.filter(groups, lambda g: F.arrays_overlap(g, F.slice(ids, 1, k))))
    return F.coalesce(F.try_divide(met.cast("double"), F.size(groups)), F.lit(0.0))


def per_question(records: DataFrame) -> DataFrame:
    """One row per record with every metric; null where it doesn't apply."""
    answerable = F.col("expected") != "abstain"
    gold = F.array_distinct(F.flatten("gold_groups"))
    with_gold = records.withColumn("first_rank", first_hit_rank(F.col("retrieved_ids"), gold))
    has_gold = answerable & (F.size(gold) > 0)
    judged, answered = F.col("verdict").isNotNull(), ~F.col("abstained")
    claims = F.size("verdict.claims")
    unsupported = F.size(F.filter("verdict.claims", lambda c: ~c["supported"]))
    graded = answerable & (judged | F.col("abstained"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    asked = answered & F.col("citations_requested")
    return with_gold.select(
        "config", "qid", "category",
        F.when(has_gold, hit_at(F.col("first_rank"), 1)).alias("hit_1"),
        F.when(has_gold, hit_at(F.col("first_rank"), 5)).alias("hit_5"),
        F.when(has_gold, reciprocal_rank(F.col("first_rank"))).alias("mrr_10"),
        F.when(has_gold, evidence_recall_at(F.col("retrieved_ids"), F.col("gold_groups"), 5)).alias("evidence_recall_5"),
        F.when(graded, F.coalesce(F.col("verdict.correctness") / 2, F.lit(0.0))).alias("correctness"),
        F.when(graded, flag(F.col("verdict.correctness") == 2)).alias("fully_correct"),
        F.when(judged & answered, unsupported.cast("double")).alias("unsupported_claims"),
        F.when(judged & answered, claims.cast("double")).alias("total_claims"),
        F.when(judged & answered & (claims > 0), flag(unsupported > 0)).alias("any_unsupported"),
        F.when(~answerable, flag(F.col("abstained"))).alias("correct_abstention"),
        F.when(answerable, flag(F.col("abstained"))).alias("false_abstention"),
        F.when(asked & F.col("citation_valid").isNotNull(), flag(F.col("citation_valid"))).alias("citation_valid"),
        F.when(F.col("citation_first_attempt_valid").isNotNull(), flag(F.col("citation_first_attempt_valid"))).alias("citation_first_try_valid"),
        F.when(asked & F.col("n_uncited_sentences").isNotNull(), flag(F.col("n_uncited_sentences") == 0)).alias("fully_cited"),
        (F.col("retrieval_s") + F.col("generation_s")).alias("latency_s"),
        (F.col("input_tokens") + F.col("output_tokens")).cast("double").alias("tokens"),
        F.col("judge_tokens").cast("double").alias("judge_tokens"),
    )


def long_form(metrics: DataFrame, names: tuple = MEAN_METRICS) -> DataFrame:
    """(config, qid, category, metric, value), nulls left out."""
    return metrics.unpivot(["config", "qid", "category"], list(names), "metric", "value").where("value is not null")


def summarize(metrics: DataFrame, **options) -> DataFrame:
    """(config, metric, mean, low, high, n): means with their bootstrap intervals (options of ``bootstrap_ci``)."""
    values = long_form(metrics).select(F.struct("config", "metric").alias("grp"), F.col("qid").alias("key"), "value")
    return bootstrap.bootstrap_ci(values, **options).select("grp.config", "grp.metric", "mean", "low", "high", "n")


def costs(metrics: DataFrame) -> DataFrame:
    """(config, latency p50 and p95 by linear interpolation, mean tokens)."""
    means = metrics.groupBy(F.struct("config").alias("g")).agg(F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.round(F.avg("judge_tokens"), 6).alias("mean_judge_tokens"))
    found = percentiles(metrics.select(F.col("config").alias("grp"), F.col("latency_s").alias("value")), {"p50": 0.5, "p95": 0.95})
    places = found.select(F.struct(F.col("grp").alias("config")).alias("g"), F.round("p50", 6).alias("latency_p50"), F.round("p95", 6).alias("latency_p95"))
    return means.join(places, "g", "left").select("g.config", "latency_p50", "latency_p95", "mean_tokens", "mean_judge_tokens")


def hallucination(metrics: DataFrame) -> DataFrame:
    """(config, unsupported, claims, rate, n): rate is null without a claim; n counts verdicts, also those without claims."""
    sums = metrics.groupBy("config").agg(F.sum("unsupported_claims").alias("unsupported"), F.sum("total_claims").alias("claims"), F.count("total_claims").alias("n"))
    return sums.withColumn("rate", F.round(F.try_divide("unsupported", "claims"), 6))


def by_category(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("config", "category").agg(
        F.count("*").alias("n"), F.round(F.avg("correctness"), 6).alias("correctness"), F.round(F.avg("correct_abstention"), 6).alias("correct_abstention")
    )


def chunk_sizes(chunks: DataFrame, by: str | None = None) -> DataFrame:
    """n_chunks, nearest-place p50 and p95 (not interpolated) and largest of n_tokens; one row, or one for each value of ``by``."""
    own = chunks.select((F.col(by) if by else F.lit(0)).alias("grp"), F.col("n_tokens").alias("value"))
    whole = own.groupBy(F.struct("grp").alias("g")).agg(F.count("value").alias("n_chunks"), F.max("value").alias("largest"))
    found = percentiles(own, {"p50": 0.5, "p95": 0.95}, interpolate=False).withColumn("g", F.struct("grp")).drop("grp")
    told = whole.join(found, "g", "left")
    if by:
        return told.select(F.col("g.grp").alias(by), "n_chunks", "p50", "p95", "largest")
    # Without chunks there is a row, too.
    return told.agg(F.coalesce(F.max("n_chunks"), F.lit(0)).alias("n_chunks"), *[F.max(c).alias(c) for c in ("p50", "p95", "largest")])
