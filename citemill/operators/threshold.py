"""Simulating and tuning the retrieval-score gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.sources.store import stored

from .ranges import numbered, running

STEP = 1e-6


def _counts(records: DataFrame) -> DataFrame:
    """One row per distinct score: how many of either kind abstain anyway, and how many there are."""
    kind = F.when(F.col("expected") == "abstain", "u").otherwise("a")
    n = lambda k, only: F.sum(F.when((kind == k) & only, 1).otherwise(0))
    any_, open_ = F.lit(True), ~F.col("abstained")
    return records.groupBy("score").agg(
        n("u", any_).alias("n_u"), n("a", any_).alias("n_a"), n("u", open_).alias("open_u"), n("a", open_).alias("open_a")
    )


def sweep(records: DataFrame, max_false: float = 0.10) -> DataFrame:
    """records(expected, abstained, score) -> one row per candidate threshold with its place, best first.

    Candidates are none, every distinct score and every score + 1e-6, in this order; a row abstains
    if it did or its score is below the threshold (a null score never is). Those within the cap on
    false abstention come first, then by correct - false abstention, then by candidate. Records are
    added up by score before; running sums over ranges of distinct scores give all points at once, not a
    pass over the records for each threshold.
    """
    return numbered(_points(records, max_false), ["over_", "less_", "ordinal"], "nth").select(
        (F.col("nth") + 1).cast("int").alias("place"), F.round("threshold", 7).alias("threshold"), F.round("correct", 6).alias("correct_abstention"),
        F.round("false_", 6).alias("false_abstention"), "n_unanswerable", "n_answerable",
    )


def _points(records: DataFrame, max_false: float) -> DataFrame:
    """(threshold, ordinal, correct, false_, over_, less_, totals) of every candidate, to be ordered by over_, less_, ordinal."""
    counts = stored(_counts(records), "scores")
    whole = counts.agg(
        *[F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"all_{s}") for s in "ua"],
        *[F.coalesce(F.sum(F.col(f"n_{s}") - F.col(f"open_{s}")), F.lit(0)).alias(f"base_{s}") for s in "ua"], F.count("score").alias("m"),
    )
    scores = counts.where("score is not null").withColumn("one_", F.lit(1).cast("bigint"))
    ranked = running(scores, ["score"], {"g_u": ("open_u", "sum"), "g_a": ("open_a", "sum"), "place": ("one_", "sum")})
    each = F.explode(F.array(
        F.struct(F.col("score").alias("threshold"), F.lit(False).alias("after"), "g_u", "g_a"),
        F.struct((F.col("score") + STEP).alias("threshold"), F.lit(True).alias("after"), (F.col("g_u") + F.col("open_u")).alias("g_u"), (F.col("g_a") + F.col("open_a")).alias("g_a")),
    ))
    at = ranked.select("place", each.alias("x")).select("x.threshold", "x.after", F.col("place") + 1, "x.g_u", "x.g_a").toDF("threshold", "after", "nth", "g_u", "g_a")
    rows = at.join(F.broadcast(whole), F.lit(True))  # beside one row of totals
    ordinal = F.col("nth") + F.when(F.col("after"), F.col("m")).otherwise(0)
    none = whole.select(F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("bigint").alias("ordinal"), F.lit(0).cast("bigint").alias("g_u"), F.lit(0).cast("bigint").alias("g_a"), "all_u", "all_a", "base_u", "base_a")
    every = none.unionByName(rows.withColumn("ordinal", ordinal).select(none.columns))
    rate = lambda side: F.coalesce(F.try_divide((F.col(f"base_{side}") + F.col(f"g_{side}")).cast("double"), F.col(f"all_{side}")), F.lit(0.0))
    points = every.select("threshold", "ordinal", rate("u").alias("correct"), rate("a").alias("false_"), F.col("all_u").alias("n_unanswerable"), F.col("all_a").alias("n_answerable"))
    return stored(points.withColumns({"over_": (F.col("false_") > max_false).cast("int"), "less_": -F.round(F.col("correct") - F.col("false_"), 12)}), "points")


def best(records: DataFrame, max_false: float = 0.10) -> DataFrame:
    """The first point of the sweep; records that aren't of the dev split are an error."""
    dev = records.withColumn("score", F.when(F.col("split") == "dev", F.col("score")).otherwise(F.raise_error(F.lit("tuning takes dev records only"))))
    first = _points(dev, max_false).agg(F.min(F.struct("over_", "less_", "ordinal", "threshold", "correct", "false_", "n_unanswerable", "n_answerable")).alias("p"))
    return first.select(
        F.lit(1).alias("place"), F.round("p.threshold", 7).alias("threshold"), F.round("p.correct", 6).alias("correct_abstention"),
        F.round("p.false_", 6).alias("false_abstention"), "p.n_unanswerable", "p.n_answerable",
    )


def simulate(records: DataFrame, thresholds: list[float | None]) -> DataFrame:
    """The rates at stated thresholds, all in one pass over the records."""
    stated = F.array(*[F.struct(F.lit(t).cast("double").alias("threshold")) for t in thresholds])
    rows = records.select("expected", "abstained", "score", F.inline(stated))
    gone = F.col("abstained") | F.coalesce(F.col("score") < F.col("threshold"), F.lit(False))
    rate = lambda cond: F.coalesce(F.avg(F.when(cond, gone.cast("double"))), F.lit(0.0))
    unanswerable = F.col("expected") == "abstain"
    return rows.groupBy("threshold").agg(F.round(rate(unanswerable), 6).alias("correct_abstention"), F.round(rate(~unanswerable), 6).alias("false_abstention"))


def shown(points: DataFrame) -> DataFrame:
    """Points that differ at 4 decimals, the best placed of each; the ungated one always."""
    keyed = points.withColumn("none", F.col("threshold").isNull()).withColumn("c", F.round("correct_abstention", 4)).withColumn("f", F.round("false_abstention", 4))
    first = keyed.groupBy("none", "c", "f").agg(F.min_by(F.struct(*points.columns), "place").alias("p"))
    return first.select("p.*")
