"""Stratified splits and samples, and curation of drafted questions. Shuffles are orders of md5(seed:id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEV_FRACTION = 0.27


def shuffle_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def assign_splits(questions: DataFrame, seed: int = 11, dev_fraction: float = DEV_FRACTION) -> DataFrame:
    """questions(id, category, subtype, ...) -> with split, draft_id and a new id q001... in order of stratum and shuffle.

    Of each (category, subtype) the first round-half-even(n * dev_fraction) are dev. Running numbers
    go by stratum: sums of the strata before, and a rank within.
    """
    strata = ["category", "subtype"]
    within = Window.partitionBy(*strata).orderBy("shuffle_", "id")
    sizes = questions.groupBy(*strata).agg(F.count("*").alias("n_"))
    order = Window.orderBy("category", F.coalesce("subtype", F.lit(""))).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(order), F.lit(0))).select(F.col("category").alias("c_"), F.col("subtype").alias("s_"), "n_", "before_")
    ranked = questions.withColumn("shuffle_", shuffle_key(seed, F.col("id"))).withColumn("nth_", F.row_number().over(within))
    placed = ranked.join(sizes, F.col("category").eqNullSafe(F.col("c_")) & F.col("subtype").eqNullSafe(F.col("s_")))
    split = F.when(F.col("nth_") <= F.bround(F.col("n_") * F.lit(dev_fraction), 0), "dev").otherwise("test")
    draft = F.coalesce("draft_id", "id") if "draft_id" in questions.columns else F.col("id")
    keep = [c for c in questions.columns if c not in ("id", "split", "draft_id")]
    return placed.select(F.format_string("q%03d", F.col("before_") + F.col("nth_")).alias("id"), *keep, draft.cast("string").alias("draft_id"), split.alias("split"))


def round_robin(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 5) -> DataFrame:
    """n rows, taken from the strata in turn, each stratum shuffled; with their place in a last shuffle."""
    within = Window.partitionBy(stratum).orderBy(shuffle_key(seed, F.col(key)), key)
    # No stratum can give more than its first n.
    some = rows.withColumn("nth_", F.row_number().over(within)).where(F.col("nth_") <= n)
    picked = some.orderBy("nth_", stratum).limit(n)
    return picked.withColumn("place", F.row_number().over(Window.orderBy(shuffle_key(seed + 1, F.col(key)), key))).drop("nth_")


def sample_each(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Up to n rows of each stratum."""
    within = Window.partitionBy(stratum).orderBy(shuffle_key(seed, F.col(key)), key)
    return rows.withColumn("nth_", F.row_number().over(within)).where(F.col("nth_") <= n).drop("nth_")


def apply_curation(questions: DataFrame, drop: DataFrame, rewrite: DataFrame, recategorize: DataFrame) -> DataFrame:
    """drop(id), rewrite(id, new_question, new_reference), recategorize(id, new_category).

    Dropped ids go; rewritten questions take what isn't null and a new source; the rest is kept. An
    id that no question has is an error, raised when the result is computed.
    """
    named = drop.select("id").union(rewrite.select("id")).union(recategorize.select("id")).distinct()
    unknown = named.join(questions.select("id"), "id", "left_anti")
    wrong = unknown.agg(F.sort_array(F.collect_set(F.col("id").cast("string"))).alias("ids_"))  # at most as many as a curation file names
    decided = questions.join(drop.select("id").distinct().withColumn("dropped_", F.lit(True)), "id", "left")
    joined = decided.join(rewrite.withColumn("rewritten_", F.lit(True)), "id", "left").join(recategorize, "id", "left").crossJoin(F.broadcast(wrong))  # one row
    told = F.concat(F.lit("the curation names unknown ids: "), F.array_join(F.slice("ids_", 1, 20), ", "))
    checked = joined.where(F.when(F.size("ids_") > 0, F.raise_error(told).cast("boolean")).otherwise(F.col("dropped_").isNull()))
    changed = {
        "question": F.coalesce("new_question", "question"),
        "reference_answer": F.coalesce("new_reference", "reference_answer"),
        "source": F.when(F.col("rewritten_"), "llm_draft+human_edit").otherwise(F.col("source")),
        "category": F.coalesce("new_category", "category"),
    }
    return checked.select(*[changed.get(c, F.col(c)).alias(c) for c in questions.columns])


def unknown_ids(questions: DataFrame, *sections: DataFrame) -> DataFrame:
    """Ids that a curation names and no question has."""
    named = sections[0].select("id")
    for s in sections[1:]:
        named = named.union(s.select("id"))
    return named.distinct().join(questions.select("id"), "id", "left_anti")


def finalize(drafts: DataFrame, curation: dict[str, DataFrame], seed: int = 11) -> DataFrame:
    """Curated drafts with their splits and final ids: what is written as the question set."""
    return assign_splits(apply_curation(drafts, curation["drop"], curation["rewrite"], curation["recategorize"]), seed)
