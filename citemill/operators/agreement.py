"""Agreement of two raters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cohens_kappa(ratings: DataFrame) -> DataFrame:
    """ratings(a, b) -> one row: n, agreement, kappa. Rows without both ratings are left out; no rows give no row.

    Only counts of category pairs are brought together, so the rows' number doesn't matter.
    """
    cells = ratings.where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("c"))
    whole = cells.agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("c"))), F.lit(0)).alias("same")).where("n > 0")
    left = cells.groupBy(F.col("a").alias("cat")).agg(F.sum("c").alias("ca"))
    right = cells.groupBy(F.col("b").alias("cat")).agg(F.sum("c").alias("cb"))
    chance = left.join(right, "cat").agg(F.coalesce(F.sum(F.col("ca").cast("double") * F.col("cb")), F.lit(0.0)).alias("products"))
    p_o, p_e = F.col("same") / F.col("n"), F.col("products") / F.col("n") / F.col("n")
    kappa = F.when(p_e == 1.0, 1.0).otherwise((p_o - p_e) / (1 - p_e))
    return whole.crossJoin(chance).select("n", F.round(p_o, 6).alias("agreement"), F.round(kappa, 6).alias("kappa"))  # one row by one row


def disagreements(sheet: DataFrame, records: DataFrame) -> DataFrame:
    """sheet(config, qid, human), records(config, qid, judge) -> the graded items on which they differ."""
    return sheet.where("human is not null").join(records, ["config", "qid"]).where("human <> judge")


def parse_sheet(pages: DataFrame) -> DataFrame:
    """pages(text): filled review sheets -> (config, qid, human); blank grades are null."""
    heads = r"(?m)^### (\S+) / (\S+)\s*$"
    blocks = F.explode(F.slice(F.split("text", r"(?m)^(?=### )"), 1, 1_000_000)).alias("block")
    cut = pages.select(blocks).where(F.rlike("block", F.lit(heads)))
    grade = F.regexp_extract("block", r"(?i)Your grade[^:\n]*:\**[ \t]*([0-2])", 1)
    return cut.select(F.regexp_extract("block", heads, 1).alias("config"), F.regexp_extract("block", heads, 2).alias("qid"), grade.try_cast("int").alias("human"))
