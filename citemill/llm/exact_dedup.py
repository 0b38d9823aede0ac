"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's frequent-items sketch) names digests that may be frequent; exact
counts verify them, and the few verified winners are broadcast, so that rows of a frequent text
are settled where they are read. All other digests go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialise

#: A digest is heavy if it has at least one row in HEAVY_SHARE; at most so many are broadcast.
HEAVY_SHARE = 1024
#: Entries the summary keeps for each partition; its counts err by far less than 1 / HEAVY_SHARE.
TRACKED = 16384


def digest(text: str = "text"):
    return F.sha2(lower_ascii(F.col(text)).cast("binary"), 256)


def heavy_winners(rows: DataFrame) -> DataFrame:
    """rows(text_sha256, pick) -> (text_sha256, heavy_pick, heavy_size) of digests with a verified large share.

    ``pick`` is ordered; its maximum wins. At most HEAVY_SHARE rows come back, whatever the input's size.
    """
    sketch = rows.agg(
        F.expr(f"approx_top_k(text_sha256, {HEAVY_SHARE}, {TRACKED})").alias("top"), F.count("*").alias("n")
    )
    likely = sketch.select(F.explode("top").alias("t"), "n").select(
        F.col("t.item").alias("text_sha256"), (F.col("n") / HEAVY_SHARE).alias("floor")
    ).where(F.col("t.count") >= F.greatest(F.lit(2.0), F.col("n") / (2 * HEAVY_SHARE)))
    counted = rows.join(F.broadcast(likely), "text_sha256").groupBy("text_sha256", "floor").agg(
        F.max("pick").alias("heavy_pick"), F.count("*").alias("heavy_size")
    )
    return counted.where((F.col("heavy_size") >= F.col("floor")) & (F.col("heavy_size") > 1)).drop("floor")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null text counts as empty. Of equal
    texts the row with the largest doc_id stays (a null doc_id counts as the smallest; of rows that
    repeat a doc_id exactly one stays). Only doc_id and text are read; an empty table gives an empty one.
    """
    rows = materialise(
        docs.select("doc_id", digest().alias("text_sha256"))
        .withColumn("pick", F.struct("doc_id", F.monotonically_increasing_id().alias("at"))),
        "digests",
    )
    winners = materialise(heavy_winners(rows), "winners")
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    heavy = marked.where("heavy_size is not null")
    light = marked.where("heavy_size is null").select("text_sha256", "pick")
    groups = light.groupBy("text_sha256").agg(F.max("pick").alias("heavy_pick"), F.count("*").alias("heavy_size"))
    light = light.join(groups, "text_sha256")
    return heavy.select(light.columns).union(light).select(
        F.col("pick.doc_id").alias("doc_id"),
        F.col("heavy_pick.doc_id").alias("keep_id"),
        F.col("heavy_size").alias("group_size"),
        (F.col("pick.at") == F.col("heavy_pick.at")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the row with the largest doc_id.

    Of rows that share it, one stays. Losers of heavy texts end where they are read; of the others each
    partition sends on at most one row for a text, whatever the size of the tables.
    """
    own = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("doc_id").alias("pick"), digest().alias("text_sha256"))
    rows = materialise(keyed.select("text_sha256", "pick"), "digests")
    winners = materialise(heavy_winners(rows), "winners")
    # Losers of a heavy text end here, before any shuffle.
    left = keyed.join(F.broadcast(winners), "text_sha256", "left").where(
        "heavy_size is null or pick <=> heavy_pick"
    )
    first = Window.partitionBy("text_sha256").orderBy(F.col("pick").desc_nulls_last())
    return left.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")
