"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents, in hash order, form a stream of words cut into blocks of ``block_words``.
Slot i of the schedule is the golden-ratio point frac(i * phi); the source on whose stretch of the
cumulative weights it falls takes the slot, and its r-th slot takes its r-th block (after the last
block a second pass begins). Joining slots with blocks gives the mix. Running sums, over slots as
over documents, go by bounded buckets, so no source's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, running_sums

PHI = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"
#: Slots ranked together, from LEAST_SLOTS up: a source has no more than some thousands of such groups.
LEAST_SLOTS, SLOT_GROUPS = 1024, 4096
#: Cells of [0, 1) by which a point finds its source.
CELLS = 1024


def word_count(text: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, share: float, limit: float, weights: tuple) -> DataFrame:
    """sizes(source, size) -> one row per source: src, source, source_size, target, low, high.

    Targets share ``share`` of all words by weight; one above ``limit`` times its source's size stops
    there and the excess goes to the rest by weight. With sources in order of cap over weight, those
    up to some point stop at their caps and the rest divide what remains. low and high bound the
    source's stretch of [0, 1). Sources are few (the mix's own table), so these windows are small.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = by_source.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    capped = named.withColumn("w", weight).withColumn("cap", limit * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    every = Window.partitionBy()
    filled = (
        capped.withColumn("words", share * F.sum("source_size").over(every))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("words") - F.col("caps_before")) / F.col("w_left"))
        .withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
        .withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "src", "level"))).over(every)["level"])
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("w"), F.col("cap"))))
    )
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    total = F.greatest(F.sum("target").over(every), F.lit(1e-300))
    return filled.withColumn("high", F.sum("target").over(upto) / total).withColumn(
        "low", F.coalesce(F.lag("high").over(Window.orderBy("src")), F.lit(0.0))
    ).select("src", "source", "source_size", "target", "low", "high")


def streams(docs: DataFrame, sources: DataFrame, carry: tuple = ()) -> DataFrame:
    """docs(doc_id, source, size, row_id) -> doc_id, src, size, source_size, target, at: at is the word of its source's stream where the document starts.

    The order is that of md5(doc_id); rows that share a doc_id follow each other by size.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = docs.join(sources, docs.source.eqNullSafe(sources.source)).select(
        "doc_id", *[c for c in carry if c != "row_id"], "row_id", "size", "src", "source_size", "target", key.alias("key"),
    )
    return running_sums(placed, ["src"], ["key", "doc_id", "size", "row_id"], "size", "at").drop("key")


def schedule(sources: DataFrame, slots: int, block_words: int) -> DataFrame:
    """-> slot, src, rank: the golden-ratio slots that sources still need, and after them what it left short."""
    spark = sources.sparkSession
    goal = F.round("target")
    passes = F.floor(goal / F.col("source_size"))
    blocks = F.ceil(F.col("source_size") / block_words)
    need = passes * blocks + F.ceil((goal - passes * F.col("source_size")) / block_words)
    bounds = sources.where("target >= 0.5").select("src", "low", "high", need.alias("need"))
    # A point finds its stretch by an equi-join on its cell of [0, 1); a stretch lists the cells it meets.
    cells = F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))
    stretches = bounds.withColumn("cell", F.explode(cells))
    point = F.col("id") * PHI
    point = point - F.floor(point)
    by_point = spark.range(slots).select(F.col("id").alias("slot"), point.alias("x"))
    by_point = by_point.withColumn("cell", F.floor(F.col("x") * CELLS))
    taken = by_point.join(stretches, "cell").where("x >= low and x < high")
    together = max(LEAST_SLOTS, slots // SLOT_GROUPS)
    taken = taken.select("slot", "src", "need", F.floor(F.col("slot") / together).alias("chunk"))
    counts = taken.groupBy("src", "chunk").count()
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("src", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("src", "chunk").orderBy("slot")
    ranked = taken.withColumn("nth", F.row_number().over(within) - 1).join(base, ["src", "chunk"]).select(
        "slot", "src", (F.col("base") + F.col("nth")).alias("rank"), "need"
    ).where("rank < need").select("slot", "src", "rank")
    got = counts.groupBy("src").agg(F.sum("count").alias("got"))
    short = bounds.join(got, "src", "left").select("src", F.coalesce("got", F.lit(0)).alias("got"), "need").where("got < need")
    rest = short.select("src", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
    return ranked.union(rest.select((F.lit(slots) + F.col("rank")).alias("slot"), "src", "rank"))


def mix_pieces(
    docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple = (3, 1, 2), block_words: int = 1024,
    carry: tuple = (),
) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, source, text) -> (documents, pieces).

    documents: doc_id, ``carry``, src, size, source_size, target, at, one row per input row. pieces: src, at,
    slot, pass, from_word, words: what each slot of the mix takes of the document at that place.
    Null text has size 0; null sources form the last source; a document without words has no piece.
    Equal rows are interchangeable and both take part. An empty table gives empty ones.
    """
    ids = () if "row_id" in carry else (F.monotonically_increasing_id().alias("row_id"),)
    sized = materialise(docs.select("doc_id", *carry, *ids, "source", word_count().alias("size")), "sizes")
    sources = materialise(source_targets(sized, share, limit, weights), "sources")
    words = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]  # one number, to set the count of slots
    placed = materialise(streams(sized, sources, carry), "streams")
    slots = int(share * words / block_words * 1.02) + 64
    plan = schedule(sources, slots, block_words).join(
        sources.select("src", "source_size", F.round("target").cast("long").alias("goal")), "src"
    )
    blocks = F.ceil(F.col("source_size") / block_words)
    # The r-th slot of a source is its block r mod blocks in pass r div blocks; what a source takes in
    # all is cut at its target, within a pass.
    plan = plan.withColumn("pass", F.floor(F.col("rank") / blocks)).withColumn("block", F.col("rank") % blocks)
    plan = plan.withColumn("until", F.col("goal") - F.col("pass") * F.col("source_size")).select("src", "block", "slot", "pass", "until")
    ends = F.col("at") + F.col("size")
    parts = placed.where("size > 0").select(
        "src", "at", "size",
        F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((ends - 1) / block_words))).alias("block"),
    )
    low = F.greatest("at", F.col("block") * block_words)
    high = F.least(ends, (F.col("block") + 1) * block_words, F.col("until"))
    pieces = parts.join(plan, ["src", "block"]).select(
        "src", "at", "slot", "pass", (low - F.col("at")).alias("from_word"), (high - low).alias("words")
    ).where("words > 0")
    return placed, pieces


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_slot.

    taken counts the words that the mix takes, repeats counted; first_slot is the slot in which the
    document first comes, the order of the mix (null where nothing is taken).
    """
    placed, pieces = mix_pieces(docs, **options)
    sums = pieces.groupBy("src", "at").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot")).withColumn("filled", F.lit(True))
    keyed = placed.withColumn("filled", F.col("size") > 0)
    return keyed.join(sums, ["src", "at", "filled"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot"
    )


def mix(docs: DataFrame, slot_column: str | None = None, **options) -> DataFrame:
    """The mix itself as rows of ``docs``: a document once for each pass that takes it.

    Where a pass ends within a document, its row holds the words up to there, parted by spaces, and
    n_chars (if there is such a column) their length. Documents the mix leaves out don't appear.
    ``slot_column`` names an added column with the row's first slot: sorted by it, every prefix of the
    mix holds its sources near their weights.
    """
    own = docs.columns
    rows = materialise(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.monotonically_increasing_id().alias("row_id")), "rows"
    )
    narrow = rows.select("row_id", "row.doc_id", "row.source", "row.text")
    placed, pieces = mix_pieces(narrow, carry=("row_id",), **options)
    passes = pieces.groupBy("src", "at", "pass").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"))
    chosen = passes.join(placed.where("size > 0").select("src", "at", "row_id", "size"), ["src", "at"])
    out = rows.join(chosen.select("row_id", "taken", "size", "slot"), "row_id")
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), 0)
    part = F.array_join(F.slice(words, 1, F.col("taken").cast("int")), " ")
    out = out.withColumn("text_", F.when(F.col("taken") < F.col("size"), part).otherwise(F.col("row.text")))
    columns = {"text": F.col("text_"), "n_chars": F.when(F.col("taken") < F.col("size"), F.length("text_").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in own else None}
    slot = [F.col("slot").alias(slot_column)] if slot_column else []
    return out.select(*[(columns[c] if c in columns else F.col(f"row.`{c}`")).alias(c) for c in own], *slot)
