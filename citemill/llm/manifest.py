"""A Merkle manifest of a dataset, in DataFrame operations only.

Every row is a leaf; a group's leaves in order, eight to a parent, give its subroot, and the subroots in
order give the root. A level of the tree is cut into aligned blocks of BLOCK nodes, and a block keeps each
of its levels as one string of hex digits, so that parents are hashes of substrings of fixed width and a
node's siblings are the substrings left and right of it in its run. A block's topmost node is a node of
the next, BLOCK times smaller, tree, which is built in the same way; proofs come down from the root, each
block adding its own levels to the segments of the node above it.

Nodes are shuffled, never texts. A block is a bounded group, however large the group it is part of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, running_sums

ARITY = 8
#: Levels that a block holds, and its nodes: a power of the arity, so that no run crosses a block.
BLOCK_LEVELS = 3
BLOCK = ARITY**BLOCK_LEVELS
#: Hex digits of a node.
WIDTH = 64
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose checksum this divides are tampered with.
TAMPERED_EVERY = 3


def field(value: Column) -> Column:
    """A value's part of a leaf: its length in bytes, a colon and itself; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields, some of them ``changed``."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256)


def _bytes(digest: Column) -> Column:
    return F.unhex(digest)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _runs(level: Column) -> Column:
    """A level's runs of siblings, as strings; levels are held as bytes, in which a substring costs no search."""
    step = ARITY * WIDTH
    return F.transform(F.sequence(F.lit(1), F.length(level), F.lit(step)), lambda at: F.substring(level, at, F.lit(step)))


def _parents(level: Column) -> Column:
    return F.array_join(F.transform(_runs(level), lambda run: F.sha2(run, 256)), "").cast("binary")


def blocks(nodes: DataFrame) -> DataFrame:
    """nodes(g, pos, node, ...) -> (g, block, rows, level0 to level2, top).

    ``rows`` has the nodes' other columns in order. A level that no parents are made of is null: those
    above the last node of a group that fits in one block.
    """
    more = [c for c in nodes.columns if c not in ("g", "pos", "node")]
    at = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("row", F.struct("pos", "node", *more))
    last = F.max("pos").alias("last")
    found = at.groupBy("g", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"), last)
    whole = nodes.groupBy("g").agg(last.alias("end"))
    # One row a group: joined to block 0 only, since later blocks tell by their number that there are several.
    found = found.join(whole.select(F.col("g").alias("g0"), (F.col("end") >= BLOCK).alias("several"), F.lit(0).cast("bigint").alias("b0")),
                       F.col("g").eqNullSafe(F.col("g0")) & (F.col("block") == F.col("b0")), "left")
    several = F.coalesce("several", F.lit(True))
    found = found.withColumn("level0", F.array_join(F.transform("rows", lambda r: _hex(r["node"])), "").cast("binary"))
    for k in range(BLOCK_LEVELS):
        level = F.col(f"level{k}")
        goes_on = several | (F.length(level) > WIDTH)
        found = found.withColumn(f"level{k + 1}", F.when(goes_on, _parents(level)))
    top = F.coalesce(*[F.col(f"level{k}") for k in range(BLOCK_LEVELS, -1, -1)])
    # The topmost level is a single node: no run of siblings is made of it.
    kept = [F.when(F.col(f"level{k + 1}").isNotNull() | F.lit(k == 0), F.col(f"level{k}")).alias(f"level{k}") for k in range(BLOCK_LEVELS)]
    depth = sum(F.col(f"level{k + 1}").isNotNull().cast("int") for k in range(BLOCK_LEVELS))
    return found.select("g", "block", F.transform("rows", lambda r: r.dropFields("node")).alias("rows"), *kept, depth.alias("depth"), _bytes(top.cast("string")).alias("top"))


def _segments(block: DataFrame, i: Column) -> Column:
    """What stands left and right of node ``i`` (its place in the block) in its run, at each of the block's levels."""
    out = []
    for k in range(BLOCK_LEVELS):
        below = ARITY**k
        run = F.substring(F.col(f"level{k}"), F.floor(i / (below * ARITY)).cast("int") * ARITY * WIDTH + 1, F.lit(ARITY * WIDTH))
        place = F.pmod(F.floor(i / below).cast("int"), F.lit(ARITY)) * WIDTH
        out.append(F.struct(F.substring(run, F.lit(1), place).alias("left"), F.substring(run, place + WIDTH + 1, F.lit(ARITY * WIDTH)).alias("right")))
    return F.slice(F.array(*out), F.lit(1), F.col("depth"))


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes(g, pos, node, ...) -> (the blocks of each height, lowest first; the groups' tops (g, node))."""
    heights = []
    while True:
        made = materialise(blocks(nodes), "blocks")
        heights.append(made)
        if not made.where("block > 0").head(1):
            return heights, made.select("g", F.col("top").alias("node"))
        nodes = made.select("g", F.col("block").alias("pos"), F.col("top").alias("node"))


def _expand(block: DataFrame, above: DataFrame) -> DataFrame:
    """blocks and above(g, pos, segments, subroot, root), a row for each block -> a row for each of their nodes."""
    joined = block.join(above.withColumnsRenamed({"g": "g0", "pos": "pos0"}), F.col("g").eqNullSafe(F.col("g0")) & (F.col("block") == F.col("pos0")))
    leaf0 = lambda i: F.substring(F.col("level0"), i * WIDTH + 1, F.lit(WIDTH))
    each = F.transform("rows", lambda r, i: F.struct(r.alias("row"), leaf0(i).alias("node"), F.concat(_segments(block, i), F.col("segments")).alias("segments")))
    return joined.select("g", "subroot", "root", F.inline(each)).select("g", "row.*", "node", "segments", "subroot", "root")


def descend(heights: list[DataFrame], above: DataFrame) -> DataFrame:
    """From (g, pos, segments, subroot, root) of the tops to the same, and the node, of the lowest nodes."""
    for made in reversed(heights):
        above = _expand(made, above)
        if made is not heights[0]:
            above = materialise(above.select("g", "pos", "segments", "subroot", "root"), "segments")
    return above


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``: how many rows of the group stand before, whatever the group's size."""
    return running_sums(rows.withColumn("one_", F.lit(1).cast("bigint")), [group], order, "one_", "pos").drop("one_")


def _leaves(docs: DataFrame) -> DataFrame:
    """(g, node, doc_id, tampered): leaves as bytes, keys that sort as their languages do, null first."""
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED_EVERY)) == 0
    lowered = F.when(F.col("text").isNotNull(), lower_ascii(F.col("text")))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("g"), "doc_id",
        _bytes(leaf()).alias("node"), F.when(chosen, _bytes(leaf(text=lowered))).alias("tampered"),
    )


def _trees(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """(the languages' blocks, the blocks over their subroots, (g, node) of the root)."""
    leaves = ranked(materialise(_leaves(docs), "leaves"), "g", ["doc_id", "node"])
    heights, subroots = tree(leaves.select("g", "pos", "node", "doc_id", "tampered"))
    # The languages' subroots are the leaves of one more tree.
    langs = ranked(subroots.withColumn("all_", F.lit(0)), "all_", ["g"])
    lang_heights, top = tree(langs.select(F.col("all_").alias("g"), "pos", "node", F.col("g").alias("lang_key")))
    return heights, lang_heights, top


def head(docs: DataFrame) -> DataFrame:
    """The manifest without proofs: one row (root), none for an empty table."""
    return _trees(docs)[2].select(_hex(F.col("node")).alias("root"))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A row is a leaf; a language's leaves ascend by doc_id (rows without one first; rows that share one by
    their leaf) and give its subroot; subroots by language (null first, then by bytes) give root. A group
    of one leaf is its own subroot, one language's subroot is the root. proof_sha256 is the digest of a
    leaf's siblings from its run up to the root. folded_root is computed from the siblings and the row
    read again: where the checksum of doc_id is divisible by three, its text with A-Z in lower case
    (nulls stay; a row without doc_id isn't touched). Null and empty values are told apart. An empty
    table gives an empty one. Only FIELDS are read; other columns may have any names.
    """
    heights, lang_heights, top = _trees(docs)
    start = top.select(
        "g", F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<struct<left:binary,right:binary>>").alias("segments"),
        F.lit(None).cast("string").alias("subroot"), _hex(F.col("node")).alias("root"),
    )
    above = descend(lang_heights, start).select(
        F.col("lang_key").alias("g"), F.lit(0).cast("bigint").alias("pos"), "segments", F.col("node").cast("string").alias("subroot"), "root"
    )
    found = descend(heights, materialise(above, "languages"))
    begin = F.coalesce(_hex(F.col("tampered")).cast("binary"), F.col("node"))
    folded = F.aggregate("segments", begin, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256).cast("binary")).cast("string")
    siblings = F.aggregate("segments", F.lit("").cast("binary"), lambda all_, s: F.concat(all_, s["left"], s["right"]))
    out = found.select("doc_id", F.col("node").cast("string").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
