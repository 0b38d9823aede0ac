"""Quotation linking: replies are joined to the messages they quote.

Each message is parsed into its own text and the passages it quotes at nested levels. Passages are
normalised and hashed; a passage's original is the earliest message of the conversation whose own
text holds it, else the earliest of the others, found by an aggregation on the hash, so a line that
everyone quotes makes no more rows than quotes. Threads are followed by pointer doubling, which
finds cycles, too; the sizes of the subtrees that it adds up on the way give every message its
position in its conversation's reply order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, running_sums

_MARK = re.compile(r"[ \t]*(?:>[ \t]?)+")
#: The line before a quotation that names its author.
_ATTRIBUTION = re.compile(r"\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*", re.IGNORECASE)
#: Characters of the shortest passage linked across conversations; within one, any length is.
SHORTEST = 8


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, passage)]): a passage is a run of lines at one quote level, markers removed.

    A line that names the quotation's author, right before it, belongs to neither.
    """
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    last = 0
    for line in re.split(r"\r\n|\r|\n", text or ""):
        mark = _MARK.match(line)
        level = mark[0].count(">") if mark else 0
        if not level:
            own.append(line)
        else:
            if not last and own and _ATTRIBUTION.fullmatch(own[-1]):
                own.pop()
            content = line[mark.end() :]
            if level == last:
                runs[-1][1].append(content)
            else:
                runs.append((level, [content]))
        last = level
    return "\n".join(own).strip("\n"), [(level, "\n".join(lines)) for level, lines in runs]


def normalise(passage: str) -> str:
    return " ".join(passage.split()).casefold()


def units(passage: str) -> list[tuple[int, int]]:
    """(hash, length) of the passage, its paragraphs and its lines, all normalised; empty ones left out."""
    parts = [passage, *re.split(r"\n\s*\n", passage), *passage.split("\n")]
    found = {n for n in map(normalise, parts) if n}
    return sorted((xxhash.xxh64_intdigest(n.encode("utf-8", "replace")) - (1 << 63), len(n)) for n in found)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit = pa.list_(pa.struct([("hash", pa.int64()), ("length", pa.int64())]))
    quote = pa.list_(pa.struct([("level", pa.int64()), ("hash", pa.int64()), ("length", pa.int64())]))
    for batch in batches:
        bodies, own, quoted, n = [], [], [], []
        for text in batch.column("text").to_pylist():
            body, passages = parse(text)
            bodies.append(body)
            own.append([{"hash": h, "length": k} for h, k in units(body)])
            quoted.append([{"level": level, "hash": h, "length": k} for level, p in passages for h, k in units(p)])
            n.append(len(passages))
        columns = [pa.array(bodies, pa.string()), pa.array(own, unit), pa.array(quoted, quote), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "turn", "role")] + columns, ["conv_id", "turn", "role", "text", "own", "quoted", "n_quotes"])


def _originals(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """quoted with to_conv, to_turn: the earliest message that holds the passage, of the same conversation if one is earlier."""
    near = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("near_turn"), F.max("length").alias("own_length"))
    # A conversation's own place may be the quotation or later, so two conversations are kept.
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))
    firsts = near.where(F.col("own_length") >= SHORTEST).withColumn("nth", nth).where("nth <= 2")
    place = F.struct("conv_id", "near_turn")
    far = firsts.groupBy("hash").agg(F.min(F.when(F.col("nth") == 1, place)).alias("first"), F.min(F.when(F.col("nth") == 2, place)).alias("second"))
    here = F.col("near_turn") < F.col("turn")
    away = F.when(F.col("first.conv_id") == F.col("conv_id"), F.col("second")).otherwise(F.col("first"))
    joined = quoted.join(near.drop("own_length"), ["conv_id", "hash"], "left").join(far, "hash", "left").withColumn("away", away)
    return joined.select(
        "conv_id", "turn", "level", "length",
        F.when(here, F.col("conv_id")).otherwise(F.col("away.conv_id")).alias("to_conv"),
        F.when(here, F.col("near_turn")).otherwise(F.col("away.near_turn")).alias("to_turn"),
    ).where("to_turn is not null")


_NODE = ("conv_id", "turn")


def _threads(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links(conv_id, turn, to_conv, to_turn) -> (the links without those that close a cycle; for each of them its thread).

    Threads are conv_id, turn, thread_conv, thread_turn, depth, size, by pointer doubling; size is the
    number of messages at and below one. The earliest message of a cycle is a root and has no row.
    ``low`` is the earliest of the ancestors passed: a message that is its own is the earliest of its
    cycle.
    """
    start = links.select(
        *_NODE, F.col("to_conv").alias("thread_conv"), F.col("to_turn").alias("thread_turn"), F.lit(1).cast("bigint").alias("depth"),
        F.struct(F.col("to_conv").alias("conv_id"), F.col("to_turn").alias("turn")).alias("low"), F.lit(1).cast("bigint").alias("size"), F.lit(True).alias("moved"),
    )
    now, before, steps = materialise(start, "threads"), None, 1
    while True:
        up = now.select(F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread_turn"), F.col("thread_conv").alias("c"), F.col("thread_turn").alias("t"), F.col("depth").alias("d"), F.col("low").alias("l"))
        # Whoever still moves stands just below the reach of its pointer's sums and brings its own.
        below = now.where("moved").groupBy(F.col("thread_conv").alias("conv_id"), F.col("thread_turn").alias("turn")).agg(F.sum("size").alias("more"))
        joined = now.join(up, ["thread_conv", "thread_turn"], "left").join(below, [*_NODE], "left").select(
            *_NODE, F.coalesce("c", "thread_conv").alias("thread_conv"), F.coalesce("t", "thread_turn").alias("thread_turn"),
            (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.least("low", "l").alias("low"),
            (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.col("c").isNotNull().alias("moved"),
        )
        nxt = materialise(joined, "threads")
        moving = nxt.where("moved").count()
        discard(now)
        now, steps = nxt, 2 * steps
        if not moving:
            return links, now.drop("moved", "low")
        # Paths that end do so at every length up to the longest: where none ended, all that move lead to cycles, none longer than they are many.
        if moving == before and steps >= moving:
            roots = now.where("moved and low.conv_id = conv_id and low.turn = turn").select(*_NODE)
            left = materialise(links.join(roots, [*_NODE], "left_anti"), "links")
            discard(now)
            return _threads(left)
        before = moving


def _positions(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """links without cycles, sizes(conv_id, turn, size) -> (conv_id, turn, position): the place in the thread, its root at 0.

    A message stands right after its parent and the whole subtrees of its earlier siblings, so its
    position is the sum of these steps along its ancestors, added up by pointer doubling.
    """
    sized = links.join(sizes.select(*_NODE, "size"), [*_NODE])
    stepped = running_sums(sized, ["to_conv", "to_turn"], [*_NODE], "size", "earlier")
    start = stepped.select(*_NODE, F.col("to_conv").alias("c"), F.col("to_turn").alias("t"), (F.col("earlier") + 1).alias("position"))
    now = materialise(start, "positions")
    while True:
        up = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("c").alias("up_c"), F.col("t").alias("up_t"), F.col("position").alias("more"))
        joined = now.join(up, ["c", "t"], "left").select(*_NODE, F.col("up_c").alias("c"), F.col("up_t").alias("t"), (F.col("position") + F.coalesce("more", F.lit(0))).alias("position"))
        nxt = materialise(joined, "positions")
        discard(now)
        now = nxt
        if now.where("c is not null").isEmpty():
            return now.select(*_NODE, "position")


def link_quotations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotes), n_quotes, parent_conv, parent_turn, thread_conv, thread_turn, depth, position.

    The parent is the original of the outermost quoted level that has one, the one with most quoted
    characters, then the latest, conversations of larger id after all others. A thread's messages in
    the order of position (``in_reply_order``) are the conversation without quotes: a root at 0, each
    message after its parent, a reply's own replies before the next reply, siblings by conv_id and
    turn. A message without a found original is the root of its own thread (depth and position 0,
    null parent). A link leads to an earlier turn of the conversation, whatever the passage's length,
    or to another conversation, if the passage has 8 characters at least. Where links go round, the
    earliest message of the cycle keeps its parent but is the root of the thread (depth 0). Null text
    counts as empty; a message with a null conv_id or turn is linked with nothing; rows that repeat
    (conv_id, turn) share their links and place. An empty table gives an empty one; other columns
    don't matter. A message is parsed whole, in memory of some times its own size.
    """
    plain = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    schema = (
        "conv_id bigint, turn bigint, role string, text string, own array<struct<hash:bigint,length:bigint>>, "
        "quoted array<struct<level:bigint,hash:bigint,length:bigint>>, n_quotes bigint"
    )
    parsed = materialise(plain.mapInArrow(_parse, schema), "messages")
    own = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.inline("own"))
    quoted = parsed.where("n_quotes > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.inline("quoted")).distinct()
    votes = _originals(own, quoted).groupBy("conv_id", "turn", "level", "to_conv", "to_turn").agg(F.sum("length").alias("votes"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "votes", F.col("to_conv") <= F.col("conv_id"), "to_conv", "to_turn")).alias("best"))
    links = materialise(best.select("conv_id", "turn", "best.to_conv", "best.to_turn"), "links")
    forest, threads = _threads(links)
    placed = links.join(threads.drop("size"), [*_NODE], "left").join(_positions(forest, threads), [*_NODE], "left")
    return parsed.join(placed, [*_NODE], "left").select(
        "conv_id", "turn", "role", "text", "n_quotes",
        F.col("to_conv").alias("parent_conv"), F.col("to_turn").alias("parent_turn"),
        F.coalesce("thread_conv", "conv_id").alias("thread_conv"), F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("position", F.lit(0)).alias("position"),
    )


def in_reply_order(linked: DataFrame) -> DataFrame:
    """Rows of ``link_quotations`` thread by thread in reply order; a range sort, so a long thread may fill several partitions."""
    return linked.orderBy("thread_conv", "thread_turn", "position", *_NODE)
