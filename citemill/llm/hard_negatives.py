"""Hard negatives by coordinate pruning of inner products (after LEMP, Teflioudi et al., 2015).

Rows are sorted by length and cut into buckets. A bucket holds, for each coordinate, its rows sorted by
their value there (of the row scaled to length 1). An anchor that needs an inner product of t can skip a
bucket whose longest row is too short. In the others t bounds the angle to a row, and so the range of
values that a row can have in any one coordinate: the ranges in the anchor's few largest coordinates, its
focus, are looked up in the sorted lists, and only rows that lie in all of them are multiplied out.

t grows as a task goes through its buckets: first the score of the anchor's last positive so far, then,
of the bands below its positives, the least score that can still enter. Scores are exact integers.

Anchors are a stated query set. They go to the executors in blocks of bounded size, one at a time, and a
block's results are written before the next is read; a task's state is a few rows for an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, stored

POSITIVES, NEGATIVES = 5, 3
#: A negative's score as a percentage of the positive's.
LOW, HIGH = 50, 95
#: Rows of a bucket at most; a shorter row or another label begins a new one from LEAST_ROWS on.
BUCKET_ROWS, LEAST_ROWS = 2048, 256
#: A row shorter than this share of a bucket's longest begins a new one.
LENGTHS = 0.9
#: Coordinates of an anchor whose ranges are looked up.
FOCUS = 4
#: Anchors of a block: at most so many, and bytes of their vectors.
BLOCK_ANCHORS, BLOCK_BYTES = 4096, 32 << 20
#: Anchors whose products with a bucket are held at once.
SLICE = 512
#: Beyond this, sums of products might not be exact in doubles and are taken in Python's integers.
_EXACT = 2.0**53
_LONG = 2**63 - 1


# ---- index ----


def _cuts(dims: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> list[int]:
    """Where buckets end, for rows in the index's order."""
    out, first = [], 0
    for i in range(1, len(dims)):
        n = i - first
        apart = labels[i] != labels[first] or lengths[i] < LENGTHS * lengths[first]
        if dims[i] != dims[first] or n == BUCKET_ROWS or n >= LEAST_ROWS and apart:
            out.append(i)
            first = i
    return [*out, len(dims)] if len(dims) else []


def _lengths(rows: np.ndarray) -> np.ndarray:
    """Lengths, without squares beyond the range of doubles."""
    if not rows.shape[1]:
        return np.zeros(len(rows))
    most = np.abs(rows).max(1, keepdims=True)
    scale = np.where(most > 0, most, 1)
    return (scale * np.linalg.norm(rows / scale, axis=1, keepdims=True))[:, 0]


def _unit(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return rows / np.where(lengths > 0, lengths, 1)[:, None]


_INDEX = "dim int, n int, kind string, rows binary, lists binary, labels binary, ids binary, uids binary"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in ("rows", "lists", "labels", "ids", "uids"))])
    for batch in batches:
        flat, dims = batch.column("q").flatten().to_numpy(zero_copy_only=False), batch.column("dim").to_numpy()
        ends = np.concatenate(([0], np.cumsum(dims)))
        columns = {c: batch.column(c).to_numpy().astype(np.int64) for c in ("label", "vec_id", "uid")}
        a = 0
        for b in _cuts(dims, columns["label"], batch.column("length").to_numpy()):
            rows = flat[ends[a] : ends[b]].reshape(b - a, dims[a])
            most = np.abs(rows).max(initial=0)
            kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
            lists = np.argsort(_unit(rows, _lengths(rows)), axis=0, kind="stable").T.astype("<u2")
            made = [int(dims[a]), b - a, kind, rows.astype(kind).tobytes(), lists.tobytes(), *(columns[c][a:b].tobytes() for c in ("label", "vec_id", "uid"))]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, schema.types)], schema=schema)
            a = b


def index(rows: DataFrame) -> DataFrame:
    """rows(uid, vec_id, label, q) -> buckets, one row each, written to the shared folder.

    Ranges are cut by vector size, label, length and a hash, so that no task gets all rows of a hot
    label or all copies of one vector.
    """
    n = rows.count()
    parts = max(1, min(n // BUCKET_ROWS, 256), n >> 18)
    squares = F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)
    wide = rows.withColumn("dim", F.size("q")).withColumn("length", F.sqrt(squares))
    order = ["dim", "label", F.col("length").desc(), F.xxhash64("uid")]
    return materialise(wide.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_indexed, _INDEX), "buckets")


class Bucket:
    def __init__(self, row: dict):
        shape = (row["n"], row["dim"])
        self.rows = np.frombuffer(row["rows"], row["kind"]).reshape(shape).astype(np.float64)
        self.labels, self.ids, self.uids = (np.frombuffer(row[c], np.int64) for c in ("labels", "ids", "uids"))
        self.lengths = _lengths(self.rows)
        self.longest, self.most = self.lengths.max(initial=0), np.abs(self.rows).max(initial=0)
        self.unit = _unit(self.rows, self.lengths)
        self.lists = np.frombuffer(row["lists"], "<u2").reshape(shape[::-1])
        self.values = np.take_along_axis(self.unit.T, self.lists.astype(np.int64), 1)

    def products(self, anchors: np.ndarray, chosen=slice(None)) -> np.ndarray:
        """Exact inner products; those that no long can hold are told as the nearest one."""
        rows = self.rows[chosen]
        if rows.shape[1] * self.most * np.abs(anchors).max(initial=0) < _EXACT:
            return (anchors @ rows.T).astype(np.int64)
        whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
        return np.clip(whole(anchors) @ whole(rows).T, -_LONG, _LONG).astype(np.int64)

    def feasible(self, unit: np.ndarray, focus: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and focus coordinate the part of its sorted list that rows can lie in, at a cosine of ``need``."""
        own = np.take_along_axis(unit, focus, 1)
        angle, off = np.arccos(np.clip(own, -1, 1)), np.arccos(np.clip(need, -1, 1))[:, None]
        low, high = np.cos(np.minimum(angle + off, np.pi)) - 1e-9, np.cos(np.maximum(angle - off, 0)) + 1e-9
        first, last = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            first[at] = np.searchsorted(self.values[f], low[at], "left")
            last[at] = np.searchsorted(self.values[f], high[at], "right")
        return first, last

    def candidates(self, focus: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rows in all of one anchor's ranges, the narrowest list first."""
        order = np.argsort(last - first)
        rows = self.lists[focus[order[0]], first[order[0]] : last[order[0]]].astype(np.int64)
        for i in order[1:]:
            if not len(rows):
                break
            if last[i] - first[i] < len(self.rows):
                values, x = self.values[focus[i]], self.unit[rows, focus[i]]
                rows = rows[(x >= values[first[i]]) & (x <= values[last[i] - 1])] if last[i] > first[i] else rows[:0]
        return rows


# ---- search ----


class Anchors:
    """A block's anchors of one vector size."""

    def __init__(self, rows: list):
        self.uids, self.ids, self.labels = (np.array([r[c] for r in rows], np.int64) for c in ("uid", "vec_id", "label"))
        self.q = np.array([r["q"] for r in rows], np.float64).reshape(len(rows), -1)
        self.lengths = _lengths(self.q)
        self.unit = _unit(self.q, self.lengths)
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]


class Best:
    """The best ``k`` rows of each slot: score down, then vec_id, then uid."""

    def __init__(self, slots: int, k: int):
        self.k, self.kept = k, np.zeros((4, 0), np.int64)  # slot, score, id, uid
        self.last = np.full(slots, -_LONG)  # score of the k-th, once there are k

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        if not len(slot):
            return
        rows = np.concatenate((self.kept, np.stack((slot, score, ids, uids))), axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        starts = np.flatnonzero(np.diff(rows[0], prepend=-1))
        nth = np.arange(rows.shape[1]) - np.repeat(starts, np.diff(np.append(starts, rows.shape[1])))
        self.kept = rows[:, nth < self.k]
        full = rows[:, nth == self.k - 1]
        self.last[full[0]] = full[1]


def _topmost(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``fits`` holds and the score is among the row's best k or ties with the last of them."""
    busy = np.flatnonzero(fits.sum(1) > k)
    if len(busy):
        own = np.where(fits[busy], scores[busy], -_LONG)
        fits[busy] &= own >= np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k][:, None]
    return np.nonzero(fits)


def scan(bucket: Bucket, own: Anchors, same: bool, low: np.ndarray, high: np.ndarray, best: Best) -> int:
    """Takes a bucket's rows into ``best``, whose slots are (anchor, band); returns how many products it made.

    ``same`` asks for rows of the anchor's label. Row i of ``low`` and ``high`` bounds the scores of
    anchor i's bands; a band without any score has low over high.
    """
    bands, made = low.shape[1], 0
    labels = np.unique(bucket.labels)
    least = np.maximum(low, best.last.reshape(low.shape))
    least = np.where(low <= high, least, _LONG)
    need = least.min(1)  # what any of the anchor's bands can still take
    reach = own.lengths * bucket.longest * (1 + 1e-9)
    active = (low <= high).any(1) & (need <= reach)
    if same:
        active &= np.isin(own.labels, labels)
    elif len(labels) == 1:
        active &= own.labels != labels[0]
    chosen = np.flatnonzero(active)

    def take(which: np.ndarray, rows: np.ndarray | slice) -> int:
        scores = bucket.products(own.q[which], rows)
        fits = (own.labels[which][:, None] == bucket.labels[rows][None]) == same
        if same:
            fits &= own.uids[which][:, None] != bucket.uids[rows][None]
        for j in range(bands):
            a, r = _topmost(scores, fits & (scores >= least[which, j][:, None]) & (scores <= high[which, j][:, None]), best.k)
            best.add(which[a] * bands + j, scores[a, r], bucket.ids[rows][r], bucket.uids[rows][r])
        return scores.size

    # Only a bound above zero narrows the ranges; without one, or where the ranges are wide, all rows are verified at once.
    narrow = np.zeros(len(chosen), bool)
    pruned = np.flatnonzero((need[chosen] > 0) & (reach[chosen] > 0))
    if len(pruned) and own.focus.shape[1]:
        at = chosen[pruned]
        first, last = bucket.feasible(own.unit[at], own.focus[at], need[at] / reach[at])
        few = np.flatnonzero((last - first).min(1) * 2 < len(bucket.rows))
        narrow[pruned[few]] = True
        for i in few:
            rows = bucket.candidates(own.focus[at[i]], first[i], last[i])
            if len(rows):
                made += take(at[i : i + 1], rows)
    wide = chosen[~narrow]
    for a in range(0, len(wide), SLICE):
        made += take(wide[a : a + SLICE], slice(None))
    return made


def _search(block, bands, same: bool, k: int) -> Callable:
    """``block`` is a broadcast {dim: Anchors}, ``bands`` one of {dim: (low, high)} or none for any score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, best = block.value, {}
        for batch in batches:
            for i in range(batch.num_rows):  # one bucket at a time
                row = batch.slice(i, 1).to_pylist()[0]
                own = anchors.get(row["dim"])
                if own is None:
                    continue
                if bands is None:
                    low, high = np.full((len(own.ids), 1), -_LONG), np.full((len(own.ids), 1), _LONG)
                else:
                    low, high = bands.value[row["dim"]]
                scan(Bucket(row), own, same, low, high, best.setdefault(row["dim"], Best(low.size, k)))
        for dim, found in best.items():
            slot, score, ids, uids = found.kept
            columns = [np.full(len(slot), dim, np.int64), slot, score, ids, uids]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "slot", "score", "id", "uid"])

    return run


def _found(buckets: DataFrame, block, bands, same: bool, k: int) -> DataFrame:
    """(dim, slot, score, id, uid, rank): the best k of each slot over all tasks."""
    rows = buckets.mapInArrow(_search(block, bands, same, k), "dim bigint, slot bigint, score bigint, id bigint, uid bigint")
    order = Window.partitionBy("dim", "slot").orderBy(F.col("score").desc(), "id", "uid")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(anchors: DataFrame) -> Iterator[list]:
    """Anchors in lists of at most BLOCK_ANCHORS rows and about BLOCK_BYTES."""
    block, size = [], 0
    for row in anchors.toLocalIterator():
        if block and (len(block) == BLOCK_ANCHORS or size + 8 * len(row.q) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append(row)
        size += 8 * len(row.q)
    if block:
        yield block


OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """vectors(vec_id, label, q) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    q are integers, held as doubles; a score is their inner product. Anchors are the rows where ``anchor``
    holds; an anchor's positives are its ``positives`` best other rows of its label, and each positive
    gets the ``negatives`` best rows of other labels whose score is between ``low`` and ``high`` percent
    of the positive's. Equal scores go by vec_id. All three columns are without nulls. Rows that repeat a vec_id are
    rows of their own, as anchors, positives and negatives. Vectors of another size than the anchor's
    have no score with it; vectors without components and zero ones score 0. Scores that a long can't
    hold count as the nearest one that it can. No anchors, or an empty table, give an empty one.
    """
    spark = vectors.sparkSession
    rows = materialise(vectors.select("vec_id", F.col("label").cast("bigint").alias("label"), "q", anchor.alias("anchor")).withColumn("uid", F.monotonically_increasing_id()), "rows")
    buckets = index(rows.select("uid", "vec_id", "label", "q"))
    paths = []
    for block in _blocks(rows.where("anchor").select("uid", "vec_id", "label", "q")):
        by_dim: dict[int, list] = {}
        for row in block:
            by_dim.setdefault(len(row.q), []).append(row)
        own = {dim: Anchors(some) for dim, some in by_dim.items()}
        sent = spark.sparkContext.broadcast(own)
        # At most ``positives`` rows for each anchor of the block.
        near = stored(lambda: _found(buckets, sent, None, True, positives), spark, "positives").collect()  # noqa: B023
        bands, whose = {dim: (np.full((len(a.ids), positives), 1), np.full((len(a.ids), positives), 0)) for dim, a in own.items()}, []
        for r in near:
            bands[r.dim][0][r.slot, r.rank - 1] = -(-low * r.score // 100)
            bands[r.dim][1][r.slot, r.rank - 1] = high * r.score // 100
            whose.append((r.dim, r.slot * positives + r.rank - 1, int(own[r.dim].ids[r.slot]), r.id, r.score))
        limits = spark.sparkContext.broadcast(bands)
        names = spark.createDataFrame(whose, "dim bigint, slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        out = stored(
            lambda: _found(buckets, sent, limits, False, negatives).join(F.broadcast(names), ["dim", "slot"]).select(  # noqa: B023
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
            ), spark, "negatives",
        )
        paths.append(out._scratch_path)
        sent.unpersist()
        limits.unpersist()
    return spark.read.schema(OUT).parquet(*paths) if paths else spark.createDataFrame([], OUT)


def mine_hard_negatives(table: DataFrame) -> DataFrame:
    """``mine`` over embeddings(vec_id, embedding, label), with every fiftieth vec_id as an anchor.

    A component x becomes floor(256 x); where vec_id is divisible by 7 the label becomes (label + 1) % 10.
    Rows without vec_id, label or vector take no part, nor do those with a component that is null or
    not finite (also after scaling). Only these three columns are read.
    """
    plain = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * 256) < float("inf")))
    whole = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & sound)
    # A double's floor as a double: Spark's own floor gives a long, which large values don't fit.
    floor = lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)
    rows = whole.select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("x", lambda v: floor(v * 256)).alias("q"),
    )
    return mine(rows, F.col("vec_id") % 50 == 0)
