"""Near-duplicate vectors by spherical-cap filters.

Filter directions form a product code: the rotated space is cut into blocks, each block has its own
random codewords, and a direction is one codeword for each block. A vector is list-decoded: sums
over blocks that can't reach the cap's height any more are dropped, and what is left are all the
directions it exceeds. Vectors are joined on filters and every pair is verified. A pair counts only
under the least filter both have, so counts need no list of pairs; of links only a spanning forest
of each group goes on to the components.

Filters are fitted to the table: vectors are seen from the mean of a bounded sample, caps hold the
number of vectors wanted of that sample, and pairs drawn at the threshold around it measure how many
would share a filter, until enough do (``fit``). A linked pair is missed if no filter holds both;
tests hold the recall from 2 to 1,024 dimensions and up to a mean cosine of 0.8. A filter
of m vectors is verified in blocks, a vector going to each pair of blocks that holds its own: with
BLOCK_ROWS in a task, all pairs of m rows can't meet with fewer than m / BLOCK_ROWS copies of a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components

THRESHOLD = 0.95
#: The share of pairs at the threshold that are to share a filter, as measured on a sample when the filters are made.
RECALL = 0.995
#: Filters a vector exceeds on average: the first of these that gives the recall.
FILTERS = (10, 14, 20, 28)
#: Filters a vector has at least, as a share of the average: where the caps give it fewer, its own are lowered.
FEWEST = 0.6
#: Vectors a filter holds, on average: the caps get higher and the filters more as the table grows.
FILTER_ROWS = 192
#: Caps grow by this factor where no number of filters gives the recall.
WIDER = 1.6
#: A filter with more vectors is split into blocks of this many, and blocks meet in pairs.
BLOCK_ROWS = 1024
#: Parts of a product code; in few dimensions a part would be a line or a plane, and directions are not products.
BLOCKS, FEW_DIMENSIONS = 2, 8
#: Vectors that the filters of a table are fitted on, and pairs drawn to measure their recall.
SAMPLE, PAIRS = 2048, 1000
SAMPLE_BYTES = 32 << 20
#: Products with codewords that are held at once.
DECODED_AT_ONCE = 1 << 21


@lru_cache(maxsize=8)
def product_code(dim: int, words: int, seed: int = 7) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rotation, unit codewords of each block)."""
    rng = np.random.default_rng(seed + dim)
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    code = []
    for part in np.array_split(np.arange(dim), 1 if dim < FEW_DIMENSIONS else BLOCKS):
        own = rng.standard_normal((words, len(part)))
        code.append(own / np.linalg.norm(own, axis=1, keepdims=True))
    return rotation, code


@dataclass(frozen=True)
class Filters:
    """Directions for vectors of one size: seen from ``centre``, since embeddings often share a direction."""

    dim: int
    words: int  # codewords of a block
    need: float  # height of the caps, as a sum over blocks
    fewest: int
    centre: np.ndarray

    @property
    def size(self) -> int:
        return self.words ** (1 if self.dim < FEW_DIMENSIONS else BLOCKS)

    def seen(self, unit: np.ndarray) -> np.ndarray:
        """Where unit vectors stand from the centre, as directions; one in the centre itself keeps its own."""
        off = unit - self.centre
        length = np.linalg.norm(off, axis=1, keepdims=True)
        return np.where(length > 1e-9, off / np.maximum(length, 1e-9), unit)

    def scores(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each block the products of the rows with its codewords."""
        rotation, code = product_code(self.dim, self.words)
        turned = self.seen(unit) @ rotation
        parts = np.array_split(np.arange(self.dim), len(code))
        return [turned[:, part] @ own.T for part, own in zip(parts, code)]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The numbers of all directions whose cap holds the row of ``unit``, ``fewest`` at least."""
        scores = self.scores(unit)
        best = [s.max(1) for s in scores]
        step = min(0.04, 0.15 * np.sqrt(len(scores) / self.dim))
        out = []
        for row in range(len(unit)):
            own, ids = self.need, np.zeros(0, np.int64)
            while len(ids) < min(self.fewest, self.size):  # a vector that few directions exceed gets lower caps of its own
                ids = _exceeding([s[row] for s in scores], [x[row] for x in best], own, self.words)
                own -= step
            out.append(ids)
        return out


def _at_cosine(unit: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each row another unit vector at that cosine, in a random direction from it."""
    side = rng.standard_normal(unit.shape)
    side = unit_rows(side - (side * unit).sum(1, keepdims=True) * unit)
    return cosine * unit + np.sqrt(1 - cosine**2) * side


def measured(filters: Filters, unit: np.ndarray, cosine: float, pairs: int = PAIRS, seed: int = 0) -> tuple[float, float]:
    """(share of pairs at ``cosine`` that share a filter, filters of a vector), on pairs drawn around rows of ``unit``."""
    rng = np.random.default_rng(seed)
    a = unit[rng.integers(0, len(unit), pairs)]
    if unit.shape[1] == 1:  # no other direction
        return 1.0, 1.0
    one, other = filters.decode(a), filters.decode(_at_cosine(a, cosine, rng))
    return float(np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(one, other)])), float(np.mean([len(x) for x in one]))


def _height(found: Filters, count: int, unit: np.ndarray) -> float:
    """The caps' height at which the rows of ``unit`` exceed ``count`` directions on average, a row counting for 16 times that at most."""
    most = 16 * count
    scores = [np.sort(s, axis=1)[:, ::-1][:, :most] for s in found.scores(unit)]  # a row's best sums are of its best codewords
    sums = scores[0] if len(scores) == 1 else (scores[0][:, :, None] + scores[1][:, None, :]).reshape(len(unit), -1)
    if sums.shape[1] > most:
        sums = np.partition(sums, sums.shape[1] - most, axis=1)[:, -most:]
    place = min(count * len(unit), sums.size) - 1
    return float(np.sort(sums.ravel())[::-1][place])


def fit(sample: np.ndarray, n: int, cosine: float, wanted: float = RECALL) -> Filters:
    """Filters for a table of n vectors of which ``sample`` (unit rows) is a part.

    The caps hold FILTER_ROWS vectors each, and wider ones are taken where pairs at ``cosine`` would
    share too few: in few dimensions, where most neighbours are links, and where all vectors have
    much of one direction. Caps as wide as everything find every pair.
    """
    dim, centre = sample.shape[1], sample.mean(0)
    blocks = 1 if dim < FEW_DIMENSIONS else BLOCKS
    some = sample[np.random.default_rng(1).permutation(len(sample))[:100]]
    share = min(0.25, FILTER_ROWS / max(n, 1))
    while dim > 1 and share < 0.4:
        for count in FILTERS:
            words = max(4, int(np.ceil((count / share) ** (1 / blocks))))
            found = Filters(dim, words, -9.0, int(np.ceil(FEWEST * count)), centre)
            found = replace(found, need=_height(found, count, some))
            if measured(found, sample, cosine, 60)[0] > wanted - 0.05 and measured(found, sample, cosine, seed=1)[0] >= wanted:
                return found
        share *= WIDER
    return Filters(dim, 1, -9.0, 1, centre)


def _exceeding(scores: list[np.ndarray], best: list[float], need: float, words: int, most: int | None = None) -> np.ndarray:
    """Directions whose sum over blocks is ``need`` at least; with ``most``, it may stop beyond so many."""
    sums, ids = np.zeros(1), np.zeros(1, np.int64)
    for b, s in enumerate(scores):
        rest = sum(best[b + 1 :])
        near = np.flatnonzero(s + sums.max(initial=-9) + rest >= need)  # codewords that can still get there
        joint = sums[:, None] + s[None, near]
        i, j = np.nonzero(joint + rest >= need)
        sums, ids = joint[i, j], ids[i] * words + near[j]
    return ids


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square is beyond the range of doubles."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, without Python objects."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _decoder(fitted: dict[int, tuple[int, Filters]]) -> Callable:
    """``fitted`` has, for each vector size, the number of its first filter and the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = pc.list_value_length(vectors).to_numpy()
            found: list = [None] * len(sizes)
            for dim in set(sizes.tolist()):
                first, filters = fitted[dim]
                rows = np.flatnonzero(sizes == dim)
                unit = unit_rows(_matrix(vectors.take(pa.array(rows))))
                step = max(1, DECODED_AT_ONCE // filters.words)
                for a in range(0, len(rows), step):
                    for r, ids in zip(rows[a : a + step], filters.decode(unit[a : a + step])):
                        found[r] = ids + first  # vectors of other lengths never meet
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "filters"])

    return run


def fitted_filters(vectors: DataFrame, threshold: float, wanted: float) -> dict[int, tuple[int, Filters]]:
    """Filters for each vector size, numbered apart, from SAMPLE vectors of it (SAMPLE_BYTES at most) in order of a hash of rep."""
    out, first = {}, 0
    for row in vectors.groupBy(F.size("embedding").alias("dim")).count().collect():
        dim, n = row["dim"], row["count"]
        rows = vectors.where(F.size("embedding") == dim).orderBy(F.xxhash64("rep")).limit(max(64, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).select("embedding").collect()
        found = fit(unit_rows(np.array([r.embedding for r in rows], np.float64)), n, threshold, wanted)
        out[dim] = first, found
        first += found.size
    return out


def _forest(linked: np.ndarray) -> np.ndarray:
    """The least index reachable from each row of a symmetric adjacency."""
    label = np.arange(len(linked))
    near = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(near, label[None, :], len(label)).min(1, initial=len(label))
        new = new[new]
        if (new == label).all():
            return label
        label = new


_NO_LINKS = pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})


def _verifier(threshold: float) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        own = group.column("filter")[0].as_py()
        first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
        unit = unit_rows(_matrix(group.column("embedding").combine_chunks()))
        linked = unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        if first != second:  # each block with itself is another group
            block = np.asarray(group.column("block"))
            linked &= block[:, None] != block[None, :]
        busy = np.flatnonzero(linked.any(1))
        linked = linked[np.ix_(busy, busy)]
        if not len(busy):
            return _NO_LINKS
        # Of filters under this one, those that two busy rows have: pairs of such rows were counted there.
        lists = group.column("filters").combine_chunks().take(pa.array(busy))
        ids = lists.flatten().to_numpy()
        rows = np.repeat(np.arange(len(busy)), pc.list_value_length(lists).to_numpy())
        rows, ids = rows[ids < own], ids[ids < own]
        order = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
        lower = [r for r in np.split(rows[order], starts[1:]) if len(r) > 1]
        for a in range(0, len(lower), 2048):
            has = np.zeros((len(busy), min(2048, len(lower) - a)), np.float32)
            for col, rows in enumerate(lower[a : a + 2048]):
                has[rows, col] = 1
            linked &= has @ has.T == 0  # counted under a lower filter
        still = np.flatnonzero(linked.any(1))
        linked, rows = linked[np.ix_(still, still)], busy[still]
        ids = np.asarray(group.column("rep"))[rows]
        order = np.argsort(ids, kind="stable")
        linked, rows, ids = linked[np.ix_(order, order)], rows[order], ids[order]
        copies = np.asarray(group.column("copies"))[rows]
        return pa.table({"rep": pa.array(ids, pa.int64()), "links": pa.array(linked @ copies, pa.int64()), "root": pa.array(ids[_forest(linked)], pa.int64())})

    return run


def vector_links(vectors: DataFrame, threshold: float = THRESHOLD, wanted: float = RECALL) -> DataFrame:
    """vectors(rep, copies, embedding), all different -> (rep, links, root), several rows for a rep.

    links add up to the other vectors within ``threshold``, copies counted; rows with one root are connected.
    """
    kind = dict(vectors.dtypes)["embedding"]
    fitted = fitted_filters(vectors, threshold, wanted)
    decoded = materialise(vectors.mapInArrow(_decoder(fitted), f"rep bigint, copies bigint, embedding {kind}, filters array<bigint>"), "filters")
    counts = decoded.select(F.explode("filters").alias("filter")).groupBy("filter").count()
    # Filters of two vectors or more; a full one is split.
    used = materialise(counts.where("count > 1").select("filter", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")), "filter-sizes")
    rows = decoded.select("rep", "copies", "embedding", "filters", F.explode("filters").alias("filter")).join(used, "filter")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select(
        "filter", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "block", "rep", "copies", "embedding", "filters",
    )
    return rows.groupBy("filter", "first", "second").applyInArrow(_verifier(threshold), "rep bigint, links bigint, root bigint")


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, wanted: float = RECALL) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    n_links counts the other vectors whose cosine (in double precision) is at least ``threshold``;
    component_id is the smallest vec_id reachable by links, kept tells whether that is its own.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    neither do vectors of different lengths. Equal vectors are one node whose copies count, also
    where rows repeat a vec_id; a row without vec_id counts as a link but names no component. An
    empty table gives an empty one. Only vec_id and embedding are read.
    """
    # Floats are shipped as they are and widened where they meet; anything else is double from the start.
    kind = "array<float>" if dict(table.dtypes)["embedding"] == "array<float>" else "array<double>"
    plain = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    sound = F.coalesce(
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists("embedding", lambda v: v != 0), F.lit(False)
    )
    rows = materialise(plain.withColumn("sound", sound), "vectors")
    nodes = rows.where("sound and vec_id is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"))
    sizes = rows.where("sound").groupBy("embedding").agg(F.count("*").alias("copies"))
    nodes = materialise(nodes.join(sizes, "embedding").select("rep", "copies", "embedding"), "distinct-vectors")
    found = materialise(vector_links(nodes, threshold, wanted), "links")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("rep <> root").select(F.col("rep").alias("hi"), F.col("root").alias("lo")))
    named = nodes.join(sums, "rep", "left").join(roots, nodes.rep == roots.node, "left").select(
        "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component")
    )
    whole = rows.where("sound").join(named, "embedding").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
