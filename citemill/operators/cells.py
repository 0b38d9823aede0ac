"""A stored vector index that is searched exactly without reading all of it.

Unit vectors lie in cells around pivots, a folder each, and every cell knows its radius: the largest
angle from its pivot. A query is at least its angle to the pivot, less the radius, away from all of a
cell. Its nearest cells give k neighbours; cells that can hold none as near are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.sources.store import stored

from .dense import QUERY_BLOCK

#: Vectors of a cell, about, and cells at most; their pivots are a sample of as many vectors, by a hash of the id.
CELL_ROWS, MOST_CELLS = 2048, 4096
#: Scores are ranked after rounding to 6 decimals, so a bound is taken that much wider, as a cosine.
SLACK = 2e-6


def _unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


@dataclass
class Cells:
    rows: DataFrame  # (cell, id, vector)
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    numbers: np.ndarray  # the cells' folders; cells without a vector have none
    #: (query and cell pairs that were read, all of them), added up over searches.
    read: list[int] = field(default_factory=lambda: [0, 0])

    @staticmethod
    def write(vectors: DataFrame, path: str, most_cells: int = MOST_CELLS) -> None:
        """vectors(id, vector), of one length; null, zero and non-finite vectors are left out, as they have no cosine."""
        sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        own = stored(vectors.where(F.col("vector").isNotNull() & sound).select("id", F.col("vector").cast("array<double>").alias("vector")), "vectors")
        n = own.count()
        some = own.orderBy(F.xxhash64("id"), "id").limit(max(1, min(most_cells, n // CELL_ROWS))).select("vector").collect()
        pivots = _unit([r.vector for r in some]) if some else np.zeros((0, 1))
        kind = dict(own.dtypes)["id"]

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    angles = _angles(_unit(list(pdf["vector"])), pivots)
                    cell = angles.argmin(1)
                    yield pdf.assign(cell=cell.astype(np.int32), angle=angles[np.arange(len(pdf)), cell])

        placed = stored(own.mapInPandas(place, f"id {kind}, vector array<double>, cell int, angle double"), "placed")
        placed.select("cell", "id", "vector").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        told = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        named = own.sparkSession.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>")
        named.join(told, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")

    @staticmethod
    def open(spark: SparkSession, path: str) -> Cells:
        """At most MOST_CELLS pivots come to the driver."""
        cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)
        numbers = np.array([r.cell for r in cells])
        rows = spark.read.parquet(f"{path}/rows") if cells else spark.createDataFrame([], "id bigint, vector array<double>, cell int")
        return Cells(rows, np.array([r.pivot for r in cells]), np.array([r.radius for r in cells]), np.array([r.n for r in cells]), numbers)

    def share_read(self) -> float:
        return self.read[0] / max(self.read[1], 1)

    def search(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """``dense.top_k``'s rows: queries(qid, vector) -> (qid, rank, id, score).

        Queries are a stated set and go to the executors block by block. Those without a cosine, or of
        another length than the index, give no row.
        """
        spark = queries.sparkSession
        kinds = dict(queries.dtypes)["qid"], dict(self.rows.dtypes)["id"]
        found, block = None, []

        def flush() -> None:
            nonlocal found, block
            sound = [(q, v) for q, v in block if self.pivots.size and len(v) == self.pivots.shape[1] and np.isfinite(v).all() and v.any()]
            block = []
            if sound:
                some = stored(self._block(sound, k + exclude_self, kinds), "nearest")
                found = some if found is None else found.union(some)

        for row in queries.where("vector is not null").select("qid", "vector").toLocalIterator():
            if len(block) == QUERY_BLOCK:
                flush()
            block.append((row.qid, np.array(row.vector, float)))
        flush()
        if found is None:
            return spark.createDataFrame([], f"qid {kinds[0]}, rank int, id {kinds[1]}, score double")
        if exclude_self:
            found = found.where("qid <> id")
        order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")

    def _block(self, queries: list[tuple], k: int, kinds: tuple[str, str]) -> DataFrame:
        unit = _unit([v for _, v in queries])
        near = np.maximum(_angles(unit, self.pivots) - self.radius[None], 0)  # no vector of the cell is nearer
        order = np.argsort(near, axis=1, kind="stable")
        enough = (np.cumsum(self.count[order], axis=1) < k).sum(1) + 1  # the nearest cells that hold k
        first = np.zeros(near.shape, bool)
        for q in range(len(queries)):
            first[q, order[q, : enough[q]]] = True
        schema = f"at int, qid {kinds[0]}, id {kinds[1]}, score double"
        head = stored(self._scored(queries, unit, first, k, schema), "first-cells")
        kth = Window.partitionBy("at").orderBy(F.col("score").desc(), "id")
        floor = np.full(len(queries), -1.0)
        for r in head.withColumn("nth", F.row_number().over(kth)).where(F.col("nth") == k).select("at", "score").collect():
            floor[r.at] = r.score
        rest = (np.cos(near) >= floor[:, None] - SLACK) & ~first
        self.read[0] += int(first.sum() + rest.sum())
        self.read[1] += first.size
        return head.union(self._scored(queries, unit, rest, k, schema)).drop("at")

    def _scored(self, queries: list[tuple], unit: np.ndarray, wanted: np.ndarray, k: int, schema: str) -> DataFrame:
        """Each wanted cell's best k for its queries, of the cells' folders alone."""
        cells = np.flatnonzero(wanted.any(0))
        asked = {int(self.numbers[c]): np.flatnonzero(wanted[:, c]) for c in cells}
        qids = np.array([q for q, _ in queries], dtype=object)
        return self.rows.where(F.col("cell").isin(*asked)).mapInPandas(_scorer(asked, qids, unit, k), schema)


def _scorer(asked: dict[int, np.ndarray], qids: np.ndarray, unit: np.ndarray, k: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, pdf in batch.groupby("cell"):
                at = asked[int(cell)]
                scores = np.round(_unit(list(pdf["vector"])) @ unit[at].T, 6)
                least = np.partition(scores, max(len(pdf) - k, 0), axis=0)[max(len(pdf) - k, 0)]
                rows, cols = np.nonzero(scores >= least)
                yield pd.DataFrame({"at": at[cols].astype(np.int32), "qid": qids[at[cols]], "id": pdf["id"].to_numpy()[rows], "score": scores[rows, cols]})

    return run
