"""Percentile bootstrap intervals, single and paired.

A replicate gives each row a weight, how often it is drawn, from a hash of the row's key and the
replicate's number: a Poisson number of mean one, which is what the number of draws of one row of many is. So
a replicate's sums are added up wherever rows lie, and no group is ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

N_BOOT, ALPHA, SEED = 2000, 0.05, 0

#: Rows of a group that one task adds up, about.
PART_ROWS = 1 << 16
#: Weights that are held at once.
AT_ONCE = 1 << 20

#: Multipliers of the integer hash, and of a replicate's number.
STEP, MIX = 2654435761, ((16, 2246822507), (13, 3266489909), (16, 1))
#: A row is drawn as often as its hash reaches one of these: the Poisson distribution of mean 1 in 32 bits.
DRAWN = tuple(int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(11))


def weights(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """How often each replicate draws each key; ``keys`` are 32-bit hashes."""
    x = keys.astype(np.uint32)[:, None] + (replicates.astype(np.uint64) * STEP).astype(np.uint32)[None]
    for shift, factor in MIX:
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    w = np.zeros(x.shape, np.uint8)
    for least in DRAWN:
        w += x >= np.uint32(least)
    return w


def _summed(n_boot: int) -> Callable:
    """Rows by (grp, part) -> one row for each run of them, with its sums of weights and of weighted values."""
    replicates = np.arange(n_boot)
    step = max(1, AT_ONCE // n_boot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            keys, values = batch.column("hash").to_numpy(), batch.column("value").to_numpy()
            ends = [*(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else []
            begin, drawn, sums = 0, [], []
            for end in ends:
                n, total = np.zeros(n_boot, np.int64), np.zeros(n_boot)
                for a in range(begin, end, step):
                    w = weights(keys[a : min(a + step, end)], replicates)
                    n += w.sum(0, dtype=np.int64)
                    total += values[a : min(a + step, end)] @ w.astype(np.float64)
                drawn.append(n)
                sums.append(total)
                begin = end
            first = pa.array([0, *ends[:-1]] if ends else [], pa.int64())
            columns = [batch.column("grp").take(first), pa.array(drawn, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "drawn", "total"])

    return run


def bootstrap_ci(values: DataFrame, n_boot: int = N_BOOT, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """values(grp, key, value) -> (grp, mean, low, high, n).

    The bounds are the replicates' means at places int(alpha / 2 * n_boot) and int((1 - alpha / 2) *
    n_boot) in order; a replicate that draws nothing has the group's mean. Rows that share a key are
    drawn together. Null values are left out, an empty group gives no row; a null group is a group of
    its own. Groups of any size: what is shuffled are the rows, without their text, and n_boot sums for each PART_ROWS of them.
    """
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("bigint")
    sound = values.where("value is not null").select(F.struct("grp").alias("g"), hashed.alias("hash"), F.col("value").cast("double").alias("value"))
    whole = sound.groupBy("g").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))  # a struct of null equals itself in joins
    dealt = sound.join(whole.select("g", F.ceil(F.col("n") / PART_ROWS).alias("parts")), "g")
    dealt = dealt.withColumn("at", F.xxhash64("g", F.pmod(F.xxhash64("hash"), F.col("parts"))))
    dealt = dealt.repartition("at").sortWithinPartitions("at", "g").select("g.grp", "at", "hash", "value")
    schema = StructType([dealt.schema["grp"], StructField("drawn", ArrayType(LongType())), StructField("total", ArrayType(DoubleType()))])
    drawn = dealt.mapInArrow(_summed(n_boot), schema)
    each = drawn.select(F.struct("grp").alias("g"), F.posexplode(F.arrays_zip("drawn", "total")).alias("b", "s"))
    sums = each.groupBy("g", "b").agg(F.sum("s.drawn").alias("drawn"), F.sum("s.total").alias("total"))
    means = sums.join(whole, "g").select("g", F.when(F.col("drawn") > 0, F.col("total") / F.col("drawn")).otherwise(F.col("mean")).alias("m"))
    low, high = int(alpha / 2 * n_boot), min(n_boot - 1, int((1 - alpha / 2) * n_boot))
    ordered = means.groupBy("g").agg(F.array_sort(F.collect_list("m")).alias("m"))  # n_boot numbers a group
    bounds = ordered.select("g", F.round(F.get("m", F.lit(low)), 6).alias("low"), F.round(F.get("m", F.lit(high)), 6).alias("high"))
    return whole.join(bounds, "g").select("g.grp", F.round("mean", 6).alias("mean"), "low", "high", "n")


def counted(values: DataFrame, n_boot: int = N_BOOT, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """values(grp, value) -> (grp, mean, low, high, n), for groups of any size whose values repeat, as scores do.

    How often a replicate of n draws takes each distinct value is multinomial, so replicates are drawn
    from the values' counts: the distribution of ``bootstrap_ci``, by another random stream. Values
    are rounded to 9 decimals first; a group is one row of distinct values and counts.
    """
    low, high = int(alpha / 2 * n_boot), min(n_boot - 1, int((1 - alpha / 2) * n_boot))

    @F.pandas_udf("struct<mean:double,low:double,high:double,n:bigint>")
    def interval(cells: pd.Series) -> pd.DataFrame:
        out = []
        for group in cells:
            group = sorted((c["value"], c["c"]) for c in group)
            at, c = np.array([v for v, _ in group]), np.array([k for _, k in group], np.int64)
            n = int(c.sum())
            means = np.sort(np.random.default_rng(seed).multinomial(n, c / n, n_boot) @ at / n)
            out.append((float(c @ at / n), float(means[low]), float(means[high]), n))
        return pd.DataFrame(out, columns=["mean", "low", "high", "n"])

    cells = values.where("value is not null").groupBy("grp", F.round("value", 9).alias("value")).agg(F.count("*").alias("c"))
    found = cells.groupBy("grp").agg(F.collect_list(F.struct("value", "c")).alias("cells")).select("grp", interval("cells").alias("x"))
    return found.select("grp", *(F.round(f"x.{c}", 6).alias(c) for c in ("mean", "low", "high")), "x.n")


def paired_difference(values: DataFrame, **options) -> DataFrame:
    """values(grp, key, a, b) -> bootstrap_ci of b - a over keys that have both."""
    return bootstrap_ci(values.select("grp", "key", (F.col("b") - F.col("a")).alias("value")), **options)


def compare(metrics: DataFrame, baseline: str, other: str, **options) -> DataFrame:
    """long-form metrics(config, qid, metric, value): other less baseline, question by question, for each metric."""
    found = against(metrics.where(F.col("config").isin(baseline, other)), (baseline,), **options)
    return found.select(F.col("metric").alias("grp"), F.col("difference").alias("mean"), "low", "high", "n")


def against(metrics: DataFrame, baselines: tuple[str, ...], **options) -> DataFrame:
    """long-form metrics(config, qid, metric, value) -> (baseline, config, metric, difference, low, high, n).

    Every other configuration less each baseline, over the questions for which both have a value.
    """
    base = metrics.where(F.col("config").isin(*baselines)).select(F.col("config").alias("baseline"), "qid", "metric", F.col("value").alias("a"))
    both = base.join(metrics.select("config", "qid", "metric", F.col("value").alias("b")), ["qid", "metric"]).where("config <> baseline")
    found = paired_difference(both.select(F.struct("baseline", "config", "metric").alias("grp"), F.col("qid").alias("key"), "a", "b"), **options)
    return found.select("grp.baseline", "grp.config", "grp.metric", F.col("mean").alias("difference"), "low", "high", "n")
