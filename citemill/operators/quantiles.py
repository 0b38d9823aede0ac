"""Exact percentiles of groups of any size, by selection.

Equal values are counted where they lie, the counts are cut into ranges by value, and a percentile is
read from the one or two values that stand at its place: a group is never sorted or held as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.sources.store import stored

from .ranges import running


def percentiles(values: DataFrame, places: dict[str, float], interpolate: bool = True) -> DataFrame:
    """values(grp, value) -> (grp, one column for each of ``places``, {name: share}).

    A share p of n values is at place p * (n - 1) from 0, between its neighbours by proportion; without
    ``interpolate`` it is the value at place floor(p * n), the last one at most. Null values are left
    out, a group without others gives no row, and a null group is a group of its own.
    """
    counts = stored(values.where("value is not null").groupBy(F.struct("grp").alias("g"), "value").agg(F.count("*").alias("c")), "counts")
    whole = counts.groupBy("g").agg(F.sum("c").alias("n"))
    placed = running(counts, ["value"], {"before": ("c", "sum")}, ("g",)).join(whole, "g")
    holds = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("c")), F.col("value")))
    parts = []
    for name, p in places.items():
        at = F.lit(p) * (F.col("n") - 1) if interpolate else F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)
        parts += [holds(F.floor(at)).alias(f"{name}_low"), holds(F.ceil(at)).alias(f"{name}_high"), F.max(at - F.floor(at)).alias(f"{name}_part")]
    found = placed.groupBy("g").agg(*parts)
    # At a whole place the value itself: infinite neighbours have no difference.
    between = {name: F.when(F.col(f"{name}_part") == 0, F.col(f"{name}_low")).otherwise(F.col(f"{name}_low") * (1 - F.col(f"{name}_part")) + F.col(f"{name}_high") * F.col(f"{name}_part")) for name in places}
    return found.select("g.grp", *[c.alias(name) for name, c in between.items()])
