"""Row positions in an explicit order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 512


def range_of(key: Column, bounds: list) -> Column:
    """Number of ``bounds``, ascending, that are not above ``key``: a binary search over a literal array."""
    steps, step = [], 1
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    cuts = F.array(*[F.lit(b) for b in bounds])
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, s: F.when((low + s <= F.lit(len(bounds))) & (F.get(cuts, low + s - 1) <= key), low + s).otherwise(low))


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """0-based position by ``order`` (its first column a number without nulls).

    Cut points of the first column (RANGES at most) split the rows; counts by range give starts.
    """
    first = order[0]
    got = df.agg(F.percentile_approx(first, [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    cuts = sorted(set(got))
    ranged = df.withColumn("__range", range_of(F.col(first), cuts))
    counts = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}  # RANGES rows at most
    starts, total = [], 0
    for i in range(len(cuts) + 1):
        starts.append(total)
        total += counts.get(i, 0)
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.withColumn(name, F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("__range")) + rank).drop("__range")
