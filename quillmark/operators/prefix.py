"""Running aggregates over an ordered key without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, order: str, sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None, width: int = 1024, levels: int = 2) -> DataFrame:
    """Adds, per output name, the running sum or maximum of a column along the integer key ``order``.

    Keys are cut into ranges of ``width``, and ranges again, ``levels`` times; a window runs inside each
    range, and the one that spans all has ``width ** (levels + 1)`` times fewer rows than there are keys.
    """
    sums, maxima = sums or {}, maxima or {}
    cut = df.withColumn("_range", F.floor(F.col(order) / width))
    totals = cut.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_{n}") for n, c in maxima.items()])
    carried = _before(totals, [f"_{n}" for n in sums], [f"_{n}" for n in maxima], width, levels)
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(carried, "_range")
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(inside) + F.col(f"_{n}"))
    for n, c in maxima.items():
        out = out.withColumn(n, F.greatest(F.max(c).over(inside), F.col(f"_{n}")))
    return out.drop("_range", *(f"_{n}" for n in (*sums, *maxima)))


def _before(totals: DataFrame, sums: list[str], maxima: list[str], width: int, levels: int) -> DataFrame:
    """For each _range, the sums and maxima of all ranges before it."""
    if not levels:
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums], *[F.max(c).over(before).alias(c) for c in maxima])
    cut = totals.withColumn("_wide", F.floor(F.col("_range") / width))
    wide = cut.groupBy(F.col("_wide").alias("_range")).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])
    carried = _before(wide, sums, maxima, width, levels - 1).select(F.col("_range").alias("_wide"), *[F.col(c).alias(f"{c}_") for c in (*sums, *maxima)])
    before = Window.partitionBy("_wide").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    both = cut.join(carried, "_wide")
    return both.select(
        "_range",
        *[(F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"{c}_")).alias(c) for c in sums],
        *[F.greatest(F.max(c).over(before), F.col(f"{c}_")).alias(c) for c in maxima],
    )
