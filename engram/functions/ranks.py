"""Places of rows in a total order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of equal shares that an order is cut into, and bounds that are looked up together.
SHARES, STEP = 256, 16


def positions(rows: DataFrame, buckets: list[Column], order: list[Column], name: str = "position") -> DataFrame:
    """Adds the place (1, 2, ...) of each row in ``order``.

    ``buckets`` are columns that never fall while the order rises; rows are ranked inside a bucket and moved by the
    rows in the buckets before, which partial counts give.
    """
    keys = [f"__b{i}" for i in range(len(buckets))]
    rows = rows.withColumns(dict(zip(keys, buckets, strict=True)))
    before = Window.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    moved = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(*[F.col(k).alias(f"{k}_") for k in keys], "__before")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.join(moved, same).withColumn(name, F.col("__before") + inner).drop(*keys, *[f"{k}_" for k in keys], "__before")


def number_buckets(rows: DataFrame, column: str, buckets: int = SHARES) -> Column:
    """A bucket of a number column, each with about the same share of the rows however the values lie.

    The bounds are approximate quantiles of all rows, found by one aggregate; a value is looked up in two steps.
    """
    points = rows.agg(F.percentile_approx(column, [k / buckets for k in range(1, buckets)], 10_000)).head()[0] or []
    bounds = sorted(set(points))
    if not bounds:
        return F.lit(0)
    parts = [bounds[at : at + STEP] for at in range(0, len(bounds), STEP)]
    value = F.col(column)
    part = F.size(F.filter(F.array(*[F.lit(p[0]) for p in parts]), lambda b: b <= value))
    inside = F.element_at(F.array(*[F.array(*[F.lit(b) for b in p]) for p in parts]), F.greatest(F.lit(1), part))
    return F.when(part == 0, 0).otherwise((part - 1) * STEP + F.size(F.filter(inside, lambda b: b <= value)))


def hash_buckets(digest: Column) -> Column:
    """A bucket of rows in the order of a hexadecimal digest."""
    return F.substring(digest, 1, 3)
