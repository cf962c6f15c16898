"""Orders over a whole table without a window over all rows: ranges of like size, and running totals over them."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at least and at most, and rows of a range about: the number of ranges grows with the table.
RANGES, MOST_RANGES, ROWS = 256, 65_536, 200_000
LEAST = -(2**63)


def sort_key(column: str) -> Column:
    """An integer column with null as the least value."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LEAST))


def split_points(df: DataFrame, key: Column, ranges: int | None = None, rows: int = ROWS) -> list[int]:
    """Values of key, the least first, that each begin a range; none for an empty table.

    They are approximate quantiles, one for about so many rows (fewer for wide rows), so their number is bounded by the table's rows over that.
    Which ones come out changes sizes only: a caller's result is the same for any.
    """
    ranges = ranges or min(MOST_RANGES, max(RANGES, -(-df.count() // rows)))
    row = df.agg(F.min(key).alias("least"), F.percentile_approx(key, [k / ranges for k in range(1, ranges)], max(10_000, 4 * ranges)).alias("at")).first()
    return [] if row["least"] is None else sorted({row["least"], *row["at"]})


def points_column(points: list[int]) -> Column:
    """The points as one literal array, however many."""
    return F.split(F.lit(",".join(map(str, points or [0]))), ",").cast("array<bigint>")


def range_number(points: list[int], key: Column) -> Column:
    """How many points are at most key, in two steps of about the root of their number."""
    width = isqrt(len(points)) + 1
    block = F.size(F.filter(points_column(points[::width]), lambda p: p <= key))
    inside = F.size(F.filter(F.slice(points_column(points), F.greatest(block - 1, F.lit(0)) * width + 1, width), lambda p: p <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + inside)


def running_total(df: DataFrame, order: str, value: Column, name: str, then: list[str] | None = None, within: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds the sum of value over the rows before each row, by the integer column order (null first), then by ``then``.

    Each range has its own window, and the sums of the ranges before it come from a table of a row per range (and
    value of ``within``).
    """
    within = within or []
    points = split_points(df, sort_key(order), ranges)
    dealt = df.withColumn("__range", range_number(points, sort_key(order))).withColumn("__value", value)
    along = Window.partitionBy(*within, "__range").orderBy(F.col(order).asc_nulls_first(), *(then or [])).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("__inside", F.coalesce(F.sum("__value").over(along), F.lit(0)))
    over = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*within, "__range").agg(F.sum("__value").alias("__sum"))
    before = sums.select(*within, "__range", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__before"))
    joined = inside.join(before, [*within, "__range"])
    return joined.select(*df.columns, (F.col("__inside") + F.col("__before")).alias(name))
