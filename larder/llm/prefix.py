"""Prefix sums inside groups of any size, without a task that holds a whole group.

A hash-uniform hex key orders the rows. Its first digits split each group into ranges of equal
expectation; running sums are taken inside a range and shifted by the totals of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3  # 4096 ranges a group


def with_prefix(rows: DataFrame, groups: list[str], key: str, ties: list[str], value: str, of_group: DataFrame | None = None) -> DataFrame:
    """Add ``before`` (sum of ``value`` over the rows that precede in the group) and ``total``.

    Columns of ``of_group``, a table of one row per group, come along on the ranges, so that no join
    meets a whole group. ``rows`` is read twice, so it should be a stored table. Group columns must not be null. Rows that
    agree in key and ties follow each other in any order.
    """
    ranged = rows.withColumn("range", F.substring(key, 1, DIGITS))
    keys = [*groups, "range"]
    earlier = (Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys).agg(F.sum(value).alias("in_range"))
    by_range = Window.partitionBy(*groups).orderBy("range").rowsBetween(*earlier)
    shifts = sums.select(
        *keys,
        F.coalesce(F.sum("in_range").over(by_range), F.lit(0)).alias("shift"),
        F.sum("in_range").over(Window.partitionBy(*groups)).alias("total"),
    )
    if of_group is not None:
        shifts = shifts.join(of_group, groups)
    within = Window.partitionBy(*keys).orderBy(key, *ties).rowsBetween(*earlier)
    running = ranged.withColumn("inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return running.join(shifts, keys).withColumn("before", F.col("shift") + F.col("inside")).drop("shift", "inside", "range")
