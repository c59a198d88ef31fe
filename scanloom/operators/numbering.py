"""Row numbers within groups that may be arbitrarily large.

A plain ``row_number()`` sends a whole group to one task. Here rows are dealt by ranges of (group,
sort key), so a group of any size is spread over tasks; each task numbers what it holds, and the
rows that a group has in earlier ranges are added. The plan is the same for all sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.plans.storage import settle


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``, the 0-based place of each row of its group in ascending order.

    ``order`` must identify a row within its group. The input is read once to choose the ranges and
    once to deal the rows out; the dealt rows are kept, since their counts and they themselves are
    both needed. The counts hold a row per group and range.
    """
    group, order = list(group), list(order)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(partitions, *group, *order).sortWithinPartitions(*group, *order)
    # The task's number above the row's place in it.
    dealt = settle(dealt.withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    parts = dealt.groupBy(*group, "_range").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(c).alias(f"_{k}") for k, c in enumerate(group)],
        F.col("_range").alias("_of"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.col("_range") == F.col("_of")
    for k, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_{k}"))
    placed = dealt.join(parts, same).withColumn(name, F.col("_at") + F.col("_shift"))
    return placed.select(*df.columns, name)
