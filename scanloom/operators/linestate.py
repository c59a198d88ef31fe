"""Comment stripping for input that already arrives as lines, for files of any size.

Whether a line starts inside a block comment depends on all lines before it. Each line maps the
state before it to the state after it in one of four ways: always inside, always outside, unchanged,
or turned round. Such maps can be put together, and any number of them is one of the four again: the
last constant one decides, turned round once for every turning one since. So a file is cut into
ranges of lines; each range becomes one map, the maps of the ranges in front give the state in which
a range starts, and that state goes into the range. No task holds more than a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import text

# Numbers of the order column in one range.
RANGE_LINES = 50_000


def strip_by_line(
    lines: DataFrame,
    file: Sequence[str] = ("project_id", "path"),
    order: str = "line",
    raw: str = "raw",
    range_lines: int = RANGE_LINES,
) -> DataFrame:
    """Add ``stripped`` to a table of lines.

    ``file`` names the columns of a file, any of which may be null, and ``order`` a number that orders
    its lines. ``range_lines`` consecutive numbers are one window group; the ranges of a file, one row
    each, are another.
    """
    file = list(file)
    rest = text.after_block_end(F.col(raw))
    mapped = (
        lines.withColumn("_range", F.floor(F.col(order) / range_lines))
        .withColumn("_from_out", text.ends_in_block_comment(F.col(raw)))
        .withColumn("_rest", rest)
        .withColumn(
            "_from_in",
            F.when(F.col("_rest").isNull(), True).otherwise(
                text.ends_in_block_comment(F.col("_rest"))
            ),
        )
    )
    constant = F.col("_from_out") == F.col("_from_in")
    turn = (F.col("_from_out") & ~F.col("_from_in")).cast("int")
    within = Window.partitionBy(*file, "_range").orderBy(order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = mapped.withColumn("_turns", F.sum(turn).over(so_far))
    # The map of what stands before a line in its range: the last constant value, or null; and turns.
    state = counted.select(
        "*",
        F.last(F.when(constant, F.col("_from_out")), ignorenulls=True).over(earlier).alias("_last"),
        F.last(F.when(constant, F.col("_turns")), ignorenulls=True).over(earlier).alias("_at"),
        F.lag("_turns", 1, 0).over(within).alias("_now"),
    ).withColumn("_turned", (F.col("_now") - F.coalesce("_at", F.lit(0))) % 2 == 1)

    # The map of a whole range is that of what stands before its last line, and then that line's.
    def after(start: Column) -> Column:
        inside = F.coalesce("_last", start) != F.col("_turned")
        return F.when(inside, F.col("_from_in")).otherwise(F.col("_from_out"))

    ranges = state.groupBy(*file, "_range").agg(
        F.max_by(
            F.struct(after(F.lit(False)).alias("from_out"), after(F.lit(True)).alias("from_in")), order
        ).alias("_map")
    )
    over_file = Window.partitionBy(*file).orderBy("_range")
    fixed = F.col("_map.from_out") == F.col("_map.from_in")
    turned = (F.col("_map.from_out") & ~F.col("_map.from_in")).cast("int")
    ranges = ranges.withColumn(
        "_count", F.sum(turned).over(over_file.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    ahead = over_file.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        *file,
        "_range",
        F.last(F.when(fixed, F.col("_map.from_out")), ignorenulls=True).over(ahead).alias("_value"),
        F.last(F.when(fixed, F.col("_count")), ignorenulls=True).over(ahead).alias("_since"),
        F.lag("_count", 1, 0).over(over_file).alias("_counted"),
    )
    starts = ranges.select(
        *[F.col(c).alias(f"_of{k}") for k, c in enumerate(file)],
        F.col("_range").alias("_of"),
        (
            F.coalesce("_value", F.lit(False))
            != ((F.col("_counted") - F.coalesce("_since", F.lit(0))) % 2 == 1)
        ).alias("_start"),
    )
    same = F.col("_range").eqNullSafe(F.col("_of"))
    for k, c in enumerate(file):
        same = same & F.col(c).eqNullSafe(F.col(f"_of{k}"))
    joined = state.join(starts, same)
    inside = F.coalesce("_last", "_start") != F.col("_turned")
    stripped = F.when(inside, text.strip_comments(F.coalesce("_rest", F.lit("")))).otherwise(
        text.strip_comments(F.col(raw))
    )
    return joined.withColumn("stripped", stripped).select(*lines.columns, "stripped")
