"""Unified-diff hunks of files that only lose lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines of context around a change; changes whose context would touch share a hunk.
CONTEXT = 3

_SPANS = "array<struct<first:int,last:int>>"


def removal_hunks(lines: Column, removed: Column) -> Column:
    """Header and body lines of all hunks, as an array of text.

    ``lines`` are the old lines, ``removed`` the 0-based places of those that go, ascending. Since
    nothing is added, a hunk follows from the places alone: its old side is the removed lines and
    their context, its new side the same without them.
    """
    spans = F.aggregate(
        removed,
        F.lit(None).cast(_SPANS),
        lambda done, r: F.when(
            F.element_at(done, -1)["last"] + 2 * CONTEXT >= r - 1,
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), r.cast("int").alias("last"))),
            ),
        ).otherwise(
            F.concat(
                F.coalesce(done, F.array().cast(_SPANS)),
                F.array(F.struct(r.cast("int").alias("first"), r.cast("int").alias("last"))),
            )
        ),
    )

    def hunk(span: Column) -> Column:
        start = F.greatest(F.lit(0), span["first"] - CONTEXT)
        end = F.least(F.size(lines) - 1, span["last"] + CONTEXT)
        gone = F.size(F.filter(removed, lambda r: (r >= start) & (r <= end)))
        before = F.size(F.filter(removed, lambda r: r < start))
        kept = end - start + 1 - gone
        # An empty side is numbered by the line before it.
        new_start = start - before + F.when(kept > 0, 1).otherwise(0)
        header = F.concat(
            F.lit("@@ -"),
            (start + 1).cast("string"),
            F.lit(","),
            (end - start + 1).cast("string"),
            F.lit(" +"),
            new_start.cast("string"),
            F.lit(","),
            kept.cast("string"),
            F.lit(" @@"),
        )
        body = F.transform(
            F.sequence(start, end),
            lambda i: F.concat(
                F.when(F.array_contains(removed, i), "-").otherwise(" "), F.get(lines, i)
            ),
        )
        return F.concat(F.array(header), body)

    return F.flatten(F.transform(F.coalesce(spans, F.array().cast(_SPANS)), hunk))
