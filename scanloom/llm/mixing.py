"""Mixing sources to target weights: which documents to take how often to meet word budgets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm import store

#: No document is taken more often, no target is larger than so many times its source.
MOST_TIMES = 3
#: Words that the dynamic programme fills; what is above is filled by length counts before.
PROGRAMME_WORDS = 1 << 14
#: Documents of one source and length that are put in order together.
ORDERED_TOGETHER = 1000


def word_count(text: str = "text"):
    """Words of a text, ended by blanks; null has none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sources in order of code points, null last, weigh ``weights``, repeating, and share the sum of all
    sizes. A target stops at three times its source's size; the excess is shared anew by weight among
    the others until none is above. Each round is one aggregation over the sources; only its sums
    come to the driver. Sources are put in order by ranges, not in one task.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranges = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    # Spark compares strings by their UTF-8 bytes, which is the order of code points.
    order = [F.col("source").isNull(), F.col("source")]
    ranged = store.kept(
        totals.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    )
    inside = F.row_number().over(_window("range", order))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    # A row per range; their number is the session's.
    before = counts.select("range", (F.sum("n").over(_window(["range"])) - F.col("n")).alias("before"))
    place = ranged.withColumn("inside", inside).join(before, "range")
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("inside") - 1 + F.col("before")) % len(weights)).cast("int"))
    weighed = store.kept(place.select("source", "source_size", weight.cast("double").alias("weight")))
    # All targets below their stop are the same multiple of their weight.
    multiple = 0.0
    while True:
        full = F.col("weight") * F.lit(multiple) > F.col("source_size") * MOST_TIMES
        most = F.col("source_size") * MOST_TIMES
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, most).otherwise(0)).alias("stopped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not row["all"] or not row["weight"]:
            break
        following = (row["all"] - row["stopped"]) / row["weight"]
        if following <= multiple:
            break
        multiple = following
    target = F.least(F.col("weight") * F.lit(multiple), (F.col("source_size") * MOST_TIMES).cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def _window(*keys_and_order):
    *keys, order = keys_and_order
    return Window.partitionBy(*keys).orderBy(*order)


def fill(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length to take so that their words come near the budget.

    First the same share of every length. Then, while more is left than the dynamic programme holds,
    the longest that still fit. What is left is a bounded knapsack: the reachable sums are kept as the
    bits of one number per item, counts split in powers of two; the sum nearest to the budget (the
    smaller of two) is walked back.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    whole = int((lengths * counts).sum())
    if whole == 0 or budget <= 0:
        return taken
    if budget >= whole:
        return counts.copy()
    taken = np.floor(counts * (budget / whole)).astype(np.int64)
    rest = budget - float((taken * lengths).sum())
    for k in np.argsort(-lengths, kind="stable"):
        if rest <= PROGRAMME_WORDS:
            break
        if lengths[k] > 0:
            more = min(int(counts[k] - taken[k]), int((rest - PROGRAMME_WORDS) // lengths[k]))
            if more > 0:
                taken[k] += more
                rest -= more * float(lengths[k])
    free = counts - taken
    usable = np.flatnonzero((lengths > 0) & (free > 0))
    if not len(usable):
        return taken
    # More than fits can be nearer than less, but not beyond twice the rest: there, nothing is nearer.
    most = int(2 * rest) + 1
    items = []
    for k in usable:
        n = min(int(free[k]), most // int(lengths[k]))
        size = 1
        while n > 0:
            items.append((k, min(size, n)))
            n -= size
            size *= 2
    mask = (1 << (most + 1)) - 1
    near = int(rest)
    reach, steps = 1, []
    for k, n in items:
        wider = (reach | reach << (int(lengths[k]) * n)) & mask
        if wider != reach:
            steps.append((k, n, reach))
            reach = wider
        if reach >> near & 1:
            break
    below = next(s for s in range(near, -1, -1) if reach >> s & 1)
    above = next((s for s in range(near + 1, most + 1) if reach >> s & 1), None)
    best = above if above is not None and above - rest < rest - below else below
    for k, n, before in reversed(steps):
        if not before >> best & 1:
            taken[k] += n
            best -= n * int(lengths[k])
    return taken


_PICKS = "source string, size long, target double, source_size long, base long, n long, more long"


def _picks(histogram: pd.DataFrame) -> pd.DataFrame:
    out = histogram.sort_values("size", kind="stable").reset_index(drop=True)
    lengths, counts = out["size"].to_numpy(np.int64), out["n"].to_numpy(np.int64)
    target, whole = float(out["target"][0]), int(out["source_size"][0])
    base = min(MOST_TIMES, int(target // whole)) if whole else 0
    out["base"] = base
    out["more"] = fill(lengths, counts, target - base * whole) if base < MOST_TIMES else 0
    return out[["source", "size", "target", "source_size", "base", "n", "more"]]


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """How often the mix takes each document: one row per row of ``docs`` (``doc_id, source, text``).

    ``doc_id, size, source, source_size, target, times, taken, version`` (xxhash64 of the text);
    ``taken = times * size`` words. Every
    source is taken as often as it fits whole into its target; what is left is filled by a subset:
    documents are counted by exact length, ``fill`` says how many of each length, and a seeded order of
    ids says which. Sizes are whole texts' words; null has none. A source without words has target 0.
    Rows that are equal in id, source and text may take either's place. Extra columns play no part.

    The histogram of a source has a row per length, so it grows with the longest text, not with the
    rows; its source's lengths are filled in one task. Documents of one source and length are put in
    order in groups of about a thousand by a hash of their ids, so no group grows with the input.
    """
    sized = store.kept(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count().alias("size"),
            F.xxhash64(F.col("text").cast("string")).alias("version"),
        )
    )
    histogram = store.kept(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = source_targets(
        histogram.select("source", (F.col("size") * F.col("n")).alias("size")), weights
    )
    histogram = histogram.join(
        targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))
    ).drop("of")
    picks = store.kept(
        histogram.select("source", "size", "target", "source_size", "n")
        .groupBy("source")
        .applyInPandas(_picks, _PICKS)
    )
    chance = F.xxhash64("doc_id", F.lit(seed))
    named = picks.withColumnsRenamed({"source": "of", "size": "length"})
    placed = sized.join(
        named, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("length"))
    ).withColumn("chance", chance)
    # Only lengths of which some are taken need an order.
    some = F.expr("more > 0 and more < n")
    groups = F.ceil(F.col("n") / ORDERED_TOGETHER)
    placed = placed.withColumn("bucket", F.pmod("chance", groups)).drop("of", "length")
    partial = placed.where(some).groupBy("source", "size", "bucket").agg(F.count("*").alias("here"))
    earlier = F.sum("here").over(_window("source", "size", ["bucket"])) - F.col("here")
    partial = partial.select(
        F.col("source").alias("of"), F.col("size").alias("length"), F.col("bucket").alias("at"), earlier.alias("before")
    )
    joined = placed.join(
        partial,
        F.col("source").eqNullSafe(F.col("of")) & F.expr("size = length and bucket = at"),
        "left",
    )
    place = F.row_number().over(_window("source", "size", "bucket", ["chance", "doc_id", "version"]))
    joined = joined.withColumn("place", place)
    extra = F.when(some, (F.col("before") + F.col("place") <= F.col("more")).cast("long")).otherwise(
        (F.col("more") > 0).cast("long")
    )
    out = joined.withColumn("times", F.col("base") + extra)
    return out.select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        "times",
        (F.col("times") * F.col("size")).alias("taken"),
        "version",
    )
