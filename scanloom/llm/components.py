"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.store import kept


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of links ``a, b`` between longs: the smallest id that links reach.

    Alternates two steps until nothing changes: every id's larger neighbours are tied to its
    smallest, then its smaller ones. Each is an aggregation and a join, so an id with very many
    links is split over tasks by both. Ids that are their component's smallest have no row. Links
    that are null on a side or lead from an id to itself count for nothing.
    """
    edges = kept(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = tuple(state)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(small.union(least.select("u", F.col("m").alias("v"))).distinct())
