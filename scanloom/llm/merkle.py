"""Merkle trees over the rows of a table, a subtree per group, with a proof for every row.

A level of a tree is kept as concatenated strings: an aligned block of neighbouring nodes is one string
of their hex digests, each at a fixed place. SQL substrings of fixed width hash a block's runs to its
next level, up to one node a block; these nodes are the leaves of the next round. On the way down, the
substrings beside a node are its siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm import store

#: Levels of a block, by which it holds ``fanout ** LEVELS`` nodes.
LEVELS = 8
#: Hex digits of a digest.
HEX = 64


def digest(text: Column) -> Column:
    """Lower-case hex sha256 of a string's bytes."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: its bytes' number, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The leaf of a row of these values."""
    return digest(F.concat(*[field(v) for v in values]))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path of siblings give."""
    return F.aggregate(path, leaf, lambda node, run: digest(F.concat(run["l"], node, run["r"])))


def path_digest(path: Column) -> Column:
    """The digest of a path's siblings, concatenated from the leaf's level to the root's."""
    return digest(F.array_join(F.transform(path, lambda run: F.concat(run["l"], run["r"])), ""))


def _numbered(nodes: DataFrame) -> DataFrame:
    """Nodes ``g, o, h, carry`` with ``k``, their place in the group by (o, h), and ``n``, the group's size.

    Rows are dealt by ranges, numbered in their range, and moved on by the rows of the group's earlier
    ranges, so that a group of any size is many tasks' work.
    """
    keys = [F.col("g").asc_nulls_first(), F.col("o").asc_nulls_first(), F.col("h")]
    # The last key parts equal rows, whose order does not show.
    dealt = nodes.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys)
    dealt = store.kept(dealt.withColumn("at", F.monotonically_increasing_id()))
    ranges = dealt.groupBy("g", F.shiftright("at", 33).alias("range"))
    ranges = ranges.agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("g")
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("g").alias("of"),
        F.col("range").alias("at_range"),
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(whole).alias("n"),
    )
    same = F.col("g").eqNullSafe(F.col("of")) & (F.shiftright("at", 33) == F.col("at_range"))
    return dealt.join(ranges, same).select("g", (F.col("at") + F.col("shift")).alias("k"), "n", "h", "carry")


def _blocks(nodes: DataFrame, fanout: int) -> DataFrame:
    """Blocks ``g, b, n, nodes, levels, steps`` of nodes ``g, k, n, h, carry``.

    A block of a group of several goes up LEVELS steps, a lone node as often as it takes; a group's only
    block goes up to one node.
    """
    width = fanout**LEVELS
    blocks = nodes.groupBy("g", F.floor(F.col("k") / width).alias("b")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "h", "carry"))).alias("nodes")
    )
    steps = sum((F.col("n") > fanout**level).cast("int") for level in range(LEVELS))

    def parents(level: Column) -> Column:
        runs = F.sequence(F.lit(1), F.octet_length(level), F.lit(HEX * fanout))
        hashed = F.transform(runs, lambda at: F.sha2(F.substring(level, at, F.lit(HEX * fanout)), 256))
        return F.array_join(hashed, "").cast("binary")

    first = F.array_join(F.transform("nodes", lambda x: x["h"]), "").cast("binary")
    # Binary, so that a substring is found by its place.
    levels = F.aggregate(
        F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), F.lit(1), F.col("steps")),
        F.array(first),
        lambda done, _: F.concat(done, F.array(parents(F.element_at(done, -1)))),
    )
    return blocks.withColumn("steps", steps).withColumn("levels", levels)


def _up(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of all rounds, and ``g, h``: each group's root."""
    rounds = []
    nodes = store.kept(nodes)
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        blocks = store.kept(_blocks(nodes, fanout))
        rounds.append(blocks)
        nodes = blocks.select(
            "g",
            F.col("b").alias("k"),
            F.ceil(F.col("n") / fanout**LEVELS).alias("n"),
            F.element_at("levels", -1).cast("string").alias("h"),
            F.lit(None).cast("string").alias("carry"),
        )
    return rounds if rounds else [nodes], nodes.select("g", "h")


def _down(rounds: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """``h, carry, path, facts`` of the leaves, from ``g, path, facts`` of each group's root."""
    above = tops.withColumn("k", F.lit(0).cast("long"))
    if "levels" not in rounds[0].columns:
        same = F.col("nodes.g").eqNullSafe(F.col("tops.g"))
        return rounds[0].alias("nodes").join(above.alias("tops"), same).select("h", "carry", "path", "facts")

    def sibling(level: Column, node: Column) -> Column:
        first = node - node % fanout

        def cut(start: Column, count: Column) -> Column:
            return F.substring(level, (start * HEX + 1).cast("int"), (count * HEX).cast("int")).cast("string")

        return F.struct(
            cut(first, node - first).alias("l"), cut(node + 1, first + fanout - node - 1).alias("r")
        )

    def path(place: Column) -> Column:
        inner = F.transform(
            F.slice(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.lit(1), F.col("steps")),
            lambda level: sibling(
                F.element_at("levels", level + 1), F.floor(place / F.pow(F.lit(float(fanout)), level.cast("double")))
            ),
        )
        return F.concat(inner, F.col("path"))

    for blocks in reversed(rounds):
        same = F.col("blocks.g").eqNullSafe(F.col("above.g")) & (F.col("b") == F.col("above.k"))
        joined = blocks.alias("blocks").join(above.alias("above"), same).select("blocks.*", "path", "facts")
        rows = F.transform(
            "nodes",
            lambda x, place: F.struct(
                x["k"].alias("k"), x["h"].alias("h"), x["carry"].alias("carry"), path(place).alias("path")
            ),
        )
        above = joined.select("g", "facts", F.inline(rows)).select("g", "k", "h", "carry", "path", "facts")
    return above.select("h", "carry", "path", "facts")


def manifest(
    rows: DataFrame, group: Column, order: Column, leaf: Column, carry: Column | None = None, fanout: int = 2
) -> DataFrame:
    """``leaf, carry, subroot, root, path`` for each of ``rows``.

    Leaves ascend by ``order`` within their ``group`` (null first; equal ones by leaf). While a group has
    more than one node, every ``fanout`` neighbours become the digest of their digests as one string, the
    last ones also where they are fewer; a lone leaf is its group's subroot as it is. Subroots, ascending
    by group (null first), go up to the root in the same way. ``path`` is an array of (l, r), from the
    leaf to the root: the siblings in front of and behind the node, either may be empty; ``folded`` and
    ``path_digest`` work on it. ``carry`` is handed through and must be of a type that can be sorted.

    Rows that are equal in group, order and leaf all stay and have neighbouring places; which has which
    does not show. Any column may be null or have any name, as only expressions are looked at. An empty
    table has no rows here. Long values are only hashed.
    """
    carry = F.lit(None).cast("string") if carry is None else carry
    nodes = rows.select(group.alias("g"), order.alias("o"), leaf.alias("h"), carry.alias("carry"))
    # Written first, as the leaves read whole rows and the ranges are chosen from them.
    below, subroots = _up(_numbered(store.kept(nodes)), fanout)
    groups = subroots.select(
        F.lit(0).alias("g"), F.col("g").alias("o"), "h", F.struct(F.col("g").alias("of")).alias("carry")
    )
    above, root = _up(_numbered(groups), fanout)
    start = root.select(
        "g", F.array().cast("array<struct<l: string, r: string>>").alias("path"), F.col("h").alias("facts")
    )
    tops = _down(above, start, fanout).select(
        F.col("carry.of").alias("g"), "path", F.struct(F.col("h").alias("subroot"), F.col("facts").alias("root")).alias("facts")
    )
    return _down(below, store.kept(tops), fanout).select(
        F.col("h").alias("leaf"), "carry", "facts.subroot", "facts.root", "path"
    )
