"""Groups of near items from entries that share a key, without pairs inside a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.components import components
from scanloom.llm.store import kept

#: Members of a key that are compared with each other at a time.
TILE = 256


def shared_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of keys with several entries, each with its key's hub; and pairs of hubs.

    ``entries`` holds longs and ints, ``key, id`` among them. They are dealt by ranges of (key, id), so a key
    of very many entries is spread over tasks; the hub is the smallest
    id where a key's entries begin in a task: Spark sorts by key alone, a batch of rows is put in order by id
    as well. A task passes once over its entries in order and holds one batch and one hub. Keys at the ends of a range may go on in the next: their hubs (two a task at most) are paired
    afterwards, each with the one of the smallest id.
    """
    names = ["key", "id", *[c for c in entries.columns if c not in ("key", "id")]]
    entries = entries.select(*names)
    partitions = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = entries.repartitionByRange(partitions, "key", "id").sortWithinPartitions("key")
    fields = list(entries.schema.fields)
    hub_fields = [T.StructField(f"hub_{f.name}", f.dataType) for f in fields[1:]]
    schema = T.StructType([*fields, *hub_fields, T.StructField("edge", T.BooleanType())])

    def rows(batches):
        hub = None  # the last group's first entry, and whether its entries have been handed on
        handed = opening = True
        for batch in batches:
            if not len(batch):
                continue
            key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            batch = batch.take(pa.array(np.lexsort((ids, key))))
            if hub is not None:
                batch = pa.concat_batches([hub, batch])
            key = batch.column(0).to_numpy()
            new = np.concatenate(([True], key[1:] != key[:-1]))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(key)))
            group = np.cumsum(new) - 1
            out = sizes > 1
            if hub is None:
                edge = batch.slice(0, 1)
                yield handed_on(edge, edge, True)
            if opening:
                # The first key may have begun in another task.
                out[0] = True
            wanted = out[group]
            if hub is not None and handed:
                wanted[0] = False
            at = np.flatnonzero(wanted)
            yield handed_on(batch.take(pa.array(at)), batch.take(pa.array(starts[group[at]])), False)
            opening = opening and len(starts) == 1
            handed = bool(out[-1]) or (handed and hub is not None and len(starts) == 1)
            hub = batch.slice(int(starts[-1]), 1)
        if hub is not None:
            yield handed_on(hub, hub, True)
            if not handed:
                yield handed_on(hub, hub, False)

    def handed_on(own, hubs, edge):
        flag = pa.array(np.full(len(own), edge))
        columns = [*own.columns, *hubs.columns[1:], flag]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = kept(ranged.mapInArrow(rows, schema))
    edges = found.where("edge").select(*names).distinct()
    least = edges.groupBy("key").agg(F.min("id").alias("least")).withColumnRenamed("key", "of")
    hubs = kept(edges.join(least, F.expr("key = of")))
    pairs = hubs.where("id = least").alias("a").join(hubs.where("id <> least").alias("b"), "key")
    return found.where("not edge").drop("edge"), pairs


def near_groups(
    entries: DataFrame,
    near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    rest: Callable[[DataFrame], DataFrame],
    carry: Sequence[Column] = (),
) -> DataFrame:
    """``id, component`` over all links between ids that share a key, pass ``near`` and ``verify``.

    ``entries`` holds ``key, id`` and what ``near`` compares. Two rounds reach the same components as
    all pairs would: first every entry is paired with its key's hub only, a star of as many rows as
    the key has entries; what that links needs no further pairs among itself. ``verify`` gets these pairs
    ``a, b`` and the entries of all shared keys. Then ``rest`` finds the
    links between different components of the first round that still share a key, from the entries
    of such keys, ``key, id, label`` and ``carry`` (columns over ``entries``). So a key with very many near copies costs its size, not its
    square, and no pair that could join two components is left out.
    """
    shared, hubs = shared_entries(entries)

    def sides(pairs: DataFrame) -> DataFrame:
        return pairs.where(near(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))).select(
            F.col("a.id").alias("a"), F.col("b.id").alias("b")
        )

    star = shared.where("id <> hub_id").where(near(lambda c: F.col(f"hub_{c}"), F.col))
    star = star.select(F.col("hub_id").alias("a"), F.col("id").alias("b")).union(sides(hubs))
    first = kept(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = components(verify(first, shared))
    label = F.coalesce("component", F.col("id")).alias("label")
    labelled = shared.join(found, "id", "left").select("key", "id", label, *carry)
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    still = kept(labelled.join(open_keys.where("lo < hi").select("key"), "key"))
    # What the first round found is a star for each component, so only the new links take rounds.
    return components(found.toDF("a", "b").union(rest(still)))


def tiles(members: DataFrame) -> DataFrame:
    """``members`` with ``tile, part``: members of a key, those of large keys in pairs of parts.

    Each two members of a key meet in one tile: in the tile of their part, or in that of their two
    parts, where only members of different parts are to be compared.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    placed = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = placed.select(*members.columns, "part", other)
    tile = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    return dealt.withColumn("tile", tile).withColumn("alone", F.col("part") == F.col("other"))


def by_tile(batches, handle):
    """Hands the rows of one tile after another to ``handle``; rows come sorted by their first column."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        if rest is not None and len(rest):
            batch = pa.concat_batches([rest, batch])
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        rest = batch.slice(cut)
        if cut:
            yield from handle(batch.slice(0, cut))
    if rest is not None and len(rest):
        yield from handle(rest)


def smallest_labels(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of some items the smallest id that its links (by place) reach."""
    label = ids.copy()
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        if (least == label).all():
            return label
        label = least
