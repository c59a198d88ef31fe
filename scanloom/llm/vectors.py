"""Near duplicates among embeddings by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import store
from scanloom.llm.components import components
from scanloom.llm.links import by_tile, smallest_labels

#: Share of pairs just at the threshold that may be missed, by which the number of tables is set.
MISSED = 0.001
#: Numbers in the pairs that are tried to learn how often a table keeps a pair together.
TRIED = 1 << 18
#: Other buckets each vector looks into, per table.
PROBES = 3
#: Vectors of a bucket that are compared with each other at a time.
TILE = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    width = 1
    while width < d:
        y = x.reshape(n, d // (2 * width), 2, width)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(n, d)
        width *= 2
    return x / math.sqrt(d)


class CrossPolytope:
    """Buckets of unit vectors: per table the nearest signed axis after each of some rotations."""

    def __init__(self, tables: int, hashes: int, seed: int = 3) -> None:
        self.tables, self.hashes, self.seed = tables, hashes, seed

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + PROBES): the own bucket, then the next likely ones."""
        n, dims = unit.shape
        d = max(2, 1 << (dims - 1).bit_length())
        wide = np.zeros((n, d))
        wide[:, :dims] = unit
        rng = np.random.default_rng([self.seed, d])
        out = np.empty((n, self.tables, 1 + PROBES), dtype=np.int64)
        for table in range(self.tables):
            axes, losses = [], []
            for _ in range(self.hashes):
                x = wide
                for _ in range(3):
                    x = hadamard(x * rng.choice([-1.0, 1.0], d))
                size = np.abs(x)
                depth = min(d, 1 + PROBES)
                top = np.argsort(-size, axis=1, kind="stable")[:, :depth]
                ordered = np.take_along_axis(size, top, axis=1)
                negative = np.take_along_axis(x, top, axis=1) < 0
                axes.append(top * 2 + negative)
                losses.append(ordered[:, :1] - ordered)
            base = [2 * d] * self.hashes
            weight = np.array([math.prod(base[k + 1 :]) for k in range(self.hashes)], dtype=np.int64)
            own = sum(axes[k][:, 0] * weight[k] for k in range(self.hashes))
            # Probes change one of the hashes to a further axis, the smallest loss first.
            other = np.concatenate(
                [own[:, None] + (axes[k][:, 1:] - axes[k][:, :1]) * weight[k] for k in range(self.hashes)], axis=1
            )
            loss = np.concatenate([losses[k][:, 1:] for k in range(self.hashes)], axis=1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
            found = np.take_along_axis(other, best, axis=1)
            out[:, table, 0] = own
            out[:, table, 1:] = own[:, None]
            out[:, table, 1 : 1 + found.shape[1]] = found
        return out


def kept_together(dims: int, least: float, hashes: int) -> float:
    """The share of pairs with a cosine of ``least`` that meet in a table, probes of both included.

    Tried out on random pairs, always the same, less two standard errors.
    """
    pairs = max(100, min(2000, TRIED // max(dims, 1)))
    rng = np.random.default_rng(5)
    u, w = rng.normal(size=(2, pairs, dims))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    length = np.linalg.norm(w, axis=1, keepdims=True)
    w = np.divide(w, length, out=np.zeros_like(w), where=length > 1e-9)
    least = min(max(least, -1.0), 1.0)
    hasher = CrossPolytope(1, hashes)
    a, b = (hasher.codes(x)[:, 0] for x in (u, least * u + math.sqrt(1 - least * least) * w))
    share = ((a[:, :1] == b) | (b[:, :1] == a)).any(axis=1).mean()
    return float(share - 2 * math.sqrt(share * (1 - share) / pairs))


def plan(n: int, dims: int, least: float = 0.9) -> tuple[int, int]:
    """Hashes a table and tables, for so many vectors: buckets hold a few, whatever the number.

    There are as many tables as it takes for pairs just at ``least`` to be missed with a chance of MISSED;
    where a table of so many hashes keeps hardly any of them, it has fewer hashes.
    """
    axes = 2 * max(2, 1 << (max(dims, 1) - 1).bit_length())
    hashes = min(max(1, round(math.log(max(n, 2)) / math.log(axes))), int(60 / math.log2(axes)))
    together = kept_together(max(dims, 1), least, hashes)
    while together < 0.02 and hashes > 1:
        hashes -= 1
        together = kept_together(max(dims, 1), least, hashes)
    together = min(max(together, 0.02), 1 - MISSED)
    return max(1, math.ceil(math.log(MISSED) / math.log(1 - together))), hashes


def _coded(classes: DataFrame, tables: int, hashes: int) -> DataFrame:
    """Classes with the buckets of all tables."""
    hasher = CrossPolytope(tables, hashes)

    def rows(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("v"))
            sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
            values = column.flatten().to_numpy()
            first = np.concatenate(([0], np.cumsum(sizes)))
            out = np.zeros((len(column), tables * (1 + PROBES)), dtype=np.int64)
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                x = values[first[at][:, None] + np.arange(dims)]
                # Scaled before squaring, so that very small and very large numbers keep their length.
                x = x / np.abs(x).max(axis=1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                out[at] = hasher.codes(unit).reshape(len(at), -1)
            codes = pa.ListArray.from_arrays(
                pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], names=[*batch.schema.names, "codes"])

    return classes.mapInArrow(rows, "id long, v array<double>, n long, codes array<long>")


def _tiles(coded: DataFrame, tables: int) -> DataFrame:
    """Members of each bucket, those of large buckets in pairs of tiles of bounded size."""
    width = 1 + PROBES
    place = F.posexplode("codes").alias("place", "code")
    entries = coded.select("id", F.size("v").alias("dims"), place).select(
        F.xxhash64("dims", F.floor(F.col("place") / width), "code").alias("bucket"),
        F.floor(F.col("place") / width).cast("int").alias("table"),
        (F.col("place") % width == 0).alias("own"),
        "id",
    )
    # A probe may repeat the own bucket where a vector has few axes.
    entries = entries.groupBy("bucket", "table", "id").agg(F.max("own").alias("own"))
    sizes = (
        entries.groupBy("bucket")
        .agg(F.count("*").alias("members"), F.sum(F.col("own").cast("int")).alias("owners"))
        .where("members > 1 and owners > 0")
        .select("bucket", F.ceil(F.col("members") / TILE).cast("int").alias("parts"))
    )
    placed = entries.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    both = F.expr(
        "transform(sequence(0, parts - 1), i -> named_struct('x', part, 'y', i, 'left', own, 'right', i = part))"
    )
    other = F.expr(
        "transform(filter(sequence(0, parts - 1), i -> i <> part), "
        "i -> named_struct('x', i, 'y', part, 'left', false, 'right', true))"
    )
    tiles = F.explode(F.when(F.col("own"), F.concat(both, other)).otherwise(F.concat(F.slice(both, F.col("part") + 1, 1), other)))
    return placed.select("bucket", "table", "id", "own", tiles.alias("t")).select(
        F.xxhash64("bucket", "t.x", "t.y").alias("tile"), "table", "id", "own", "t.left", "t.right"
    )


def _compared(members: DataFrame, percent: float) -> DataFrame:
    """Per tile: of each vector how many vectors it is linked with, and a link that ties it to its group.

    A pair that meets in several buckets counts in the first of them only, which both sides' codes
    tell. Of the links of a tile only a spanning part leaves it, so rows grow with the members.
    """
    width = 1 + PROBES

    def tile(ids, own, left, right, table, v, n, codes):
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        if not len(a) or not len(b) or len(ids) < 2:
            return None
        i, j = np.nonzero(v[a] @ v[b].T >= percent)
        i, j = a[i], b[j]
        # Where both own the bucket, the pair is seen from both sides.
        once = (ids[i] != ids[j]) & (~own[j] | (ids[i] < ids[j]))
        i, j = i[once], j[once]
        if not len(i):
            return None
        met = np.zeros(len(i), dtype=bool)
        for t in range(table):
            met |= (codes[i, t, :1] == codes[j, t]).any(axis=1) | (codes[j, t, :1] == codes[i, t]).any(axis=1)
        # In this table, the bucket that the smaller id owns comes first.
        low, high = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        low_owns = (low == i) | own[j]
        met |= ~low_owns & (codes[low, table, :1] == codes[high, table]).any(axis=1)
        i, j = i[~met], j[~met]
        if not len(i):
            return None
        links = np.bincount(i, weights=n[j], minlength=len(ids)) + np.bincount(j, weights=n[i], minlength=len(ids))
        label = smallest_labels(ids, i, j)
        some = links > 0
        return ids[some], label[some], links[some].astype(np.int64)

    def compared(batch):
        keys = batch.column(0).to_numpy()
        table, ids = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        own, left, right = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
        n = batch.column(7).to_numpy()
        values, codes = batch.column(6), batch.column(8)
        sizes = pa.compute.list_value_length(values).to_numpy()
        first = np.concatenate(([0], np.cumsum(sizes)))
        flat = values.flatten().to_numpy()
        codes = codes.flatten().to_numpy().reshape(len(keys), -1, width)
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        out = []
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            v = flat[first[x] : first[y]].reshape(y - x, -1)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            s = slice(x, y)
            found = tile(ids[s], own[s], left[s], right[s], int(table[x]), v, n[s], codes[s])
            if found is not None:
                out.append(found)
        if out:
            yield pa.record_batch(
                {
                    "a": pa.array(np.concatenate([o[0] for o in out])),
                    "b": pa.array(np.concatenate([o[1] for o in out])),
                    "links": pa.array(np.concatenate([o[2] for o in out])),
                }
            )

    return members.mapInArrow(lambda batches: by_tile(batches, compared), "a long, b long, links long")


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors`` (``vec_id, embedding``).

    Two vectors link when their cosine in double precision is ``least`` or more. Equal vectors are one
    class; classes are hashed into buckets by the nearest signed axis after random signs and fast
    Hadamard transforms, several hashes a table, several tables, and look into the next likely buckets
    too. All vectors that meet in a bucket are compared; buckets above TILE vectors in pairs of tiles.
    Every link has been verified; of the links that exist nearly all are found: the number of tables
    follows from ``least`` and the dimensions, so that of pairs just at it one in a thousand is missed.
    Other columns play no part; an empty table has no rows.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
    their own component; so do rows with a null id, whose component is null. Vectors of different
    length do not link. Rows that repeat an id and vector link with each other as copies do.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")
    )
    good = F.expr(
        "id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) "
        "or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    )
    # Adding 0 turns -0 into 0. Equal vectors, 128 bits of hash, are one class; no class holds null.
    values = F.when(good, F.transform("v", lambda x: x + F.lit(0.0)))
    marked = rows.select("id", values.alias("v")).select(
        "id",
        "v",
        F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"),
        F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(1))).alias("h2"),
    )
    classes = marked.where("v is not null").groupBy("h1", "h2").agg(
        F.min("id").alias("first"), F.count("*").alias("n"), F.first("v").alias("v")
    )
    classes = store.kept(classes)
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    tables, hashes = plan(size["n"], size["dims"] or 1, least)
    coded = store.kept(_coded(classes.select(F.col("h1").alias("id"), "v", "n"), tables, hashes))
    members = _tiles(coded, tables).join(coded, "id")
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = (
        members.select("tile", "table", "id", "own", "left", "right", "v", "n", "codes")
        .repartition(partitions, "tile")
        .sortWithinPartitions("tile")
    )
    found = store.kept(_compared(members, least))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    groups = components(found.select("a", "b"))
    named = (
        classes.select(F.col("h1").alias("id"), "h2", "first", "n")
        .join(links.withColumnRenamed("a", "id"), "id", "left")
        .join(groups, "id", "left")
        .select(
            F.col("id").alias("h1"),
            "h2",
            "first",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("label"),
        )
    )
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "label").select("h1", "h2", "n_links", "component_id")
    keyed = marked.select("id", "h1", "h2")
    out = keyed.join(named, ["h1", "h2"], "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
