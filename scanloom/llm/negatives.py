"""Hard negatives by threshold joins: which rows score highest with an anchor, within a window.

All scores are exact inner products of whole numbers. Rows that are equal in vector and label are one
unit, so that a group of copies is compared once. Units are packed to blocks by ranges of their norm.
For a set of anchors and their thresholds a block is an inverted index in the manner of L2AP: the
dimensions in front, as far as the bound by their norm stays below every anchor's threshold, are left
out of it; the dimensions behind add up partial scores; a unit whose partial score and the norms of
what is left cannot reach the threshold is dropped; the others are completed dimension range by
dimension range, and dropped as soon as the norms of the rest no longer suffice. Thresholds start
where a few results are to be expected and go down for the anchors whose windows did not fill, until
they fill or the threshold passes the window's lower end, below which nothing counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm import store

#: Units of a block, anchors of a cell, and blocks that one task compares with a cell.
BLOCK, CELL, GROUP = 4096, 512, 8
#: Dimensions that are added between two looks at the bound.
RANGE = 8
#: Results expected above the first threshold, for each one wanted, and the factor of each next round.
SURPLUS, NEXT = 4.0, 8.0
#: Largest sum of products for which floating point is exact.
EXACT = float(1 << 53)
#: Parts into which the anchors of one unit are dealt.
SALTS = 64

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_KINDS = {2: "<i2", 4: "<i4", 8: "<f8"}


def _norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def _units(rows: DataFrame, keep: int) -> DataFrame:
    """``u1, u2, tag, v, ids, chosen``: the different (label, vector), named by 128 bits of hash, with
    their ``keep`` smallest ids and whether one of them is an anchor."""
    units = rows.groupBy("u1", "u2").agg(
        F.first("tag").alias("tag"), F.first("v").alias("v"), F.max("chosen").alias("chosen")
    )
    # Rows that repeat an id count once. The smallest ids are chosen in every task first.
    first = Window.partitionBy("u1", "u2").orderBy("id")
    ids = rows.select("id", "u1", "u2").distinct().withColumn("place", F.row_number().over(first))
    ids = ids.where(F.col("place") <= keep).groupBy("u1", "u2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return units.join(ids, ["u1", "u2"])


def _packed(units: DataFrame) -> DataFrame:
    """Blocks of units of one number of dimensions, near to each other in norm, as binary columns."""
    # The norm decides which units share a block; no result depends on it.
    keys = ["dims", "norm", "u1"]
    dealt = units.select("u1", "u2", "tag", "v", "ids", F.size("v").alias("dims"), _norm("v").alias("norm"))
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        n, dims = len(table), table.column("dims")[0].as_py()
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(n, dims)
        top = np.abs(v).max() if v.size else 0.0
        width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
        out = {
            "dims": pa.array([dims], pa.int32()),
            "norm": pa.array([table.column("norm")[n - 1].as_py()], pa.float64()),
            "n": pa.array([n], pa.int64()),
            "width": pa.array([width], pa.int32()),
            "v": pa.array([v.astype(_KINDS[width]).tobytes()], pa.binary()),
        }
        for name in ("tag", "u1", "u2"):
            out[name] = pa.array([table.column(name).to_numpy().astype("<i8").tobytes()], pa.binary())
        # The smallest id of each unit decides ties.
        first = pa.compute.list_element(table.column("ids"), 0).to_numpy().astype("<i8")
        out["first"] = pa.array([first.tobytes()], pa.binary())
        for name, sums in (("sums", v.sum(axis=0)), ("squares", (v * v).sum(axis=0))):
            out[name] = pa.array([sums], pa.list_(pa.float64()))
        return pa.record_batch(out)

    def rows(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0].column("dims")[0].as_py() != dims[a]:
                    yield block(held)
                    held, n = [], 0
                while a < b:
                    some = min(b - a, BLOCK - n)
                    held.append(batch.slice(a, some))
                    a, n = a + some, n + some
                    if n == BLOCK:
                        yield block(held)
                        held, n = [], 0
        if held:
            yield block(held)

    schema = (
        "dims int, norm double, n long, width int, v binary, tag binary, u1 binary, u2 binary, first binary, "
        "sums array<double>, squares array<double>"
    )
    return dealt.mapInArrow(rows, schema)


class Index:
    """A block's vectors as an inverted index for anchors whose thresholds are ``least`` or more."""

    def __init__(self, v: np.ndarray, anchors: np.ndarray, least: float) -> None:
        n, d = v.shape
        self.exact = self._exact(v, anchors)
        # The dimensions with the largest values come last and are added first.
        order = np.argsort(np.abs(v).sum(axis=0) if n else np.zeros(d), kind="stable")
        self.v, self.anchors = v[:, order], anchors[:, order]
        self.edges = [*range(0, d, RANGE), d]
        self.norms = self._prefix_norms(self.v)
        self.anchor_norms = self._prefix_norms(self.anchors)
        # Ranges left out: all in front whose bound stays below the least threshold.
        top = self.anchor_norms.max(axis=0) if len(anchors) else np.zeros(len(self.edges))
        self.cut = (self.norms * top < least).sum(axis=1) - 1
        self.cut = np.maximum(self.cut, 0)

    @staticmethod
    def _exact(v: np.ndarray, anchors: np.ndarray) -> bool:
        a, b = (np.sqrt((x * x).sum(axis=1).max()) if len(x) else 0.0 for x in (v, anchors))
        return a * b < EXACT

    def _prefix_norms(self, x: np.ndarray) -> np.ndarray:
        """The norm of the first dimensions up to each edge, a little above what it is."""
        sums = np.zeros((len(x), x.shape[1] + 1))
        np.cumsum(x * x, axis=1, out=sums[:, 1:])
        return np.sqrt(sums[:, self.edges]) * (1 + 1e-9)

    def _product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a @ b.T if self.exact else a.astype(np.int64) @ b.astype(np.int64).T

    def _paired(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.exact:
            return np.einsum("ij,ij->i", a, b)
        return (a.astype(np.int64) * b.astype(np.int64)).sum(axis=1)

    def pairs(self, t: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (anchor, vector, score) with a score of the anchor's ``t`` or more, where ``wanted`` of
        the anchors and some vectors says that a pair is of interest."""
        found = []
        for cut in np.unique(self.cut):
            rows = np.flatnonzero(self.cut == cut)
            start = self.edges[cut]
            partial = self._product(self.anchors[:, start:], self.v[rows, start:])
            alive = partial + np.outer(self.anchor_norms[:, cut], self.norms[rows, cut]) >= t[:, None]
            alive &= wanted(rows)
            a, i = np.nonzero(alive)
            score, i = partial[a, i], rows[i]
            for k in range(cut - 1, -1, -1):
                x, y = self.edges[k], self.edges[k + 1]
                score = score + self._paired(self.anchors[a, x:y], self.v[i, x:y])
                stays = score + self.anchor_norms[a, k] * self.norms[i, k] >= t[a]
                a, i, score = a[stays], i[stays], score[stays]
            found.append((a, i, score))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        a, i, score = (np.concatenate(x) for x in zip(*found, strict=True))
        exact = score >= t[a]
        return a[exact], i[exact], score[exact].astype(np.int64)


def _best(anchor: np.ndarray, score: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the first ``most`` of their anchor, by score and then smallest id."""
    order = np.lexsort((first, -score, anchor))
    ordered = anchor[order]
    begin = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, bool)
    index = np.arange(len(order))
    return order[index - np.maximum.accumulate(np.where(begin, index, 0)) < most] if len(order) else order


def _joined(blocks: DataFrame, n_blocks: int, anchors: DataFrame, same: bool, most: int) -> DataFrame:
    """``a1, a2, slot, u1, u2, first, score``: of each block the first ``most`` units of every anchor
    and window with a score of the anchor's threshold or more.

    ``anchors`` have ``u1, u2, tag, v, t, wins array<struct<slot, low, high>>``. Every cell of anchors
    meets every group of blocks: cells are repeated for the groups, blocks for the cells.
    """
    cells = max(1, math.ceil(anchors.count() / CELL))
    groups = max(1, math.ceil(n_blocks / GROUP))
    cell = F.pmod(F.xxhash64("u1", F.lit(7)), F.lit(cells)).cast("int")
    packed = anchors.groupBy(cell.alias("cell"), F.size("v").alias("dims")).agg(
        F.collect_list(F.struct("u1", "u2", "tag", "v", "t", "wins")).alias("anchors"),
        F.min("t").alias("least"),
        F.max(_norm("v")).alias("anchor_norm"),
    )
    packed = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    part = F.pmod(F.xxhash64("u1", "first"), F.lit(groups)).cast("int")
    dealt = blocks.select(
        "dims", "norm", "width", "v", "tag", "u1", "u2", "first",
        part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"),
    )
    met = dealt.join(packed, ["cell", "part", "dims"])
    # The norms may forbid any result; a little more than they are, as they are rounded.
    met = met.where(F.col("norm") * F.col("anchor_norm") * (1 + 1e-9) >= F.col("least"))

    def tile(block: dict):
        anchors, dims = block["anchors"], block["dims"]
        tag, u1, u2, first = (np.frombuffer(block[k], "<i8") for k in ("tag", "u1", "u2", "first"))
        v = np.frombuffer(block["v"], _KINDS[block["width"]]).astype(np.float64).reshape(len(tag), dims)
        q = np.array([x["v"] for x in anchors], dtype=np.float64).reshape(len(anchors), dims)
        t = np.array([x["t"] for x in anchors])
        tags, a1, a2 = (np.array([x[k] for x in anchors], dtype=np.int64) for k in ("tag", "u1", "u2"))
        index = Index(v, q, float(t.min()))
        a, i, score = index.pairs(t, lambda rows: (tags[:, None] == tag[rows]) == same)
        for k in range(max(len(x["wins"]) for x in anchors)):
            wins = [x["wins"][k] if k < len(x["wins"]) else {"slot": 0, "low": 1, "high": 0} for x in anchors]
            slot, low, high = (np.array([w[name] for w in wins], dtype=np.int64) for name in ("slot", "low", "high"))
            inside = np.flatnonzero((score >= low[a]) & (score <= high[a]))
            chosen = inside[_best(a[inside], score[inside], first[i[inside]], most)]
            if len(chosen):
                x, y = a[chosen], i[chosen]
                columns = (a1[x], a2[x], slot[x], u1[y], u2[y], first[y], score[chosen])
                names = ("a1", "a2", "slot", "u1", "u2", "first", "score")
                yield pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from tile({n: c[k].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)})

    met = met.select("dims", "width", "v", "tag", "u1", "u2", "first", "anchors")
    return met.mapInArrow(rows, "a1 long, a2 long, slot long, u1 long, u2 long, first long, score long")


def _first_rows(found: DataFrame, units: DataFrame, most: int) -> DataFrame:
    """``a1, a2, slot, place, id, u1, u2, score``: the first ``most`` rows of each anchor and window."""
    each = Window.partitionBy("a1", "a2", "slot")
    place = F.row_number().over(each.orderBy(F.col("score").desc(), "first", "u1", "u2"))
    # The first rows stand in the units whose own first rows come first.
    best = found.withColumn("place", place).where(F.col("place") <= most).drop("place", "first")
    rows = best.join(units.select("u1", "u2", "ids"), ["u1", "u2"])
    rows = rows.select("a1", "a2", "slot", "u1", "u2", "score", F.explode("ids").alias("id"))
    place = F.row_number().over(each.orderBy(F.col("score").desc(), "id", "u1", "u2"))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def _above(share: Column) -> Column:
    """How many standard deviations above the mean that share of a normal distribution begins, nearly
    (a rational approximation of the tables); the least number from a half on."""
    s = F.sqrt(-2 * F.log(share))
    z = s - (2.30753 + 0.27061 * s) / (1 + 0.99229 * s + 0.04481 * s * s)
    return F.when(share < 0.5, z).otherwise(F.lit(-math.inf))


def _share_above(z: Column) -> Column:
    """The share of a normal distribution above so many standard deviations, nearly."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.070565776 * z * z * z, F.lit(700.0))))


def _with_moments(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Anchors with ``mean`` and ``spread``, what their scores with all units should have."""
    at = F.arrays_zip("sums", "squares")
    sums = blocks.select("dims", "n", F.posexplode(at).alias("at", "x")).groupBy("dims", "at")
    sums = sums.agg((F.sum("x.sums") / F.sum("n")).alias("m"), (F.sum("x.squares") / F.sum("n")).alias("s"))
    sums = sums.groupBy(F.col("dims").alias("of")).agg(F.array_sort(F.collect_list(F.struct("at", "m", "s"))).alias("sums"))
    joined = anchors.join(sums, F.size("v") == F.col("of"), "left")
    mean = F.aggregate(F.zip_with("v", "sums", lambda x, y: x * y["m"]), F.lit(0.0), lambda a, x: a + x)
    spread = F.aggregate(
        F.zip_with("v", "sums", lambda x, y: x * x * (y["s"] - y["m"] * y["m"])), F.lit(0.0), lambda a, x: a + x
    )
    return joined.withColumn("mean", mean).withColumn("spread", F.sqrt(F.greatest(spread, F.lit(0.0)))).drop("of", "sums")


def _threshold(share: Column, least: Column) -> Column:
    t = F.col("mean") + _above(share) * F.col("spread")
    # What is not a number, or has no spread, is no threshold.
    return F.greatest(F.when(F.isnan(t) | t.isNull(), F.lit(-math.inf)).otherwise(t), least)


def mine_negatives(
    vectors: DataFrame,
    anchor: Column,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from rows
    ``vec_id, embedding, label``.

    Components are multiplied by ``scale`` and rounded down; a score is the inner product of the whole
    numbers, which must fit a long (components beyond a long count as the longest). An anchor is a row
    for which ``anchor`` holds. Its positives are its first ``positives`` other rows of the same label;
    higher scores come first, then smaller ids. Beside each positive of score p its negatives are the
    first ``negatives`` rows of another label with a score s of low * p <= 100 * s <= high * p.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Only
    vectors of equal length meet; empty ones have score 0. Rows that repeat id, label and vector are one
    row; rows that share an id only are rows of their own. Anchors without positives or without
    negatives have no rows. An empty table has none. Other columns are not looked at, except by
    ``anchor``.
    """
    label = F.col("label")
    tag = label.cast("long") if dict(vectors.dtypes)["label"] in _WHOLE else F.xxhash64(label)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("id"),
        F.when(label.isNotNull(), tag).alias("tag"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.coalesce(anchor, F.lit(False)).alias("chosen"),
    )
    rows = rows.where(
        "id is not null and tag is not null and x is not null "
        "and not exists(x, y -> y is null or isnan(y) or abs(y) = double('infinity'))"
    )
    v = F.transform("x", lambda y: F.floor(y * F.lit(float(scale))).cast("double"))
    rows = rows.select("id", "tag", "chosen", v.alias("v"))
    rows = rows.withColumns({"u1": F.xxhash64("tag", "v"), "u2": F.xxhash64("v", "tag", F.lit(1))})
    units = store.kept(_units(rows, max(positives + 1, negatives)))
    blocks = store.kept(_packed(units))
    # Anchors that are one unit are compared once.
    anchors = store.kept(_with_moments(units.where("chosen").select("u1", "u2", "tag", "v"), blocks))
    size = units.agg(F.count("*").alias("n"), F.approx_count_distinct("tag").alias("tags")).first()
    n, n_blocks = max(1, size["n"]), blocks.count()

    # Positives. A unit's first rows serve all of its anchors, each of which leaves itself out.
    share = F.lit(SURPLUS * (positives + 1) * max(1, size["tags"]) / n)
    everything = F.array(F.struct(F.lit(0).alias("slot"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high")))
    wanted = anchors.withColumns({"wins": everything, "share": share})
    good = None
    while wanted is not None:
        wanted = store.kept(wanted.withColumn("t", _threshold(F.col("share"), F.lit(-math.inf))))
        found = _joined(blocks, n_blocks, wanted, True, positives + 1)
        found = store.kept(_first_rows(found, units, positives + 1))
        full = found.groupBy("a1", "a2").agg(F.count("*").alias("rows")).where(F.col("rows") > positives)
        left = wanted.where(F.col("t") > -math.inf).join(
            full, (F.col("u1") == F.col("a1")) & (F.col("u2") == F.col("a2")), "left_anti"
        )
        left = store.kept(left.select(*anchors.columns, "wins", (F.col("share") * NEXT).alias("share")))
        open_ = left.select(F.col("u1").alias("a1"), F.col("u2").alias("a2"))
        found = found.join(open_, ["a1", "a2"], "left_anti")
        good = found if good is None else good.union(found)
        wanted = left if not left.isEmpty() else None
    good = store.kept(good)

    # Their windows. A negative positive score leaves none.
    p = F.col("score").cast("decimal(19,0)")
    wins = good.where("score >= 0").select(
        "a1",
        "a2",
        F.struct(
            F.col("place").cast("int").alias("slot"),
            F.ceil(p * low / 100).cast("long").alias("low"),
            F.floor(p * high / 100).cast("long").alias("high"),
        ).alias("win"),
    )
    wins = wins.where("win.low <= win.high").groupBy("a1", "a2").agg(F.array_sort(F.collect_list("win")).alias("wins"))
    wanted = anchors.join(
        wins, (F.col("u1") == F.col("a1")) & (F.col("u2") == F.col("a2"))
    ).select(*anchors.columns, "wins", F.lit(SURPLUS * negatives / n).alias("share"))
    bad = None
    while wanted is not None:
        top = F.array_min(F.transform("wins", lambda w: w["high"])).cast("double")
        bottom = F.array_min(F.transform("wins", lambda w: w["low"])).cast("double")
        above = _share_above(F.try_divide(top - F.col("mean"), F.col("spread")))
        t = _threshold(F.coalesce(above, F.lit(1.0)) + F.col("share"), bottom)
        wanted = store.kept(wanted.withColumn("t", F.greatest(F.least(t, top), bottom)))
        found = store.kept(_first_rows(_joined(blocks, n_blocks, wanted, False, negatives), units, negatives))
        counts = found.groupBy("a1", "a2", "slot").agg(F.count("*").alias("rows"))
        # A window is done when it is full, or when nothing of it lies below the threshold.
        state = wanted.select("u1", "u2", "t", F.explode("wins").alias("win")).join(
            counts,
            (F.col("u1") == F.col("a1")) & (F.col("u2") == F.col("a2")) & (F.col("win.slot") == F.col("slot")),
            "left",
        )
        unfilled = state.where((F.coalesce("rows", F.lit(0)) < negatives) & (F.col("t") > F.col("win.low")))
        unfilled = unfilled.groupBy(F.col("u1").alias("a1"), F.col("u2").alias("a2")).agg(
            F.array_sort(F.collect_list("win")).alias("open")
        )
        left = wanted.join(unfilled, (F.col("u1") == F.col("a1")) & (F.col("u2") == F.col("a2")))
        left = store.kept(
            left.select(*anchors.columns, F.col("open").alias("wins"), (F.col("share") * NEXT).alias("share"))
        )
        open_ = left.select(F.col("u1").alias("a1"), F.col("u2").alias("a2"), F.explode("wins.slot").alias("slot"))
        found = found.join(open_, ["a1", "a2", "slot"], "left_anti")
        bad = found if bad is None else bad.union(found)
        wanted = left if not left.isEmpty() else None

    # One value per unit: at most positives + 1 windows of so many rows. The anchors of a unit are dealt
    # into parts, and the value goes to the parts that there are.
    lists = bad.groupBy("a1", "a2", "slot").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("place").alias("rank"), F.col("id").alias("id"), "score"))
        ).alias("rows")
    )
    values = (
        good.withColumnsRenamed({"slot": "_", "place": "slot"})
        .join(lists, ["a1", "a2", "slot"], "left")
        .groupBy("a1", "a2")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "id", "u1", "u2", "score", "rows"))).alias("found"))
    )
    named = rows.where("chosen").select("id", "u1", "u2").distinct()
    named = named.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    salts = named.select(F.col("u1").alias("a1"), F.col("u2").alias("a2"), "salt").distinct()
    values = values.join(salts, ["a1", "a2"])
    out = named.withColumnsRenamed({"u1": "a1", "u2": "a2", "id": "anchor_id"}).join(values, ["a1", "a2", "salt"])
    others = F.filter(
        "found", lambda x: ~((x["id"] == F.col("anchor_id")) & (x["u1"] == F.col("a1")) & (x["u2"] == F.col("a2")))
    )
    out = out.select("anchor_id", F.explode(F.slice(others, 1, positives)).alias("positive"))
    return out.select("anchor_id", "positive", F.explode("positive.rows").alias("negative")).select(
        "anchor_id",
        F.col("positive.id").alias("positive_id"),
        F.col("negative.rank").cast("int").alias("rank"),
        F.col("negative.id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"),
        F.col("negative.score").alias("negative_score"),
    )


_WHOLE = {"tinyint", "smallint", "int", "bigint"}
