"""Similarity join of documents by the Jaccard similarity of their word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import arrays, store
from scanloom.llm.links import by_tile, near_groups, tiles

#: Pieces of 64 bits that are compared at a time.
PIECES_AT_ONCE = 1 << 20

#: Bits of a set's bitmap for each shingle in which it may differ from a similar set.
BITS_EACH = 10

#: Entries of the table of shingle counts; 2 MB whatever the input.
COUNT_BITS = 18


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Some rows at a time and their sorted sets of shingle hashes."""
    hashes = arrays.SpanHash()
    for batch in batches:
        for part in arrays.parts(batch.column(1)):
            part.data = arrays.LOWER[part.data]
            found = arrays.spans(part, arrays.NOT_BLANK)
            tokens = hashes(part.data, found.starts, found.ends)
            grams, first = arrays.shingles(tokens, found, words)
            sets = [np.unique(grams[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield batch.slice(part.first, len(part)), sets


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=first[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), first


def shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How often shingles occur over all documents, added up by a part of their hash."""

    def share(batches):
        table = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for _, sets in _sets(batches, words):
            flat, _ = _flat(sets)
            table += np.bincount(
                (flat >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS
            )
        return table

    return store.totals(docs, share, 1 << COUNT_BITS, "i8", np.add)


def _ordered(flat: np.ndarray, sizes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """All sets in the order that documents share: rare shingles first, ties by hash."""
    count = often[(flat >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    return flat[np.lexsort((flat, count, np.repeat(np.arange(len(sizes)), sizes)))]


def _heads(ordered: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``many`` shingles of each set."""
    start = np.zeros(len(many) + 1, dtype=np.int64)
    np.cumsum(many, out=start[1:])
    return ordered[np.arange(start[-1]) - np.repeat(start[:-1] - first[:-1], many)], start


def _prefix_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    return np.where(sizes > 0, sizes - -(-sizes * percent // 100) + 1, 0)


def bitmaps(flat: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap for each set, as bytes and the first byte of each; every shingle flips one bit.

    Two sets differ in at least as many shingles as their bitmaps do in bits, if both are as long. The
    length is a power of two that follows the size; the longer one of two is folded by xor.
    """
    least = np.maximum(64, BITS_EACH * 2 * sizes * (100 - percent) // (100 + percent))
    bits = np.left_shift(1, np.ceil(np.log2(least)).astype(np.int64))
    first = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(bits, out=first[1:])
    place = (flat >> np.uint64(20)).astype(np.int64) & np.repeat(bits - 1, sizes)
    flips = np.bincount(place + np.repeat(first[:-1], sizes), minlength=int(first[-1])) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little"), first // 8


def _prefixes(docs: DataFrame, counts, words: int, percent: int) -> DataFrame:
    """Per document the size, hash and bitmap of its set and the rarest shingles that a partner must share."""

    def rows(batches):
        often = store.received(counts)
        for some, sets in _sets(batches, words):
            flat, first = _flat(sets)
            sizes = np.diff(first)
            head, start = _heads(_ordered(flat, sizes, often), first, _prefix_sizes(sizes, percent))
            bits, at = bitmaps(flat, sizes, percent)
            yield pa.record_batch(
                {
                    "doc_id": some.column(0),
                    "version": some.column(2),
                    "n": pa.array(sizes, pa.int64()),
                    "h1": pa.array(arrays.signed(arrays.sequence_hash(flat, first, 11)), pa.int64()),
                    "h2": pa.array(arrays.signed(arrays.sequence_hash(flat, first, 23)), pa.int64()),
                    "prefix": arrays.lists(arrays.signed(head), start, pa.int64()),
                    "bits": arrays.byte_strings(bits, at),
                }
            )

    schema = "doc_id long, version long, n long, h1 long, h2 long, prefix array<long>, bits binary"
    return docs.mapInArrow(rows, schema)


def _chosen(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """Rows whose id passes the filter."""
    known = store.received(table)
    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        passed = store.passes(known, batch.column(0).to_numpy(zero_copy_only=False))
        yield batch.filter(pa.array(passed, pa.bool_()))


def _wanted_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """Sets of the wanted documents by their hash. The texts do not move: a filter of fixed size passes
    the wanted ids and few others, which the joins that follow drop."""
    table = store.sent(docs, store.id_filter(ids))

    def rows(batches):
        for _, sets in _sets(_chosen(batches, table), words):
            flat, first = _flat(sets)
            yield pa.record_batch(
                {
                    "id": pa.array(arrays.signed(arrays.sequence_hash(flat, first, 11)), pa.int64()),
                    "grams": arrays.lists(arrays.signed(flat), first, pa.int64()),
                }
            )

    # Another row may have a wanted set too; it makes a pair be compared once more, no more.
    return docs.mapInArrow(rows, "id long, grams array<long>")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, giving up by the suffix filter where it can."""
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    if min(len(x), len(y)) < need:
        return False
    # Suffix filter: cut both sets at the same hashes; what the pieces differ in size is not shared.
    cuts = x[len(x) // 8 :: max(1, len(x) // 8)][:8]
    pieces_x = np.diff(np.concatenate(([0], np.searchsorted(x, cuts), [len(x)])))
    pieces_y = np.diff(np.concatenate(([0], np.searchsorted(y, cuts), [len(y)])))
    if np.minimum(pieces_x, pieces_y).sum() < need:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) >= need


def _bitmap(value) -> np.ndarray:
    return np.frombuffer(value, dtype=np.uint64)


def _folded(bits: np.ndarray, length: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, length), axis=0) if len(bits) > length else bits


def may_be_similar(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int, percent: int) -> bool:
    """Whether two sets can be similar enough by what their bitmaps differ in."""
    need = -(-percent * (n_x + n_y) // (100 + percent))
    length = min(len(x), len(y))
    differ = int(np.bitwise_count(_folded(x, length) ^ _folded(y, length)).sum())
    return differ <= n_x + n_y - 2 * need


def _sides(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    column = batch.column(at)
    values = column.flatten().to_numpy()
    first = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    return [values[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that their bitmaps leave."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    table = store.sent(pairs, store.id_filter(ids))

    def chosen(batches):
        known = store.received(table)
        for batch in batches:
            passed = store.passes(known, batch.column(0).to_numpy())
            yield batch.filter(pa.array(passed, pa.bool_()))

    heads = classes.select("id", "n", "bits")
    heads = heads.mapInArrow(chosen, heads.schema)
    left = heads.toDF("a", "n_a", "x")
    right = heads.toDF("b", "n_b", "y")

    def rows(batches):
        for batch in batches:
            n_x, n_y = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            good = [
                may_be_similar(_bitmap(x.as_buffer()), _bitmap(y.as_buffer()), int(a), int(b), percent)
                for x, y, a, b in zip(batch.column(4), batch.column(5), n_x, n_y, strict=True)
            ]
            pairs = pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"])
            yield pairs.filter(pa.array(good, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y")
    return joined.mapInArrow(rows, "a long, b long")


def _cross_candidates(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a key that have different labels and whose bitmaps leave them.

    Two sets meet at the first key they share, which is in the ``short`` prefix of the smaller one; at
    other keys, and of members without such a partner, nothing is compared. Of keys with the same
    members one is enough. Members are compared in tiles, which they reach with their bitmaps.
    """
    least = members.where("short").groupBy("key").agg(F.min("n").alias("least"))
    members = members.join(least, "key").where("short or n >= least").drop("least")
    sums = [F.sum(F.xxhash64("id", "short", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
    labels = F.min("label").alias("lo"), F.max("label").alias("hi")
    same = members.groupBy("key").agg(F.count("*").alias("many"), *labels, *sums).where("lo < hi")
    keys = same.groupBy("many", "s0", "s1").agg(F.min("key").alias("key")).select("key")
    members = store.kept(members.join(keys, "key").select("key", "id", "label", "n", "short"))
    dealt = tiles(members).join(classes.select("id", "bits"), "id")
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("tile", "id", "label", "part", "alone", "n", "short", "bits")
    dealt = dealt.repartition(partitions, "tile").sortWithinPartitions("tile")

    def handle(batch):
        tile = batch.column(0).to_numpy()
        ids, label, part = (batch.column(k).to_numpy() for k in range(1, 4))
        alone = batch.column(4).to_numpy(zero_copy_only=False)
        sizes = batch.column(5).to_numpy()
        short = batch.column(6).to_numpy(zero_copy_only=False)
        bits = [_bitmap(value.as_buffer()) for value in batch.column(7)]
        edges = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True])))
        left, right = [], []
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            group = slice(x, y)
            columns = (c[group] for c in (label, part, sizes, short, bits))
            i, j = _tile_pairs(*columns, alone[x], percent)
            left.append(ids[x + i])
            right.append(ids[x + j])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return dealt.mapInArrow(lambda batches: by_tile(batches, handle), "a long, b long").distinct()


def _tile_pairs(label, part, sizes, short, bits, alone, percent):
    """Places of the pairs of one tile that may be similar enough."""
    i, j = np.triu_indices(len(label), 1)
    need = -(-percent * (sizes[i] + sizes[j]) // (100 + percent))
    # Different sets of one size share less than all.
    can = np.minimum(sizes[i], sizes[j]) - (sizes[i] == sizes[j])
    meet = ((sizes[i] <= sizes[j]) & short[i]) | ((sizes[j] <= sizes[i]) & short[j])
    good = (label[i] != label[j]) & (can >= need) & meet
    if not alone:
        good &= part[i] != part[j]
    i, j = i[good], j[good]
    if not len(i):
        return i, j
    most = (sizes[i] + sizes[j]) - 2 * need[good]
    lengths = np.array([len(b) for b in bits])
    shorter = np.minimum(lengths[i], lengths[j])
    good = np.zeros(len(i), dtype=bool)
    for length in np.unique(shorter):
        pairs = np.flatnonzero(shorter == length)
        table = np.zeros((len(bits), length), dtype=np.uint64)
        for k in np.unique(np.concatenate((i[pairs], j[pairs]))):
            table[k] = _folded(bits[k], length)
        step = max(1, PIECES_AT_ONCE // int(length))
        for at in range(0, len(pairs), step):
            some = pairs[at : at + step]
            differ = np.bitwise_count(table[i[some]] ^ table[j[some]]).sum(axis=1, dtype=np.int64)
            good[some] = differ <= most[some]
    return i[good], j[good]


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of classes whose sets are similar enough."""
    pairs = store.kept(pairs)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = _wanted_sets(docs, classes.join(ids, "id", "left_semi").select("first"), words)

    def rows(batches):
        for batch in batches:
            xs, ys = _sides(batch, 2), _sides(batch, 3)
            good = [similar(x.view(np.uint64), y.view(np.uint64), percent) for x, y in zip(xs, ys, strict=True)]
            pairs = pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"])
            yield pairs.filter(pa.array(good, pa.bool_()))

    joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(rows, "a long, b long")


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by ``100 * |A & B| >= percent * |A | B|``.

    A document's set holds its distinct shingles of ``words`` words, A-Z in lower case, words ended by
    blanks; with fewer words the whole sequence is the only shingle. Returns one row per row of
    ``docs`` (``doc_id, text``; other columns play no part): ``doc_id, n_shingles, component_id`` (the
    smallest doc_id reachable by links) and ``version`` (xxhash64 of the text).

    1. Shingles are counted over all documents in a table of fixed size; the counts only order the
       shingles, rare first, so sums of several shingles cost speed and never a link.
    2. Documents with equal sets are one class (128 bits of hash), which stands for all copies.
    3. Two sets that are similar enough share one of their ``n - ceil(n * percent / 100) + 1`` first
       shingles, and one of the ``n - ceil(2 * n * percent / (100 + percent)) + 1`` first of the smaller. Classes are joined on those, with length and positional filters; ``near_groups``
       keeps a shingle shared by very many from making all their pairs.
    4. Candidates are cut by the bits in which bitmaps of their whole sets differ, which are never more
       than the shingles in which the sets do. Sets of what is left are made again from the texts, cut
       by a suffix filter, and compared.

    Null or empty texts and texts of blanks have no shingle and link with nothing. A row whose doc_id
    is null links with nothing and has a null component. Rows that repeat an id and text have equal
    rows; those that repeat an id with another text go by their own text.
    """
    docs = _texts(docs)
    counts = store.sent(docs, shingle_counts(docs, words))
    rows = store.kept(_prefixes(docs, counts, words, percent))
    some = rows.where("n > 0 and doc_id is not null")
    classes = some.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("first"),
        *[F.first(c).alias(c) for c in ("n", "prefix", "bits")],
    )
    classes = store.kept(classes.withColumnRenamed("h1", "id"))
    entries = classes.select("id", "n", F.posexplode("prefix").alias("pos", "key"))

    def near(a, b):
        least, most = F.least(a("n"), b("n")), F.greatest(a("n"), b("n"))
        need = F.ceil((a("n") + b("n")) * percent / (100 + percent))
        before = F.least(a("pos"), b("pos"))
        after = F.least(a("n") - a("pos"), b("n") - b("pos"))
        # Different sets of one size share less than all.
        can = F.when(a("n") == b("n"), least - 1).otherwise(least)
        return (least * 100 >= most * percent) & (before + after >= need) & (can >= need)

    groups = near_groups(
        entries,
        near,
        lambda pairs, _: _verified(_candidates(pairs, classes, percent), docs, classes, words, percent),
        lambda some: _verified(
            _cross_candidates(some, classes, percent), docs, classes, words, percent
        ),
        carry=[F.col("n"), F.expr(f"pos <= n - (2 * {percent} * n + 99 + {percent}) div (100 + {percent})").alias("short")],
    )
    labelled = classes.join(groups, "id", "left").select(
        F.col("id").alias("h1"), "h2", "first", F.coalesce("component", F.col("id")).alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labelled.join(smallest, "label").select("h1", "h2", "component_id")
    # Rows without shingles have no class; nothing joins them.
    key = F.when(F.expr("n > 0 and doc_id is not null"), F.col("h1"))
    out = rows.select("doc_id", "version", "n", key.alias("h1"), "h2").join(named, ["h1", "h2"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        "version",
    )
