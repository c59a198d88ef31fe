"""Removing lines that repeat, exactly or nearly, across and within documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm import arrays, store
from scanloom.llm.links import by_tile, near_groups, smallest_labels, tiles

#: Candidates share a band: BLOCK_BITS bits of hash over the least words of a line under BAND_ROWS
#: orders of all words. A line's words count with how often they stood before, so of two lines k edits
#: apart, the longer of n words, n - k of at most n + k such words are common; at k = n / 10 that is
#: 9 / 11, a band is shared with a chance of (9 / 11) ** BAND_ROWS, and one of BANDS with 97.4 %,
#: whatever the length of the lines and the places of the edits.
BANDS, BAND_ROWS = 8, 5
BLOCK_BITS = 32
#: Bits of the SimHash, which the join does not use.
SIMHASH_BITS = 192

#: Odd factors: words times a factor, as whole numbers, are in an order of their own.
_ORDERS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_NEWLINE = np.ones(256, dtype=bool)
_NEWLINE[0x0A] = False

#: Eight lanes of 0 or 1 for the bits of a byte, to add up eight counters in one addition.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_LANE_MOST = 255


def _line_spans(part: arrays.Part) -> arrays.Spans:
    """All lines of each row, empty ones too, without their ends."""
    cuts = np.flatnonzero(part.data == 0x0A)
    begins = np.concatenate((part.offsets[:-1], cuts + 1))
    row = np.concatenate((np.arange(len(part)), np.searchsorted(part.offsets, cuts, side="right") - 1))
    order = np.lexsort((begins, row))
    begins, row = begins[order], row[order]
    first = np.searchsorted(row, np.arange(len(part) + 1))
    ends = np.empty_like(begins)
    ends[:-1] = begins[1:] - 1
    ends[first[1:] - 1] = part.offsets[1:]
    return arrays.Spans(begins, ends, row, first)


#: Code points of scripts that put no blanks between words, first and last: each character is a word.
_NO_BLANKS = np.array(
    [(0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x312F),
     (0x3190, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F),
     (0x20000, 0x3FFFF)]
)


def _words(part: arrays.Part) -> arrays.Spans:
    """Runs of letters, digits and non-ASCII; in scripts without blanks each character by itself."""
    found = arrays.spans(part, arrays.ALNUM)
    data = part.data
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return found
    padded = np.concatenate((data, np.zeros(3, dtype=np.uint8)))
    b0, b1, b2, b3 = (padded[lead + k].astype(np.int32) for k in range(4))
    three = (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F
    four = (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F
    code = np.where(b0 < 0xF0, three, four)
    at = np.searchsorted(_NO_BLANKS[:, 0], code, side="right") - 1
    single = (at >= 0) & (code <= _NO_BLANKS[at, 1])
    if not single.any():
        return found
    begins = np.zeros(len(data) + 4, dtype=bool)
    begins[found.starts] = True
    begins[lead[single]] = True
    begins[lead[single] + np.where(b0[single] < 0xF0, 3, 4)] = True
    keep = np.append(arrays.ALNUM[data], False)
    starts = np.flatnonzero(begins[: len(data)] & keep[:-1])
    # A word ends where its run does, or where the next begins.
    run = np.searchsorted(found.starts, starts, side="right") - 1
    ends = np.minimum(found.ends[run], np.append(starts[1:], len(data)))
    first = np.searchsorted(starts, part.offsets)
    return arrays.Spans(starts, ends, np.repeat(np.arange(len(part)), np.diff(first)), first)


def simhash(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHashes of runs of word hashes, none of them empty, as rows of bytes."""
    many = np.diff(first)
    # Counters have eight bits: longer lines are added up in pieces.
    pieces = -(-many // _LANE_MOST)
    line = np.repeat(np.arange(len(many)), pieces)
    place = np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[line] + place * _LANE_MOST
    lead = np.cumsum(pieces) - pieces
    out = np.empty((len(many), SIMHASH_BITS // 8), dtype=np.uint8)
    for word in range(SIMHASH_BITS // 64):
        bits = arrays.mix(tokens + np.uint64(0x632BE59BD9B4E019 * (word + 1) & ((1 << 64) - 1)))
        octets = bits.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            sums = np.add.reduceat(_LANES[octets[:, k]], starts).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(sums.astype(np.int32), lead, axis=0)
            out[:, word * 8 + k] = np.packbits(ones * 2 > many[:, None], axis=1).ravel()
    return out


def bands(tokens: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The bands of runs of word hashes, none of them empty, as rows of BANDS numbers of 32 bits."""
    line = np.repeat(np.arange(len(start) - 1), np.diff(start))
    # Equal words of a line stand together in this order; each is told apart by its place there.
    same = arrays.mix(tokens + arrays.mix(line.astype(np.uint64)))
    order = np.argsort(same)
    lead = np.flatnonzero(np.concatenate(([True], np.diff(same[order]) != 0)))
    before = np.empty(len(tokens), dtype=np.uint64)
    before[order] = np.arange(len(tokens)) - np.repeat(lead, np.diff(np.append(lead, len(tokens))))
    words = arrays.mix(tokens + before * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(start) - 1, BANDS), dtype=np.uint32)
    for k in range(BANDS):
        band = np.zeros(len(start) - 1, dtype=np.uint64)
        for factor in _ORDERS[k * BAND_ROWS : (k + 1) * BAND_ROWS]:
            band = arrays.mix(band + np.minimum.reduceat(words * factor, start[:-1]))
        out[:, k] = band >> np.uint64(64 - BLOCK_BITS)
    return out


def _least_near(percent: int) -> int:
    """The fewest words of a line that another line can be near to without being equal."""
    return next(n for n in range(1, 102) if percent >= 100 or (n + 1) * (100 - percent) >= 100)


def _normalised(part: arrays.Part, lines: arrays.Spans, hashes: arrays.SpanHash, min_words: int):
    """Lines of enough words: which, where their words start in the words' hashes, and those hashes."""
    # Words never hold a line end, so they are found for whole rows at once.
    found = _words(part)
    tokens = hashes(part.data, found.starts, found.ends)
    first = np.searchsorted(found.starts, np.append(lines.starts, len(part.data)))
    chosen = np.flatnonzero(np.diff(first) >= min_words)
    counts = np.diff(first)[chosen]
    start = np.concatenate(([0], np.cumsum(counts)))
    if start[-1] == len(tokens):
        return chosen, start, tokens
    place = np.repeat(first[chosen] - start[:-1], counts) + np.arange(start[-1])
    return chosen, start, tokens[place]


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line of enough words: where it stands, the hash of its words, and its bands."""

    def rows(batches: Iterator[pa.RecordBatch]):
        hashes = arrays.SpanHash()
        for batch in batches:
            for part in arrays.parts(batch.column(2)):
                part.data = arrays.LOWER[part.data]
                lines = _line_spans(part)
                chosen, start, tokens = _normalised(part, lines, hashes, min_words)
                if not len(chosen):
                    continue
                bits = bands(tokens, start).view(np.int64)
                row = pa.array(lines.row[chosen] + part.first)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).take(row),
                        "version": batch.column(1).take(row),
                        "line": pa.array(lines.index()[chosen], pa.int32()),
                        "h1": pa.array(arrays.signed(arrays.sequence_hash(tokens, start, 31)), pa.int64()),
                        "h2": pa.array(arrays.signed(arrays.sequence_hash(tokens, start, 47)), pa.int64()),
                        "size": pa.array(np.diff(start), pa.int32()),
                        **{f"bits{k}": pa.array(bits[:, k], pa.int64()) for k in range(bits.shape[1])},
                    }
                )

    bits = "".join(f", bits{k} long" for k in range(BANDS * BLOCK_BITS // 64))
    return docs.mapInArrow(rows, f"doc_id long, version long, line int, h1 long, h2 long, size int{bits}")


def _place(doc_id: np.ndarray, line: np.ndarray) -> np.ndarray:
    return arrays.mix(arrays.mix(doc_id.view(np.uint64)) + line.astype(np.uint64)).view(np.int64)


def _wanted_lines(docs: DataFrame, places: DataFrame, min_words: int) -> DataFrame:
    """Class, words (32 bits of their hashes) and bands of the lines at wanted places, and a few others that
    the joins after it drop. The texts do not move: a filter of fixed size passes the places."""
    docs = docs.select("doc_id", "text")

    def numbered(batches):
        for batch in batches:
            ids, line = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.record_batch({"id": pa.array(_place(ids, line), pa.int64())})

    table = store.sent(docs, store.id_filter(places.mapInArrow(numbered, "id long")))

    def rows(batches):
        known = store.received(table)
        hashes = arrays.SpanHash()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in arrays.parts(batch.column(1)):
                lines = _line_spans(part)
                passed = np.flatnonzero(store.passes(known, _place(ids[lines.row + part.first], lines.index())))
                if not len(passed):
                    continue
                cut = [part.data[lines.starts[k] : lines.ends[k]] for k in passed]
                some = arrays.Part(0, arrays.LOWER[np.concatenate(cut)], np.concatenate(([0], np.cumsum([len(c) for c in cut]))))
                chosen, start, tokens = _normalised(some, _line_spans(some), hashes, min_words)
                if not len(chosen):
                    continue
                bits = bands(tokens, start).view(np.int64)
                yield pa.record_batch(
                    {
                        "id": pa.array(arrays.signed(arrays.sequence_hash(tokens, start, 31)), pa.int64()),
                        "words": arrays.lists((tokens >> np.uint64(32)).astype(np.uint32).view(np.int32), start, pa.int32()),
                        **{f"bits{k}": pa.array(bits[:, k], pa.int64()) for k in range(bits.shape[1])},
                    }
                )

    bits = "".join(f", bits{k} long" for k in range(BANDS * BLOCK_BITS // 64))
    return docs.mapInArrow(rows, f"id long, words array<int>{bits}").repartition("id").dropDuplicates(["id"])


#: Words of a line up to which pairs are compared many at a time, and table cells of one comparison.
_TOGETHER_WORDS = 600
_TOGETHER_CELLS = 1 << 19


def _bits_within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether two sequences are at most so many edits apart, one column of the table of distances at a
    time, held as the bits of two whole numbers: where a distance is one more or less than above it."""
    if len(a) == 0 or len(b) == 0:
        return max(len(a), len(b)) <= most
    where = {c: int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little") for c in np.unique(a).tolist()}
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for done, c in enumerate(b.tolist(), 1):
        same = where.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up = down | ~(diagonal | up) & full
        right_down = up & diagonal
        if right_up & last:
            distance += 1
        elif right_down & last:
            distance -= 1
        right_up = (right_up << 1 | 1) & full
        right_down = right_down << 1 & full
        up = right_down | ~(diagonal | right_up) & full
        down = right_up & diagonal
        if distance - (len(b) - done) > most:
            return False
    return distance <= most


def _band_within(xs: list[np.ndarray], ys: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """The same for many pairs at a time, in a band around the diagonal."""
    k = int(most.max())
    width = 2 * k + 1
    lx, ly = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    n = len(xs)
    # Places beyond an end differ from each other and from all words.
    x = np.full((n, lx.max()), -1, dtype=np.int64)
    y = np.full((n, max(int(ly.max()), int(lx.max()) + k) + width), -2, dtype=np.int64)
    for row, (v, w) in enumerate(zip(xs, ys, strict=True)):
        x[row, : len(v)] = v.view(np.uint32)
        y[row, k : k + len(w)] = w.view(np.uint32)
    far = 1 << 20
    place = np.arange(width)
    table = np.where(place >= k, place - k, far) + np.zeros((n, 1), dtype=np.int64)
    result = np.full(n, far)
    result[lx == 0] = ly[lx == 0]
    for i in range(1, int(lx.max()) + 1):
        step = table + (x[:, i - 1, None] != y[:, i - 1 : i - 1 + width])
        step[:, :-1] = np.minimum(step[:, :-1], table[:, 1:] + 1)
        if i <= k:
            step[:, : k - i] = far
            step[:, k - i] = i
        table = np.minimum.accumulate(step - place, axis=1) + place
        ended = np.flatnonzero(lx == i)
        if len(ended):
            off = ly[ended] - i + k
            inside = (off >= 0) & (off < width)
            result[ended[inside]] = table[ended[inside], off[inside]]
    return result <= most


def within_edits(xs: list[np.ndarray], ys: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of word sequences have an edit similarity of ``percent`` / 100 or more: edits of
    words allowed are the longer length's rest to 100 percent."""
    good = np.zeros(len(xs), dtype=bool)
    longest = np.array([max(len(x), len(y)) for x, y in zip(xs, ys, strict=True)], dtype=np.int64)
    most = longest * (100 - percent) // 100
    order = np.argsort(longest, kind="stable")
    at = 0
    while at < len(order) and longest[order[at]] <= _TOGETHER_WORDS:
        size = int(longest[order[at]])
        end = at + 1
        # About equally long ones together.
        while (
            end < len(order)
            and longest[order[end]] <= min(_TOGETHER_WORDS, size + size // 8 + 2)
            and (end - at) * (2 * most[order[end]] + 1) < _TOGETHER_CELLS // 8
        ):
            end += 1
        some = order[at:end]
        good[some] = _band_within([xs[k] for k in some], [ys[k] for k in some], most[some])
        at = end
    for k in order[at:]:
        good[k] = _bits_within(xs[k], ys[k], int(most[k]))
    return good


def _parities(words: list[np.ndarray]) -> np.ndarray:
    """For each sequence 256 bits, which words hash to an odd number of times; an edit changes two at most."""
    many = np.array([len(w) for w in words])
    out = np.empty((len(words), 4), dtype=np.uint64)
    for at in range(0, len(words), 1024):
        some = words[at : at + 1024]
        cell = np.repeat(np.arange(len(some)) * 256, many[at : at + 1024]) + (np.concatenate(some) & 255)
        odd = np.bincount(cell, minlength=len(some) * 256).reshape(-1, 256) & 1
        out[at : at + 1024] = np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)
    return out


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as numpy arrays."""
    values = column.flatten().to_numpy()
    first = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    return [values[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _compared(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """The ids of all classes whose words the two rounds of comparisons may need: those of the first round's
    pairs, and of keys that more than two classes share."""
    many = shared.join(shared.groupBy("key").count().where("count > 2").select("key"), "key", "left_semi")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    return ids.union(many.select("id")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes whose lines reach the edit similarity."""
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("words").alias("y")), "b"
    )

    def rows(batches):
        for batch in batches:
            good = within_edits(_rows(batch.column(2)), _rows(batch.column(3)), percent)
            pairs = pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"])
            yield pairs.filter(pa.array(good, pa.bool_()))

    return joined.select("a", "b", "x", "y").mapInArrow(rows, "a long, b long")


def _cross_links(members: DataFrame, texts: DataFrame, bits: list[str], percent: int) -> DataFrame:
    """Links between members of a key that have different labels, found in tiles; no pair is a row.

    The two members of a key that has no others have been compared already. A pair that shares several blocks is compared in the first of them only. Of the links found in a
    tile those that tie its members together leave it.
    """
    members = members.join(members.groupBy("key").count().where("count > 2").select("key"), "key", "left_semi")
    members = store.kept(members)
    dealt = tiles(members.select("key", "id", "label")).join(texts, "id")
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("tile", "key", "id", "label", "part", "alone", "words", *bits)
    dealt = dealt.repartition(partitions, "tile").sortWithinPartitions("tile")

    def handle(batch):
        tile = batch.column(0).to_numpy()
        key, ids, label, part = (batch.column(k).to_numpy() for k in range(1, 5))
        alone = batch.column(5).to_numpy(zero_copy_only=False)
        words = _rows(batch.column(6))
        size = np.array([len(w) for w in words])
        hashes = np.stack([c.to_numpy() for c in batch.columns[7:]], axis=1)
        blocks = np.ascontiguousarray(hashes).view(np.int32)
        parity = _parities(words)
        edges = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True])))
        a, b = [], []
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            i, j = np.triu_indices(y - x, 1)
            i, j = i + x, j + x
            good = (label[i] != label[j]) & (key[i] == key[j])
            if not alone[x]:
                good &= part[i] != part[j]
            i, j = i[good], j[good]
            good = np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent
            i, j = i[good], j[good]
            # The number of the block is above its value in the key.
            good = np.ones(len(i), dtype=bool)
            for earlier in range(int(key[x] >> BLOCK_BITS)):
                good &= blocks[i, earlier] != blocks[j, earlier]
            i, j = i[good], j[good]
            changed = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
            good = changed <= 2 * (np.maximum(size[i], size[j]) * (100 - percent) // 100)
            a.append(i[good])
            b.append(j[good])
        i, j = np.concatenate(a), np.concatenate(b)
        good = within_edits([words[k] for k in i], [words[k] for k in j], percent)
        i, j = i[good], j[good]
        if len(i):
            least = smallest_labels(ids, i, j)
            some = least != ids
            yield pa.record_batch({"a": pa.array(ids[some]), "b": pa.array(least[some])})

    return dealt.mapInArrow(lambda batches: by_tile(batches, handle), "a long, b long")


def _places(classes: DataFrame, ids: DataFrame) -> DataFrame:
    return classes.join(ids, "id", "left_semi").select(_seat_doc(), _seat_line())


#: A line's place as one number, which hash aggregation can hold: doc_id, then ten digits of the line.
_SEAT = "cast(doc_id as decimal(20,0)) * 10000000000BD + line"


def _block_keys(bits: list[str]) -> list:
    """A long for each block: its number above its value. Blocks are counted from the low end of each long."""
    per = 64 // BLOCK_BITS
    return [
        F.shiftleft(F.lit(k).cast("long"), BLOCK_BITS)
        + F.shiftrightunsigned(F.shiftleft(F.col(bits[k // per]), (per - 1 - k % per) * BLOCK_BITS), 64 - BLOCK_BITS)
        for k in range(BANDS)
    ]


def _seat_line():
    return F.expr("cast(pmod(seat, 10000000000) as int)").alias("line")


def _seat_doc():
    return F.expr("(seat - pmod(seat, 10000000000)) div 10000000000").alias("doc_id")


def repeated_lines(docs: DataFrame, min_words: int = 5, percent: int = 90, short: bool = False) -> DataFrame:
    """Lines to remove, as rows ``doc_id, version, line`` (version: xxhash64 of the text; line: from 0).

    ``docs`` holds ``doc_id, version, text`` without null ids. Lines are normalised: A-Z in lower
    case, words of letters and digits, one blank between; each character of a script without blanks
    (Chinese, Japanese, Thai and others) is a word. Lines of fewer than ``min_words`` words are no matter
    of this operator; with ``short`` they are, but only where they are equal. Equal normalised lines are one class (128 bits of hash). Classes that
    share a band are candidates, and link when their edit similarity, 1 - edits of words / longer number
    of words, is ``percent`` / 100 or more; two lines just at 90 share a band with a chance of 97.4 %.
    Of each connected group one occurrence stays: the one with the smallest doc_id and line.
    """
    lines = store.kept(_lines(docs, 1 if short else min_words))
    bits = [f"bits{k}" for k in range(BANDS * BLOCK_BITS // 64)]
    classes = lines.groupBy("h1", "h2").agg(
        F.min(F.expr(_SEAT)).alias("seat"),
        F.count("*").alias("n"),
        F.first("size").alias("size"),
        *[F.first(b).alias(b) for b in bits],
    )
    classes = store.kept(classes.withColumnRenamed("h1", "id"))
    long = classes.where(F.col("size") >= max(min_words, _least_near(percent)))
    entries = long.select("id", "size", F.explode(F.array(*_block_keys(bits))).alias("key"))

    def near(a, b):
        least, most = F.least(a("size"), b("size")), F.greatest(a("size"), b("size"))
        return least * 100 >= most * percent

    texts = []

    def verify(pairs, shared):
        # Both rounds read the words of their lines from one table, made in one pass over the texts.
        texts.append(store.kept(_wanted_lines(docs, _places(classes, _compared(pairs, shared)), min_words)))
        return _verified(pairs, texts[0], percent)

    groups = near_groups(entries, near, verify, lambda members: _cross_links(members, texts[0], bits, percent))
    # A component's smallest id has no row among the groups; a class of one line and no group stays as it is.
    groups = groups.union(groups.select(F.col("component").alias("id"), "component").distinct())
    label = F.coalesce("component", F.col("id"))
    grouped = classes.select("id", "h2", "seat", "n").join(groups, "id", "left").where("n > 1 or component is not null")
    grouped = store.kept(grouped.select("id", "h2", "seat", "n", label.alias("label")))
    stay = grouped.groupBy("label").agg(F.min("seat").alias("stay"), F.sum("n").alias("many")).where("many > 1")
    repeated = grouped.join(stay, "label").select(F.col("id").alias("h1"), "h2", "stay")
    return (
        lines.select("doc_id", "version", "line", "h1", "h2")
        .join(repeated.hint("shuffle_hash"), ["h1", "h2"])
        .where(f"{_SEAT} <> stay")
        .select("doc_id", "version", "line")
    )


def drop_repeated_lines(docs: DataFrame, min_words: int = 5, percent: int = 90, short: bool = False) -> DataFrame:
    """``docs`` freed of repeated lines: ``row`` (all columns as one struct, its text replaced),
    ``n_lines`` and ``n_removed``.

    Rows with null doc_id or null text stay as they are (null text: 0 lines). An empty text is one
    empty line. Rows that repeat an id and text count as one document and are cut alike.
    """
    text = F.col("text").cast("string")
    packed = docs.withColumn("text", text).select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64("text").alias("version"),
    )
    searched = packed.select(F.col("id").alias("doc_id"), "version", F.col("row.text").alias("text"))
    searched = searched.where("doc_id is not null and text is not null")
    gone = (
        repeated_lines(searched, min_words, percent, short)
        .groupBy("doc_id", "version")
        .agg(F.collect_set("line").alias("gone"))
        .withColumnsRenamed({"doc_id": "gone_id", "version": "gone_version"})
    )
    # A null id matches nothing. The lists are the small side of each partition; texts are not sorted.
    joined = packed.join(gone.hint("shuffle_hash"), F.expr("id = gone_id and version = gone_version"), "left")
    joined = joined.select("row", "gone")
    names = joined.schema["row"].dataType.names
    schema = T.StructType([joined.schema["row"], *T.StructType.fromDDL("n_lines long, n_removed long").fields])

    def rows(batches):
        for batch in batches:
            row, gone = batch.column(0), batch.column(1)
            columns = row.flatten()
            at = names.index("text")
            texts = columns[at]
            n_lines = pc.add(pc.count_substring(texts, "\n").cast(pa.int64()), 1).fill_null(0)
            n_removed = pc.list_value_length(gone).cast(pa.int64()).fill_null(0)
            if gone.null_count < len(gone):
                some = gone.is_valid()
                cut = []
                for text, drop in zip(arrays.strings(texts.filter(some)), _rows(gone.filter(some)), strict=True):
                    left = text.split("\n")
                    for k in sorted(drop.tolist(), reverse=True):
                        del left[k]
                    cut.append("\n".join(left))
                columns[at] = pc.replace_with_mask(texts, some, pa.array(cut, texts.type))
                row = pa.StructArray.from_arrays(columns, fields=list(row.type))
            yield pa.RecordBatch.from_arrays([row, n_lines, n_removed], names=schema.names)

    return joined.mapInArrow(rows, schema)
