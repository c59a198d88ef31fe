"""Finding benchmark passages in training documents by an FM-index per shard of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import arrays, store
from scanloom.llm.fm_index import FMIndex

#: Words that could be part of a benchmark passage, per index.
SHARD_WORDS = 1 << 18
#: Benchmark words per block; a block is what is broadcast at a time (about 10 MB).
BLOCK_WORDS = 1 << 19


class Phrases:
    """The windows of a block of benchmark items, by word numbers."""

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        texts = pa.array([t for _, t in items], pa.large_string())
        hashes = arrays.SpanHash()
        words: list[np.ndarray] = []
        for part in arrays.parts(texts):
            part.data = arrays.LOWER[part.data]
            found = arrays.spans(part, arrays.ALNUM)
            tokens = hashes(part.data, found.starts, found.ends)
            words += [tokens[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, dtype=np.uint64)
        by_size: dict[int, dict[tuple, set[int]]] = {}
        for (item, _), tokens in zip(items, words, strict=True):
            numbers = np.searchsorted(self.vocabulary, tokens) + 1
            size = min(window, len(numbers))
            for k in range(len(numbers) - size + 1 if size else 0):
                by_size.setdefault(size, {}).setdefault(tuple(numbers[k : k + size].tolist()), set()).add(item)
        self.windows = {
            size: (np.array(list(found), dtype=np.int64), [sorted(v) for v in found.values()])
            for size, found in by_size.items()
        }
        self.shortest = min(by_size, default=0)
        self.filter = np.zeros(1 << 16, dtype=bool)
        self.filter[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        """Word numbers; 0 for words of no item."""
        out = np.zeros(len(tokens), dtype=np.int64)
        maybe = np.flatnonzero(self.filter[(tokens & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, tokens[maybe])
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == tokens[maybe] if len(self.vocabulary) else np.zeros(0, dtype=bool)
        out[maybe[known]] = at[known] + 1
        return out


class Shard:
    """Runs of known words gathered until there are enough for an index."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.symbols: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]
        self.rows: list[np.ndarray] = [np.full(1, -1)]
        self.places: list[np.ndarray] = [np.full(1, -1)]
        self.words = 0

    def add(self, numbers: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
        """Words in order: their number, row and place in it. Runs too short for a window are left."""
        if not len(numbers) or not self.phrases.shortest:
            return
        breaks = numbers == 0
        new = np.concatenate(([True], (row[1:] != row[:-1]) | breaks[1:] | breaks[:-1]))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(numbers)))
        good = (~breaks[starts]) & (sizes >= self.phrases.shortest)
        starts, sizes = starts[good], sizes[good]
        if not len(starts):
            return
        # One separator after each run.
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        total = int(sizes.sum()) + len(sizes)
        run = np.repeat(np.arange(len(sizes)), sizes + 1)
        inside = np.arange(total) - begin[run]
        last = inside == sizes[run]
        at = np.where(last, 0, starts[run] + inside)
        self.symbols.append(np.where(last, 0, numbers[at]))
        self.rows.append(np.where(last, -1, row[at]))
        self.places.append(np.where(last, -1, place[at]))
        self.words += total

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """Row, first word, size and items of every occurrence; forgets the gathered words."""
        symbols = np.concatenate(self.symbols)
        row, place = np.concatenate(self.rows), np.concatenate(self.places)
        self.clear()
        rows, firsts, sizes, items = [], [], [], []
        if len(symbols) > 1:
            index = FMIndex(symbols)
            for size, (windows, owners) in self.phrases.windows.items():
                low, high = index.search(windows)
                many = high - low
                which = np.repeat(np.arange(len(many)), many)
                inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                at = index.locate(low[which] + inside)
                rows.append(row[at])
                firsts.append(place[at])
                sizes.append(np.full(len(at), size))
                items += [owners[k] for k in which]
        empty = np.zeros(0, dtype=np.int64)
        return (
            np.concatenate([empty, *rows]),
            np.concatenate([empty, *firsts]),
            np.concatenate([empty, *sizes]),
            items,
        )


def merged(first: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Occurrences as spans of words (from, to) that neither meet nor overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first.tolist(), (first + size).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_FOUND = "doc_id long, version long, n_words long, spans array<struct<first:long,last:long>>, items array<long>"


def _search(docs: DataFrame, phrases, whole: bool) -> DataFrame:
    """Each document's words and the spans and items found; with ``whole`` also those without any."""

    def report(ids, versions, counts, shard):
        row, first, size, items = shard.hits()
        order = np.argsort(row, kind="stable")
        edges = np.searchsorted(row[order], np.arange(len(ids) + 1))
        out = {"doc_id": [], "version": [], "n_words": [], "spans": [], "items": []}
        for k in range(len(ids)) if whole else np.unique(row).tolist():
            mine = order[edges[k] : edges[k + 1]]
            out["doc_id"].append(ids[k])
            out["version"].append(versions[k])
            out["n_words"].append(counts[k])
            out["spans"].append([{"first": a, "last": b} for a, b in merged(first[mine], size[mine])])
            out["items"].append(sorted(set().union(*(items[j] for j in mine))))
        kinds = {
            "doc_id": pa.int64(),
            "version": pa.int64(),
            "n_words": pa.int64(),
            "spans": pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])),
            "items": pa.list_(pa.int64()),
        }
        return pa.record_batch({c: pa.array(v, kinds[c]) for c, v in out.items()})

    def rows(batches: Iterator[pa.RecordBatch]):
        known = store.received(phrases)
        hashes = arrays.SpanHash()
        shard = Shard(known)
        ids: list = []
        versions: list = []
        counts: list = []
        for batch in batches:
            for part in arrays.parts(batch.column(2)):
                part.data = arrays.LOWER[part.data]
                found = arrays.spans(part, arrays.ALNUM)
                tokens = hashes(part.data, found.starts, found.ends)
                shard.add(known.numbers(tokens), found.row + len(ids), found.index())
                ids += batch.column(0).slice(part.first, len(part)).to_pylist()
                versions += batch.column(1).slice(part.first, len(part)).to_pylist()
                counts += found.counts.tolist()
                if shard.words >= SHARD_WORDS or len(ids) >= SHARD_WORDS:
                    yield report(ids, versions, counts, shard)
                    ids, versions, counts = [], [], []
        if ids:
            yield report(ids, versions, counts, shard)

    return docs.mapInArrow(rows, _FOUND)


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one partition of them at a time.

    Only one block at a time is on the driver. An item of more words than a block is one by itself.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    items = items.where("text is not null and item_id is not null")
    block: list[tuple[int, str]] = []
    words = 0
    for item, text in items.toLocalIterator():
        n = len(text.split()) + 1
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((item, text))
        words += n
    yield block


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Where benchmark items stand in documents.

    Words are runs of letters, digits and non-ASCII, A-Z in lower case. ``window`` consecutive words of
    an item are searched for; an item of fewer words, but not none, as a whole. Returns per row of
    ``docs``: ``doc_id, version`` (xxhash64 of the text), ``n_words``, ``spans`` (word places from,
    to; merged) and ``items`` (ids, sorted).

    Each task gathers the words of its documents into shards of bounded size, maximal runs of words
    outside the benchmark's vocabulary as one separator, and searches all windows backwards in an
    FM-index of the shard. The benchmark is searched in blocks of bounded size, each a pass over the
    documents, so no more than one block is broadcast at a time.

    Null and empty texts have no words. Null items or item texts are not searched for. Rows that repeat
    an id and text have equal rows. Texts of any length are searched whole; without documents there are no
    rows; other columns, whatever their names, play no part.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("version"),
        F.col("text").cast("string").alias("text"),
    )
    found = None
    for items in benchmark_blocks(benchmark, block_words):
        more = _search(docs, store.sent(docs, Phrases(items, window)), whole=found is None)
        if found is None:
            found = more.withColumn("whole", F.lit(1))
            continue
        # Kept, so that the next block's pass is the only one at work.
        found = kept_union(found, more.withColumn("whole", F.lit(0)))
    return _merged_blocks(found)


def kept_union(found: DataFrame, more: DataFrame) -> DataFrame:
    return found.union(store.kept(more))


def _merged_blocks(found: DataFrame) -> DataFrame:
    """One row per row of the documents from the rows of all blocks."""
    grouped = found.groupBy("doc_id", "version", "n_words").agg(
        F.sum("whole").alias("copies"),
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Spans of several blocks: those that meet become one.
    spans = F.expr(
        """aggregate(array_sort(spans), cast(array() as array<struct<first:bigint,last:bigint>>),
        (done, s) -> case when size(done) > 0 and done[size(done) - 1].last >= s.first
        then concat(slice(done, 1, size(done) - 1), array(named_struct('first', done[size(done) - 1].first,
        'last', greatest(done[size(done) - 1].last, s.last)))) else concat(done, array(s)) end)"""
    )
    return grouped.select(
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        "doc_id",
        "version",
        "n_words",
        spans.alias("spans"),
        "items",
    ).drop("copy")


def contamination(found: DataFrame) -> DataFrame:
    """The digest of ``find_benchmark``: hit words and items, and whether a document is contaminated,
    which is when a twentieth of its words or more are hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    out = found.select(
        "doc_id",
        "version",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        "spans",
    )
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
