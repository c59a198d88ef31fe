"""Token ids of documents in files of grammar-compressed blocks.

The format is a folder of Parquet files, written and committed by Spark, in which a row is a block of
whole documents in order. A block holds its own Re-Pair grammar:

=============  =====================================================================================
``part``       the range of documents that the block belongs to, in the order of the documents
``place``      the block's place in its part
``before``     ids of the part in front of the block
``n_ids``      ids of the block
``doc_ids``    the documents' ids, in order; null where a document has none
``n_tokens``   ids of each document
``ends``       the symbol behind each document's last one; no symbol spans two documents
``width``      bytes of a symbol, 2 or 4; all numbers are unsigned and little-endian
``terminals``  the distinct ids, 4 bytes each: symbol ``k`` below their number stands for the ``k``-th
``rules``      two symbols each: the symbols that follow the terminals, each defined by earlier ones
``lengths``    how many ids each rule stands for, 4 bytes each
``symbols``    the sequence itself
=============  =====================================================================================

With ``ends`` and ``lengths`` any id of any document is found without decoding what stands before it.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm import arrays, store

#: A vocabulary file of a public tokenizer; any other of its library may be named.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Ids of a block, or those of one document if it has more.
BLOCK_IDS = 1 << 19
#: Uses a pair needs in each round of replacements, the most frequent first; the last is repeated.
ROUNDS = (64, 8, 4)
#: A round that shortens the sequence by less than this share is the last.
LEAST_GAIN = 0.02
#: Words that a task remembers, by hash (some 40 bytes each, and four ids a word at most); beyond them
#: it starts anew.
REMEMBERED = 1 << 21
#: Bytes of text that are encoded at a time; a longer text is encoded by itself.
TEXT_BYTES = 1 << 20

SCHEMA = (
    "part int, place int, before long, n_ids long, doc_ids array<long>, n_tokens array<long>, ends array<int>, width int, "
    "terminals binary, rules binary, lengths binary, symbols binary"
)


# --- encoding ------------------------------------------------------------------------------------

#: The steps of a tokenizer by which no token spans a blank, nor the border of an ASCII letter and an
#: ASCII sign other than the apostrophe. Fixed values.
_WORDWISE_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_WORDWISE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: 0 a blank, 2 an ASCII letter, 3 an ASCII sign or digit beside which a letter begins or ends a token,
#: 1 all other bytes.
_KINDS = arrays.NOT_BLANK.astype(np.uint8)
_KINDS[0x21:0x7F] = 3
_KINDS[ord("'")] = 1
_KINDS[0x41:0x5B] = _KINDS[0x61:0x7B] = 2
#: Small letters that are letters to every version of the patterns' \p{L}, and change by no normalization.
_SMALL_LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
#: The character that stands for each byte in byte-level vocabularies: itself if it can be printed, else
#: the next one from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARACTERS = {b: chr(b) for b in _PRINTED} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTED))
}

#: The bytes in another order, for a second hash.
_OTHER_BYTES = (np.arange(256) * 167 + 13).astype(np.uint8)


def _wordwise(described: dict) -> bool:
    """Whether the tokenizer's words can be encoded one by one."""
    steps = (described.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        (described.get("normalizer") or {}).get("normalizers") == _WORDWISE_NORMALIZERS
        and len(steps) == 2
        and steps[0].get("type") == "Split"
        and steps[0].get("pattern") == {"Regex": _WORDWISE_SPLIT}
        and steps[0].get("invert") is True
        and steps[0].get("behavior") == "Removed"
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("use_regex")
        and not steps[1].get("add_prefix_space")
        and described["model"].get("type") == "BPE"
        and not described["model"].get("dropout")
    )


class Encoder:
    """The ids that the tokenizers library gives to whole texts, without special ids added.

    Where the tokenizer never joins what blanks part (``_wordwise``), the distinct words of many texts
    are encoded once and the ids of the texts are put together from them; words of small ASCII
    letters only go to the tokenizer's model straight away. Texts that may hold a special token go
    through the tokenizer whole, and so do all texts under any other tokenizer.
    """

    def __init__(self, described: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(described)
        parsed = json.loads(described)
        self.wordwise = _wordwise(parsed)
        self.special = [t["content"] for t in parsed.get("added_tokens") or []]
        self.model = self.tokenizer.model
        self.hash = arrays.SpanHash()
        self._forget()

    def _forget(self) -> None:
        """No words. Of those known: 64 bits of hash in order, 64 other ones to make sure, and each one's
        number, with the ids of all of them and where each one's begin."""
        self.key = np.zeros(0, dtype=np.uint64)
        self.sure = np.zeros(0, dtype=np.uint64)
        self.number = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(1 << 10, dtype=np.uint32)
        self.first = np.zeros(1, dtype=np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: bytes) -> list[int] | None:
        """The ids of a word of small letters that are one token of the words' pattern, else None."""
        if word.isalpha() and word.islower():
            return [t.id for t in self.model.tokenize(word.decode())]
        text = word.decode("utf-8", "replace")
        if text.strip(_SMALL_LETTERS):
            return None
        return [t.id for t in self.model.tokenize("".join(map(_BYTE_CHARACTERS.__getitem__, word)))]

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of some distinct words; those not yet known are encoded."""
        if len(self.first) > REMEMBERED or self.first[-1] > 4 * REMEMBERED:
            self._forget()
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        key = self.hash(data, offsets[:-1], offsets[1:])
        sure = self.hash(_OTHER_BYTES[data], offsets[:-1], offsets[1:])
        at = np.searchsorted(self.key, key)
        near = np.minimum(at, max(len(self.key) - 1, 0))
        known = np.zeros(len(words), dtype=bool)
        numbers = np.zeros(len(words), dtype=np.int64)
        if len(self.key):
            known = (self.key[near] == key) & (self.sure[near] == sure)
            numbers[known] = self.number[near[known]]
        new = np.flatnonzero(~known)
        if len(new):
            found = words.take(pa.array(new)).to_pylist()
            ids = [self._word(w) for w in found]
            odd = [k for k, x in enumerate(ids) if x is None]
            for k, x in zip(odd, self._whole([found[k].decode("utf-8", "replace") for k in odd]), strict=True):
                ids[k] = x
            n, used = len(self.first) - 1, int(self.first[-1])
            ends = used + np.cumsum([len(x) for x in ids])
            while len(self.flat) < ends[-1]:
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.flat[used : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1]) - used)
            self.first = np.concatenate((self.first, ends))
            numbers[new] = np.arange(n, n + len(new))
            order = new[np.argsort(key[new], kind="stable")]
            self.sure = np.insert(self.sure, at[order], sure[order])
            self.number = np.insert(self.number, at[order], numbers[order].astype(np.int32))
            self.key = np.insert(self.key, at[order], key[order])
        return numbers

    def __call__(self, part: arrays.Part) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a part, and where each text's ids begin."""
        octets = part.data.tobytes()
        if not self.wordwise or any(s.encode() in octets for s in self.special):
            texts = [
                octets[a:b].decode("utf-8", "replace")
                for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)
            ]
            found = self._whole(texts)
            first = np.zeros(len(found) + 1, dtype=np.int64)
            np.cumsum([len(x) for x in found], out=first[1:])
            return np.fromiter((i for x in found for i in x), np.uint32, int(first[-1])), first
        # Small letters first, unless that would make a special token; none of them is in here.
        data = arrays.LOWER[part.data] if not self._could_become_special(octets) else part.data
        kinds = _KINDS[data]
        keep, letter, sign = kinds > 0, kinds == 2, kinds == 3
        begins = np.zeros(len(data), dtype=bool)
        if len(data):
            begins[0] = True
            begins[1:] = ~keep[:-1] | (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
            inner = part.offsets[1:-1]
            begins[inner[inner < len(data)]] = True
        begins &= keep
        at = np.flatnonzero(begins)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(part) + 1, np.int64)
        kept = np.cumsum(keep, dtype=np.int32)
        offsets = np.empty(len(at) + 1, dtype=np.int64)
        offsets[:-1] = kept[at] - 1
        offsets[-1] = kept[-1]
        words = pa.Array.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])]
        ).dictionary_encode()
        numbers = self._numbers(words.dictionary)
        begin = self.first[numbers]
        sizes = self.first[numbers + 1] - begin
        index = words.indices.to_numpy()
        size = sizes[index]
        ends = np.cumsum(size)
        place = np.repeat(begin[index] - (ends - size), size)
        place += np.arange(len(place))
        first = np.concatenate(([0], ends))[np.searchsorted(at, part.offsets)]
        return self.flat[place], first

    def _could_become_special(self, octets: bytes) -> bool:
        return any(s.lower().encode()[:2] in octets for s in self.special)


# --- grammar -------------------------------------------------------------------------------------


@dataclass
class Grammar:
    """A sequence of symbols with the rules behind them, and where each document ends."""

    terminals: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    ends: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        """How many ids each symbol stands for."""
        return np.concatenate((np.ones(len(self.terminals), np.int64), self.lengths.astype(np.int64)))

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some symbols: every round replaces each rule by its two symbols."""
        n = len(self.terminals)
        while True:
            long = symbols >= n
            if not long.any():
                return self.terminals[symbols]
            count = long + np.int64(1)
            at = np.cumsum(count) - count
            out = np.empty(int(count.sum()), dtype=symbols.dtype)
            out[at] = np.where(long, self.rules[np.where(long, symbols - n, 0), 0] if len(self.rules) else 0, symbols)
            out[at[long] + 1] = self.rules[symbols[long] - n, 1]
            symbols = out

    def ids(self) -> np.ndarray:
        """All ids, from the expansions of the symbols."""
        n = len(self.terminals)
        sizes = self.sizes
        first = np.cumsum(sizes) - sizes
        table = np.empty(int(sizes.sum()), dtype=np.uint32)
        table[:n] = self.terminals
        # A rule's symbols are made before it. Rules of one depth are filled in at once.
        depth = np.zeros(n + len(self.rules), dtype=np.int32)
        todo = np.arange(len(self.rules))
        ready = np.zeros(n + len(self.rules), dtype=bool)
        ready[:n] = True
        while len(todo):
            now = ready[self.rules[todo]].all(axis=1)
            some, todo = todo[now], todo[~now]
            for side, shift in ((0, 0), (1, sizes[self.rules[some, 0]])):
                of = self.rules[some, side]
                size = sizes[of]
                step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                table[np.repeat(first[n + some] + shift, size) + step] = table[np.repeat(first[of], size) + step]
            ready[n + some] = True
        del depth
        size = sizes[self.symbols]
        ends = np.cumsum(size)
        place = np.repeat(first[self.symbols] - (ends - size), size)
        place += np.arange(len(place))
        return table[place]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` to ``stop`` of the ``k``-th document; only symbols that hold some of
        them are expanded."""
        symbols = self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]]
        ends = np.cumsum(self.sizes[symbols])
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self._expanded(symbols[a:b])[start - before : stop - before]


def repair(ids: np.ndarray, ends: np.ndarray) -> Grammar:
    """The grammar of a sequence of ids cut into documents that end at ``ends``.

    Every round counts the pairs of neighbours by sorting them, makes a rule of each pair that is
    frequent enough and puts it in place of its occurrences from left to right, none of which may
    overlap or span two documents. A rule that is then used less than three times is not kept. The
    first rounds take the most frequent pairs only, so that rare ones do not stand in their way; the
    rounds end when hardly anything becomes shorter.
    """
    present = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    terminals = np.flatnonzero(present).astype(np.uint32)
    number = np.zeros(len(present), dtype=np.uint32)
    number[terminals] = np.arange(len(terminals))
    most = 1 << 16 if len(terminals) <= 60_000 else 1 << 31
    kind, shift = (np.uint32, 16) if most == 1 << 16 else (np.uint64, 32)
    symbols, ends = number[ids].astype(kind), ends.astype(np.int64)
    rules: list[np.ndarray] = []
    total = len(terminals)
    step = 0
    while True:
        need = ROUNDS[min(step, len(ROUNDS) - 1)]
        step += 1
        if len(symbols) < 2 * need:
            if need == ROUNDS[-1]:
                break
            continue
        pairs = symbols[:-1] << kind(shift) | symbols[1:]
        ordered = np.sort(pairs)
        edges = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
        edges = np.concatenate(([0], edges, [len(ordered)]))
        counts = np.diff(edges)
        frequent = np.flatnonzero(counts >= need)
        if len(frequent) > most - total:
            frequent = np.sort(frequent[np.argsort(-counts[frequent], kind="stable")[: most - total]])
        chosen = ordered[edges[frequent]]
        shorter = 0
        if len(chosen):
            symbols, ends, made, shorter = _replaced(symbols, pairs, ends, chosen, total, kind)
            if len(made):
                rules.append(np.stack([made >> kind(shift), made & kind((1 << shift) - 1)], axis=1))
                total += len(made)
        if need == ROUNDS[-1] and shorter <= LEAST_GAIN * (len(symbols) + shorter):
            break
    made = np.concatenate(rules) if rules else np.zeros((0, 2), kind)
    sizes = np.ones(total, dtype=np.int64)
    for rows, at in zip(rules, np.cumsum([len(terminals)] + [len(r) for r in rules]), strict=False):
        sizes[at : at + len(rows)] = sizes[rows].sum(axis=1)
    return Grammar(terminals, made, sizes[len(terminals) :].astype(np.uint32), symbols, ends)


def _replaced(symbols, pairs, ends, chosen, total, kind):
    """One round of replacements: the shorter sequence, its document ends, the pairs of the rules
    made, and how many symbols fewer there are."""
    # A table by hash says which rule a pair may be; its key says whether it is.
    bits = max(8, int(len(chosen) * 4).bit_length())
    width = kind(0).itemsize * 8
    odd = kind(0x9E3779B1 if width == 32 else 0x9E3779B97F4A7C15)
    slot = (chosen * odd) >> kind(width - bits)
    table = np.zeros(1 << bits, dtype=np.int32)
    # Pairs that share a slot wait for a later round; the first in the table stays.
    table[slot[::-1]] = np.arange(len(chosen), 0, -1)
    rule = table[(pairs * odd) >> kind(width - bits)]
    at = np.flatnonzero(rule)
    at = at[chosen[rule[at] - 1] == pairs[at]]
    inner = ends[:-1] - 1
    crossing = np.zeros(len(symbols), dtype=bool)
    crossing[inner[inner >= 0]] = True
    at = at[~crossing[at]]
    if not len(at):
        return symbols, ends, chosen[:0], 0

    def alternate(at):
        """Of occurrences that overlap, every other one."""
        new = np.concatenate(([True], np.diff(at) != 1))
        index = np.arange(len(at))
        return at[(index - np.maximum.accumulate(np.where(new, index, 0))) % 2 == 0]

    taken = alternate(at)
    used = np.bincount(rule[taken], minlength=len(chosen) + 1)
    useful = used >= 3
    taken = taken[useful[rule[taken]]]
    name = np.zeros(len(chosen) + 1, dtype=kind)
    made = np.flatnonzero(useful)
    name[made] = np.arange(total, total + len(made), dtype=kind)
    symbols = symbols.copy()
    symbols[taken] = name[rule[taken]]
    stays = np.ones(len(symbols), dtype=bool)
    stays[taken + 1] = False
    # As many symbols went as replacements stand before an end.
    return symbols[stays], ends - np.searchsorted(taken + 1, ends), chosen[made - 1], len(taken)


def _packed(grammar: Grammar) -> dict[str, object]:
    width = 2 if len(grammar.terminals) + len(grammar.rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    return {
        "width": width,
        "terminals": grammar.terminals.astype("<u4").tobytes(),
        "rules": grammar.rules.astype(kind).tobytes(),
        "lengths": grammar.lengths.astype("<u4").tobytes(),
        "symbols": grammar.symbols.astype(kind).tobytes(),
    }


def unpacked(block: dict) -> Grammar:
    """The grammar of a row of the files."""
    kind = f"<u{block['width']}"
    return Grammar(
        np.frombuffer(block["terminals"], "<u4"),
        np.frombuffer(block["rules"], kind).reshape(-1, 2).astype(np.int64),
        np.frombuffer(block["lengths"], "<u4"),
        np.frombuffer(block["symbols"], kind).astype(np.int64),
        np.asarray(block["ends"], dtype=np.int64),
    )


# --- files ---------------------------------------------------------------------------------------


def _blocks(texts: DataFrame, described: str, end_id: int | None) -> DataFrame:
    model = store.sent(texts, described)
    schema = pa.schema(
        [
            ("part", pa.int32()),
            ("place", pa.int32()),
            ("before", pa.int64()),
            ("n_ids", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("n_tokens", pa.list_(pa.int64())),
            ("ends", pa.list_(pa.int32())),
            ("width", pa.int32()),
            ("terminals", pa.binary()),
            ("rules", pa.binary()),
            ("lengths", pa.binary()),
            ("symbols", pa.binary()),
        ]
    )

    def rows(batches: Iterator[pa.RecordBatch]):
        encode = Encoder(store.received(model))
        part_number = TaskContext.get().partitionId()
        place = before = 0
        held: list[np.ndarray] = []
        docs: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        n = 0

        def block():
            nonlocal place, before, n
            counts = np.concatenate(sizes)
            grammar = repair(np.concatenate(held), np.cumsum(counts))
            row = {
                "part": part_number,
                "place": place,
                "before": before,
                "n_ids": n,
                "doc_ids": pa.concat_arrays(docs),
                "n_tokens": counts,
                "ends": grammar.ends,
            } | _packed(grammar)
            place, before, n = place + 1, before + n, 0
            for x in (held, docs, sizes):
                x.clear()
            # One element each, lists included.
            columns = [
                pa.ListArray.from_arrays(pa.array([0, len(row[f.name])], pa.int32()), pa.array(row[f.name], f.type.value_type))
                if pa.types.is_list(f.type)
                else pa.array([row[f.name]], f.type)
                for f in schema
            ]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for part in arrays.parts(batch.column(1), TEXT_BYTES):
                ids, first = encode(part)
                if end_id is not None:
                    ids = np.insert(ids, first[1:], np.uint32(end_id))
                    first = first + np.arange(len(first))
                names = batch.column(0).slice(part.first, len(part))
                start = 0
                while start < len(part):
                    # As many documents as fit the block, one at least if it is empty.
                    stop = int(np.searchsorted(first, first[start] + BLOCK_IDS - n, side="right")) - 1
                    stop = min(max(stop, start + (n == 0)), len(part))
                    if stop > start:
                        held.append(ids[first[start] : first[stop]])
                        docs.append(names.slice(start, stop - start))
                        sizes.append(np.diff(first[start : stop + 1]))
                        n += int(first[stop] - first[start])
                        start = stop
                    if start < len(part) or n >= BLOCK_IDS:
                        yield block()
        if docs:
            yield block()

    return texts.mapInArrow(rows, SCHEMA)


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int | None = 1) -> None:
    """Write the token ids of ``docs`` (``doc_id, text``) to a new folder, in ascending order of ``doc_id``.

    Rows with a null id come first; rows that repeat an id are ordered by a hash of their text. Null and
    empty texts have no ids but ``end_id``, which ends every document unless it is None. Other columns
    are not looked at. Documents are dealt by ranges of (id, text), so no id is a task of its own, then
    encoded, gathered to blocks of bounded size (a longer document is a block by itself) and
    compressed. An empty table makes a folder without blocks. A text that is not valid UTF-8 is read
    with replacement characters.
    """
    with open(vocabulary, encoding="utf-8") as f:
        described = f.read()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The last key parts rows that are equal otherwise; their order does not show.
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    texts = texts.repartitionByRange(*keys).sortWithinPartitions(*keys[:2])
    with store.shuffles_removed(docs.sparkSession):
        _blocks(texts, described, end_id).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a folder of token files, as the module describes them."""
    return spark.read.schema(SCHEMA).parquet(path)


def _decoded(blocks: DataFrame, schema: pa.Schema, names: str, made) -> DataFrame:
    """Rows of documents from blocks, a block at a time."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                block = {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                ids = unpacked(block).ids().astype("<u4", copy=False)
                sizes = np.asarray(block["n_tokens"], dtype=np.int64)
                ends = np.cumsum(sizes)
                columns = {
                    "part": pa.array(np.full(len(sizes), block["part"]), pa.int32()),
                    "doc_id": pa.array(block["doc_ids"], pa.int64()),
                    "at": pa.array(block["before"] + ends - sizes, pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                }
                yield pa.RecordBatch.from_arrays([*columns.values(), made(ids, sizes, ends)], schema=schema)

    return blocks.mapInArrow(rows, names)


def _part_starts(blocks: DataFrame) -> DataFrame:
    """``of, part_start``: the ids in front of each part.

    Parts are added up within groups of a thousand, then the groups, so that no task sees all parts.
    """
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    sizes = sizes.withColumn("bundle", F.floor(F.col("part") / 1000))
    within = Window.partitionBy("bundle").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("bundle").rowsBetween(Window.unboundedPreceding, -1)
    bundles = sizes.groupBy("bundle").agg(F.sum("n").alias("n"))
    bundles = bundles.select("bundle", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("bundle_start"))
    parts = sizes.withColumn("inner_start", F.coalesce(F.sum("n").over(within), F.lit(0))).join(bundles, "bundle")
    return parts.select(F.col("part").alias("of"), (F.col("bundle_start") + F.col("inner_start")).alias("part_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of all documents in a folder of token files: the ids
    of all documents before it, its own, their crc32 as little-endian unsigned 32-bit numbers, and
    the ids themselves (``array<long>``)."""
    return _documents(spark, path, True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the same without the ids leaving the tasks."""
    return _documents(spark, path, False)


def _documents(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    def crc(ids, sizes, ends):
        view = memoryview(ids.tobytes())
        sums = [zlib.crc32(view[4 * (b - n) : 4 * b]) for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
        return pa.array(sums, pa.int64())

    def crc_and_ids(ids, sizes, ends):
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends))), pa.array(ids.astype(np.int64)))
        return pa.StructArray.from_arrays([crc(ids, sizes, ends), lists.cast(pa.list_(pa.int64()))], names=["c", "i"])

    made, kind, sql = crc, pa.int64(), "long"
    if with_ids:
        made, sql = crc_and_ids, "struct<c: long, i: array<long>>"
        kind = pa.struct([("c", pa.int64()), ("i", pa.list_(pa.int64()))])
    schema = pa.schema(
        [("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("found", kind)]
    )
    blocks = read_blocks(spark, path)
    rows = _decoded(blocks, schema, f"part int, doc_id long, at long, n_tokens long, found {sql}", made)
    placed = rows.join(_part_starts(blocks), F.col("part") == F.col("of"))
    out = placed.select(
        "doc_id",
        (F.col("part_start") + F.col("at")).alias("start"),
        "n_tokens",
        (F.col("found.c") if with_ids else F.col("found")).alias("ids_crc32"),
        *([F.col("found.i").alias("ids")] if with_ids else []),
    )
    return out


def token_digests(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int | None = 1) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder, read them back, and return ``read_digests``."""
    spark = docs.sparkSession
    path = f"{store.shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary, end_id)
    return read_digests(spark, path)
