"""Any number of custom rules in one read of the files: rules as a table.

The texts that patterns need (``jspattern.Needs``) say which lines of a file may hold a match. The texts of
rules in a list go into one automaton, which runs once over a file's content; those of rules that are a
table of any size go into filters of bits, which let all of them pass and few others. The (line, text)
pairs found meet the table of patterns by an equi-join, and only what meets reaches a regex. So neither
the plan nor the work on a line grows with the number of rules, but with what the lines hold.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import paths
from scanloom.functions.jsregex import lower_texts
from scanloom.operators.catalog import Rule

# Characters of needed texts in one automaton; rules with more are read in several passes.
AUTOMATON_TEXT = 1 << 24

#: The text of patterns that need no text, which a regex of them all finds on every line.
_NO_TEXT = ""
# Patterns of one such regex.
JOINED_PATTERNS = 50
# Up to so many patterns of a table that need no text are asked in such regexes ahead of the join.
ASKED_AHEAD = 1000
# Up to so many path patterns of a table choose the files that are read.
KNOWN_KEYS = 1000

# Bits of a filter: sixteen for each text, of which it sets four, between these.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
# Lengths of the beginnings of texts that are looked for first.
BEGINNINGS = (8, 4, 2, 1)
# Characters hashed at a time.
STRETCH = 1 << 17

# Files, and rules, of a block of pairs.
BLOCK = 1000

_PATTERNS = (
    "rule_ordinal int, code int, place int, regex string, texts array<string>, reach array<string>"
)

#: What finds texts in lower-cased content: pairs of the place of the last character and the text.
Finder = Callable[[str], Iterable[tuple[int, str]]]


# --- rules in a list -----------------------------------------------------------------------------


def _described(rules: Sequence[Rule], book) -> list[dict]:
    """Pattern rows, with their needed texts in lower case."""
    rows = []
    for rule in rules:
        first = book.first_code(rule)
        reach = [paths.reach_key(p) for p in rule.applicable_to]
        for place, p in enumerate(rule.patterns):
            rows.append(
                {
                    "rule_ordinal": rule.ordinal,
                    "code": first + place,
                    "place": place,
                    "regex": p.regex,
                    "texts": lower_texts(p.needs, p.needs_folded) or [_NO_TEXT],
                    "reach": reach,
                }
            )
    return rows


def _passes(rules: Sequence[Rule]) -> Iterator[list[Rule]]:
    """Rules in groups whose needed texts fit one automaton; nearly always one."""
    group, size = [], 0
    for rule in rules:
        own = sum(len(t) for p in rule.patterns for t in p.needs + p.needs_folded)
        if group and size + own > AUTOMATON_TEXT:
            yield group
            group, size = [], 0
        group.append(rule)
        size += own
    if group:
        yield group


def _table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    constant = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_PATTERNS.replace(' ', ':').replace(',:', ',')}>>")
    return spark.range(1).select(F.inline(constant))


def _automaton(spark: SparkSession, texts: set[str]) -> Callable[[], Finder | None]:
    automaton = None
    if texts:
        automaton = ahocorasick.Automaton()
        for text in texts:
            automaton.add_word(text, text)
        automaton.make_automaton()
    # One object of bounded size, which travels once to each executor.
    shared = spark.sparkContext.broadcast(automaton)
    return lambda: shared.value.iter if shared.value is not None else None


def table_hits(files: DataFrame, rules: Sequence[Rule], book) -> DataFrame:
    """Hits of custom rules over ``files(project_id, path, content)``, as ``detect`` has them.

    Of a rule's patterns the first that matches a line counts. Files that repeat a path each count.
    """
    spark = files.sparkSession
    parts = []
    for group in _passes(rules):
        rows = _described(group, book)
        reach = sorted({k for r in rows for k in r["reach"]})
        known = F.from_json(F.lit(json.dumps(reach)), "array<string>")
        keyed = _keyed(files, sorted({len(k) - 1 for k in reach if k[0] == "s"}), known)
        untied = [r["regex"] for r in rows if r["texts"] == [_NO_TEXT]]
        texts = {t for r in rows for t in r["texts"]} - {_NO_TEXT}
        lines = candidate_lines(keyed, _automaton(spark, texts), bool(untied))
        parts.append(_hits(lines, _table(spark, rows), _found_without_text(untied) if untied else None))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


# --- rules that are a table ----------------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
#: Odd numbers that say which bits a text has, in the filter of beginnings and in that of whole texts.
_OF_BEGINNINGS = (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9)
_OF_TEXTS = (0x94D049BB133111EB, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    factors = np.full((2, n), [[_ODD], [pow(_ODD, -1, 1 << 64)]], dtype=np.uint64)
    factors[:, 0] = 1
    return tuple(np.cumprod(factors, axis=1, dtype=np.uint64))


def _sums(text: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """The hash of what stands between two places is the difference of their sums, times an inverse power."""
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text + np.uint64(1)) * powers[: len(text)], out=sums[1:])
    return sums


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)


def _places(hashes: np.ndarray, factor: int, size: int) -> np.ndarray:
    """One bit for each hash in a filter of ``size`` bits, a power of two."""
    return (hashes * np.uint64(factor)) >> np.uint64(65 - size.bit_length())


def _passing(bits: np.ndarray, factors: Sequence[int], hashes: np.ndarray) -> np.ndarray:
    """The places of the hashes that a filter passes."""
    at = None
    for factor in factors:
        place = _places(hashes if at is None else hashes[at], factor, len(bits) * 8)
        is_set = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
        at = np.flatnonzero(is_set) if at is None else at[is_set]
    return at


def text_filter(texts: DataFrame, n: int, factors: Sequence[int]) -> np.ndarray:
    """A filter over a column of about ``n`` texts. It passes all of them, and few others while they are fewer
    than its bits; its size is bounded. Tasks set bits, and words of bits that are set come to the driver."""
    size = min(max(1 << (16 * n - 1).bit_length(), LEAST_BITS), MOST_BITS)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = inverse = np.zeros(0)
        for batch in batches:
            given = batch.column(0).to_pylist()
            ends = np.cumsum([len(t) for t in given])
            if not given:
                continue
            if ends[-1] + 1 > len(powers):
                powers, inverse = _powers(int(ends[-1]) + 1)
            sums = _sums(_characters("".join(given)), powers)
            starts = np.concatenate([[0], ends[:-1]])
            hashes = (sums[ends] - sums[starts]) * inverse[starts]
            at = np.unique(np.concatenate([_places(hashes, f, size) for f in factors]))
            word, first = np.unique(at >> np.uint64(5), return_index=True)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(31)), first)
            yield pa.record_batch({"word": word.astype(np.int32), "mask": masks.astype(np.int64)})

    found = texts.mapInArrow(words, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    table = found.toArrow()
    bits = np.zeros(size // 32, dtype="<u4")
    bits[table["word"].to_numpy()] = table["mask"].to_numpy().astype("<u4")
    return bits.view(np.uint8)


def _filtered(texts: DataFrame) -> tuple[Callable[[], Finder | None], int]:
    """What finds the texts of a column, and the number of empty ones in it."""
    spark = texts.sparkSession
    begun, whole = F.approx_count_distinct(F.left("text", F.lit(BEGINNINGS[0]))), F.approx_count_distinct("text")
    counts = texts.groupBy(F.length("text").alias("length")).agg(F.count(F.lit(1)), begun, whole).collect()
    empty = sum(n for length, n, _, _ in counts if not length)
    counts = {length: of for length, _, *of in counts if length}
    if not counts:
        return lambda: None, empty
    # Lengths of texts by the length of the beginning that is looked for first.
    lengths: dict[int, list[int]] = {}
    for n in sorted(counts):
        lengths.setdefault(next(b for b in BEGINNINGS if b <= n), []).append(n)
    real = texts.where(F.col("text") != _NO_TEXT)
    size = F.length("text")
    begun = F.lit(1)
    for b in reversed(BEGINNINGS[:-1]):
        begun = F.when(size >= b, F.lit(b)).otherwise(begun)
    begun = real.select(F.left("text", begun).alias("text")).distinct()
    few, many = map(sum, zip(*counts.values(), strict=True))
    filters = text_filter(begun, few, _OF_BEGINNINGS), text_filter(real, many, _OF_TEXTS)
    shared = spark.sparkContext.broadcast(filters)
    longest = max(counts)

    def finder() -> Finder:
        beginnings, whole = shared.value
        powers, inverse = _powers(STRETCH + longest)

        def find(low: str) -> Iterator[tuple[int, str]]:
            content = _characters(low)
            for begin in range(0, len(content), STRETCH):
                part = content[begin : begin + STRETCH + longest - 1]
                sums = _sums(part, powers)
                for width, own in lengths.items():
                    n = min(STRETCH, len(part) - width + 1)
                    if n <= 0:
                        continue
                    at = _passing(beginnings, _OF_BEGINNINGS, (sums[width : width + n] - sums[:n]) * inverse[:n])
                    for length in own if len(at) else ():
                        some = at[at + length <= len(part)]
                        some = some[_passing(whole, _OF_TEXTS, (sums[some + length] - sums[some]) * inverse[some])]
                        for start in (some + begin).tolist():
                            yield start + length - 1, low[start : start + length]

        return find

    return finder, empty


def joined_hits(files: DataFrame, rules: DataFrame, numbers: DataFrame) -> DataFrame:
    """The same as ``table_hits`` of rules that stay a table, with ``facts``.

    ``rules`` and ``numbers`` are as a ``Rulebook`` has them. What comes to the driver is bounded: lengths,
    counts, two filters, and few patterns.
    """
    patterns = rules.join(numbers, "rule_id").select(
        "rule_ordinal",
        "first_code",
        F.transform("applicable_to", paths.reach_key_column).alias("reach"),
        *("rule_id", "severity", "category"),
        F.posexplode("patterns").alias("place", "p"),
    ).select(
        "rule_ordinal",
        (F.col("first_code") + F.col("place")).alias("code"),
        "place",
        F.col("p.regex").alias("regex"),
        F.when(F.size("p.texts") > 0, F.col("p.texts")).otherwise(F.array(F.lit(_NO_TEXT))).alias("texts"),
        "reach",
        F.struct("rule_id", "severity", "category", F.col("p.message").alias("template")).alias("facts"),
    )
    needed = rules.select(F.explode("patterns").alias("p")).select("p.regex", F.col("p.texts").alias("texts"))
    find, empty = _filtered(
        needed.select(F.explode(F.when(F.size("texts") > 0, F.col("texts")).otherwise(F.array(F.lit(_NO_TEXT)))).alias("text"))
    )
    ahead, blocks = None, 1
    if empty > ASKED_AHEAD:
        blocks = -(-empty // ASKED_AHEAD)
    elif empty:
        ahead = _found_without_text([r.regex for r in needed.where(F.size("texts") == 0).select("regex").collect()])
    keys = rules.select(F.explode("applicable_to").alias("p")).select(paths.reach_key_column(F.col("p")).alias("key")).distinct()
    known = [r.key for r in keys.limit(KNOWN_KEYS + 1).collect()]
    lengths = keys.where(F.startswith("key", F.lit("s"))).select((F.length("key") - 1).alias("n")).distinct()
    few = F.array(*map(F.lit, sorted(known))).cast("array<string>") if len(known) <= KNOWN_KEYS else None
    keyed = _keyed(files, sorted(r.n for r in lengths.collect()), few)
    return _hits(candidate_lines(keyed, find, empty > 0), patterns, ahead, blocks)


# --- both ----------------------------------------------------------------------------------------


def _found_without_text(untied: Sequence[str]) -> Column:
    """Whether a line may match one of the patterns that need no text."""
    regexes = sorted(set(untied))
    # Numbered groups keep their numbers only in a regex of their own.
    alone = [r for r in regexes if re.search(r"\\[1-9]", r)]
    joined = [r for r in regexes if r not in set(alone)]
    tests = alone + [
        "|".join(f"(?:{r})" for r in joined[k : k + JOINED_PATTERNS])
        for k in range(0, len(joined), JOINED_PATTERNS)
    ]
    found = F.lit(False)
    for t in tests:
        found = found | F.rlike("raw", F.lit(t))
    return found


def _keyed(files: DataFrame, lengths: Sequence[int], known: Column | None) -> DataFrame:
    """Files with the keys of their paths, of the known ones if these are few enough to be given."""
    keys = paths.path_keys(F.col("path"), lengths)
    return files.select(
        "project_id",
        "path",
        "content",
        (keys if known is None else F.array_intersect(keys, known)).alias("keys"),
        F.monotonically_increasing_id().alias("file"),
    ).where(F.size("keys") > 0)


def candidate_lines(files: DataFrame, finder: Callable[[], Finder | None], every_line: bool) -> DataFrame:
    """``project_id, path, keys, file, line, raw, texts``: lines that hold needed texts, with these.

    ``files`` has ``project_id, path, content, keys``; ``finder`` gives what finds texts, or None where there
    are none. Texts are compared in lower case, which finds more than it must. With ``every_line`` all lines
    come, with the empty text as well.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = finder()
        for batch in batches:
            columns: dict[str, list] = {k: [] for k in ("project_id", "path", "keys", "file", "line", "raw", "texts")}
            held = 0
            for project, path, content, keys, file in batch.itertuples(index=False):
                if content is None:
                    continue
                low = content.lower()
                ends = None
                found: dict[int, set[str]] = {}
                if find is not None:
                    for at, text in find(low):
                        if ends is None:
                            # A character's lower case may be two, but none is or holds a line end.
                            ends = [k for k, c in enumerate(low) if c == "\n"] if "\n" in low else []
                        found.setdefault(bisect_right(ends, at), set()).add(text)
                if not found and not every_line:
                    continue
                lines = content.split("\n")
                for line in range(len(lines)) if every_line else sorted(found):
                    columns["project_id"].append(project)
                    columns["path"].append(path)
                    columns["keys"].append(keys)
                    columns["file"].append(file)
                    columns["line"].append(line + 1)
                    columns["raw"].append(lines[line])
                    columns["texts"].append(sorted(found.get(line, ())) + [_NO_TEXT] * every_line)
                    held += len(lines[line]) + 100
                    if held > 1 << 23:
                        yield pd.DataFrame(columns)
                        columns, held = {k: [] for k in columns}, 0
            if columns["line"]:
                yield pd.DataFrame(columns)

    return files.select("project_id", "path", "content", "keys", "file").mapInPandas(
        rows,
        "project_id string, path string, keys array<string>, file long, line int, raw string, texts array<string>",
    )


def _hits(lines: DataFrame, patterns: DataFrame, ahead: Column | None, blocks: int = 1) -> DataFrame:
    """Lines meet patterns by their texts. ``ahead`` tells lines that may match a pattern without a text.

    Where these patterns are too many to be asked ahead, they are dealt in ``blocks``, and the lines in as
    many parts as there are partitions, so that their pairs do not land in one task.
    """
    facts = [c for c in ("facts",) if c in patterns.columns]
    each = lines.select("project_id", "path", "keys", "file", "line", "raw", F.explode("texts").alias("text"))
    patterns = patterns.select("rule_ordinal", "code", "place", "regex", "reach", *facts, F.explode("texts").alias("of"))
    met = F.col("text") == F.col("of")
    if ahead is not None:
        each = each.where((F.col("text") != _NO_TEXT) | ahead)
    elif blocks > 1:
        parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        none, zero = F.col("text") == _NO_TEXT, F.array(F.lit(0))

        def dealt(n: int, untied: Column) -> Column:
            return F.explode(F.when(untied, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(zero))

        part = F.when(none, F.pmod(F.xxhash64("file", "line"), F.lit(parts))).otherwise(0).cast("int")
        each = each.select("*", part.alias("part"), dealt(blocks, none).alias("block"))
        untied = F.col("of") == _NO_TEXT
        block = F.when(untied, F.pmod(F.col("code"), F.lit(blocks))).otherwise(0).cast("int")
        patterns = patterns.select("*", block.alias("of_block"), dealt(parts, untied).alias("of_part"))
        met = met & (F.col("block") == F.col("of_block")) & (F.col("part") == F.col("of_part"))
    found = each.join(patterns, met).where(F.arrays_overlap("keys", "reach") & F.rlike("raw", F.col("regex")))
    # Lines are left behind here, so that what is sorted and shuffled is small.
    found = found.select(
        *("project_id", "path", "file", "rule_ordinal", "line"),
        F.struct("place", "code", F.expr("regexp_extract(raw, regex, 0)").alias("detail"), *facts).alias("hit"),
    )
    # One pattern may be found by several of its texts; one value for each rule and line.
    found = found.groupBy("project_id", "path", "file", "rule_ordinal", "line").agg(F.min("hit").alias("first"))
    return found.select(
        "project_id",
        "path",
        "rule_ordinal",
        F.col("line").alias("ord"),
        F.lit(0).alias("sub"),
        "line",
        F.col("first.code").alias("code"),
        F.col("first.detail").alias("detail"),
        *[F.col(f"first.{c}").alias(c) for c in facts],
    )


def rules_by_path(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``project_id, path`` of every file with ``rule_id`` of each rule that applies, by an equi-join.

    ``rules`` has ``rule_id, applicable_to``. Each path gives its file name and its endings of the
    lengths that occur in the table as keys; so many rules cost no comparison of each with each.
    Files whose keys meet the same keys of the table have the same rules. These are found once for each
    such set of keys and listed; files and lists meet block by block, so that a pair of file and rule is
    made once, in any task, and is not shuffled.
    """
    wanted = rules.select("rule_id", F.explode("applicable_to").alias("p")).where(F.col("p").isNotNull())
    wanted = wanted.select("rule_id", paths.reach_key_column(F.col("p")).alias("key")).distinct()
    lengths = wanted.where(F.startswith("key", F.lit("s"))).select((F.length("key") - 1).alias("n")).distinct()
    # Lengths of path endings are few: at most as many as the longest has characters.
    found = sorted(r.n for r in lengths.collect())
    keyed = files.select("project_id", "path").withColumn("file", F.monotonically_increasing_id())
    keyed = keyed.withColumn("key", F.explode(paths.path_keys(F.col("path"), found)))
    met = keyed.join(wanted.select("key").distinct(), "key")
    met = met.groupBy("project_id", "path", "file").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    listed = met.select("keys").distinct().select("keys", F.explode("keys").alias("key")).join(wanted, "key")
    listed = listed.select("keys", "rule_id").distinct()
    # Files and rules of a set meet in blocks of about BLOCK by BLOCK; a rule without an id counts too.
    sets = met.groupBy("keys").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("tall"))
    many = listed.groupBy("keys").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("wide"))
    sets = sets.join(many, "keys")
    lists = listed.join(sets, "keys").groupBy("keys", "tall", F.pmod(F.xxhash64("rule_id"), "wide").alias("column"))
    lists = lists.agg(F.collect_list(F.struct("rule_id")).alias("rules"))
    lists = lists.select("keys", "column", "rules", F.explode(F.sequence(F.lit(0), F.col("tall") - 1)).alias("row"))
    each = met.join(sets, "keys").withColumn("row", F.pmod(F.xxhash64("project_id", "path", "file"), "tall"))
    each = each.select(
        "project_id", "path", "keys", "row", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("column")
    )
    # Dealt by a fixed number, as little comes in and much goes out.
    partitions = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = each.repartition(partitions, "keys", "column", "row").join(lists, ["keys", "column", "row"])
    return dealt.select("project_id", "path", F.inline("rules"))
