"""Language identification by naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import arrays, store
from scanloom.llm.quality import held_out

#: Hash buckets of n-grams of each language.
GRAM_BITS = 15
SIZES = (1, 2, 3)
#: Documents of each language that are learned from, at most (about).
FIT_DOCUMENTS = 8_000
#: Languages whose probabilities are one broadcast, of 8 MB. More languages are several, one after another.
BLOCK_LANGUAGES = 64

_BUCKETS = 1 << GRAM_BITS
_SMOOTHING = 0.1


def _grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of some rows, each row's first one, and whether it has a letter.

    Characters are lower-cased; a run of characters that are no letters is one blank, so n-grams know
    where words begin and end. A row's n-grams of all sizes stand together.
    """
    for part in arrays.parts(column, 1 << 16):
        text = part.data.tobytes().decode("utf-8", "replace")
        # Row limits in characters: bytes that do not continue one begin one.
        begins = np.concatenate(([0], np.cumsum((part.data & 0xC0) != 0x80)))[part.offsets]
        lowered = text.lower()
        if len(lowered) != len(text):
            # A few characters have longer small forms; these stay as they are.
            lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = np.unique(codes)
        is_letter = np.array([chr(c).isalpha() for c in kinds], dtype=bool)
        letter = is_letter[np.searchsorted(kinds, codes)]
        start = np.zeros(len(codes) + 1, dtype=bool)
        start[begins] = True
        row = np.repeat(np.arange(len(part)), np.diff(begins))
        keep = letter.copy()
        keep[1:] |= letter[:-1] & ~start[1:-1]
        row, values = row[keep], np.where(letter, codes, 0x20)[keep].astype(np.uint64)
        hashed, rows = [], []
        for size in SIZES:
            if len(values) < size:
                continue
            n = len(values) - size + 1
            whole = row[:n] == row[size - 1 :]
            code = np.full(n, size, dtype=np.uint64)
            for k in range(size):
                code = code * np.uint64(0x100000001B3) + values[k : k + n]
            hashed.append(code[whole])
            rows.append(row[:n][whole])
        if hashed:
            rows = np.concatenate(rows)
            order = np.argsort(rows, kind="stable")
            bucket = (arrays.mix(np.concatenate(hashed)[order]) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
            rows = rows[order]
        else:
            bucket, rows = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        has = np.zeros(len(part), dtype=bool)
        has[row[values != 0x20]] = True
        yield part.first, bucket, np.searchsorted(rows, np.arange(len(part) + 1)), has


def _known(docs: DataFrame) -> DataFrame:
    """Rows to learn from: those with text and lang that are not held out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())


def _log_probabilities(known: DataFrame, counts: dict[str, int], names: list[str], fit_documents: int) -> np.ndarray:
    """The matrix of log probabilities of n-gram buckets, a column for each of some languages.

    Learned from a share of each language's rows, chosen by a hash of their ids, about ``fit_documents``.
    """
    share = F.create_map(
        *[x for n in names for x in (F.lit(n), F.lit(min(10**6, int(fit_documents * 10**6 / counts[n]) + 1)))]
    )
    sample = known.where(
        F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10**6)) < share[F.col("lang")], F.lit(False))
    ).select("text", "lang")
    number = {n: k for k, n in enumerate(names)}

    def share_of(batches):
        out = np.zeros((len(names), _BUCKETS), dtype=np.int64)
        for batch in batches:
            language = np.array([number[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for at, bucket, first, _ in _grams(batch.column(0)):
                own = np.repeat(language[at : at + len(first) - 1], np.diff(first))
                np.add(out, np.bincount(own * _BUCKETS + bucket, minlength=out.size).reshape(out.shape), out=out)
        return out.ravel()

    table = store.totals(sample, share_of, len(names) * _BUCKETS, "i8", np.add).reshape(len(names), _BUCKETS)
    smooth = table + _SMOOTHING
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
    return np.ascontiguousarray(logs)


def _scored(model: object, last: bool):
    """Adds a block of languages: the best one so far, its sum, and the sum over all languages as a log.
    The text goes on to the next block."""

    def rows(batches):
        names, prior, logs = store.received(model)
        for batch in batches:
            lang = batch.column(2).to_pylist()
            best = batch.column(3).to_numpy(zero_copy_only=False).copy()
            mass = batch.column(4).to_numpy(zero_copy_only=False).copy()
            for at, bucket, first, has in _grams(batch.column(1)):
                some = np.flatnonzero(has & (np.diff(first) > 0))
                if not len(some):
                    continue
                sums = np.add.reduceat(logs[bucket], first[some], axis=0, dtype=np.float64) + prior
                top = sums.argmax(axis=1)
                value = sums[np.arange(len(some)), top]
                whole = value + np.log(np.exp(sums - value[:, None]).sum(axis=1))
                row = at + some
                # Blocks come in the order of the names, so a tie stays with the earlier one.
                better = value > best[row]
                for k in np.flatnonzero(better):
                    lang[row[k]] = names[top[k]]
                best[row] = np.maximum(best[row], value)
                mass[row] = np.logaddexp(mass[row], whole)
            columns = [*batch.columns[: 1 if last else 2], pa.array(lang, pa.string()), pa.array(best), pa.array(mass)]
            names_out = [n for n in batch.schema.names if n != "text" or not last]
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return rows


def identify(
    docs: DataFrame, fit_documents: int = FIT_DOCUMENTS, block_languages: int = BLOCK_LANGUAGES
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs`` (``doc_id, text, lang``).

    The prediction comes from the whole text alone; its score is the posterior probability of the
    language. Every language that is learned from can be predicted: ``block_languages`` of them at a time
    are broadcast, and the best of all and the sum over all are carried from one to the next. Priors
    count all rows that are learned from. ``und`` with score 0 where the text is null or has no letter,
    and for every row where nothing could be learned. Ties go to the first language by name. Rows with
    null or repeated ids have a row each; an empty table has none. Long texts are looked at whole, in
    parts of whole rows; other columns play no part.
    """
    known = _known(docs)
    # One row for each language.
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names, whole = sorted(counts), sum(counts.values())
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.lit(None).cast("string").alias("lang_pred"),
        F.lit(float("-inf")).alias("best"),
        F.lit(float("-inf")).alias("mass"),
    )
    schema = "doc_id long, text string, lang_pred string, best double, mass double"
    for at in range(0, len(names), block_languages):
        some = names[at : at + block_languages]
        logs = _log_probabilities(known, counts, some, fit_documents)
        prior = np.log([counts[n] / whole for n in some])
        last = at + block_languages >= len(names)
        kept = schema.replace("text string, ", "") if last else schema
        scored = scored.mapInArrow(_scored(store.sent(docs, (some, prior, logs)), last), kept)
    found = F.col("lang_pred").isNotNull()
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"),
        F.when(found, F.least(F.exp(F.col("best") - F.col("mass")), F.lit(1.0))).otherwise(0.0).alias("score"),
    )
