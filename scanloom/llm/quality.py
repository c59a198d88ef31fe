"""A quality classifier: random-indexing word vectors, pooled, and a small network on top."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import arrays, store

#: Numbers per word vector, and word vectors (words share them by hash): 2 MB as 32-bit numbers.
DIMENSIONS = 32
BUCKET_BITS = 14
#: Of the labelled documents, one in so many is held back to choose among steps and set the temperature.
CALIBRATE_ONE_IN = 5
#: Passes over the labelled documents that improve the network, at most, and labelled rows of a task.
STEPS = 50
TASK_ROWS, MOST_TASKS = 10_000, 256

_BUCKETS = 1 << BUCKET_BITS
_NEIGHBOURS = 2
_NOT_ZERO = 4
_HIDDEN = 24
#: Bytes that are neither blank nor part of a word: signs.
_SIGN = arrays.NOT_BLANK & ~arrays.ALNUM
#: Hashes of the two marks a word can carry: written in capitals, same as the word before.
_CAPITALS, _REPEATED = 0x51ED270B9F1C2A35, 0x2545F4914F6CDD1D


def index_vectors() -> np.ndarray:
    """Sparse random vectors of -1, 0 and 1, one a bucket, always the same."""
    rng = np.random.default_rng(7)
    out = np.zeros((_BUCKETS, DIMENSIONS), dtype=np.float32)
    for _ in range(_NOT_ZERO):
        at = rng.integers(0, DIMENSIONS, _BUCKETS)
        out[np.arange(_BUCKETS), at] += rng.choice([-1.0, 1.0], _BUCKETS).astype(np.float32)
    return out


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Buckets of the tokens of some rows, in order, and each row's first one.

    Tokens are words (A-Z in lower case), runs of signs, a mark after a word of capitals only, and a
    mark after a word that equals the one before.
    """
    hashes = arrays.SpanHash()
    for part in arrays.parts(column):
        raw = part.data
        part.data = arrays.LOWER[raw]
        words = arrays.spans(part, arrays.ALNUM)
        signs = arrays.spans(part, _SIGN)
        hw = hashes(part.data, words.starts, words.ends)
        hs = hashes(part.data, signs.starts, signs.ends)
        changed = np.concatenate(([0], np.cumsum(raw != part.data)))
        small = np.concatenate(([0], np.cumsum((raw >= 0x61) & (raw <= 0x7A))))
        capital = (changed[words.ends] - changed[words.starts] > 1) & (small[words.ends] == small[words.starts])
        again = np.zeros(len(hw), dtype=bool)
        again[1:] = (hw[1:] == hw[:-1]) & (words.row[1:] == words.row[:-1])
        places = [words.starts, signs.starts, words.starts[capital], words.starts[again]]
        rows = [words.row, signs.row, words.row[capital], words.row[again]]
        codes = [
            hw,
            hs,
            np.full(int(capital.sum()), _CAPITALS, dtype=np.uint64),
            np.full(int(again.sum()), _REPEATED, dtype=np.uint64),
        ]
        order = np.argsort(np.concatenate(places), kind="stable")
        row = np.concatenate(rows)[order]
        bucket = (np.concatenate(codes)[order] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        yield part.first, bucket, np.searchsorted(row, np.arange(len(part) + 1))


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors: each bucket's own random vector and those of its neighbours in the documents."""
    vectors = index_vectors()
    # A vector has few numbers that are not 0: their places and values.
    places = np.argsort(vectors == 0, axis=1, kind="stable")[:, :_NOT_ZERO].astype(np.int64)
    values = np.take_along_axis(vectors, places, axis=1)

    def share(batches):
        out = np.zeros(_BUCKETS * DIMENSIONS, dtype=np.float32)
        for batch in batches:
            for _, bucket, first in _tokens(batch.column(0)):
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for step in range(1, _NEIGHBOURS + 1):
                    same = np.flatnonzero(row[step:] == row[:-step])
                    for a, b in ((same, same + step), (same + step, same)):
                        near, row_of = bucket[b], bucket[a] * DIMENSIONS
                        for d in range(_NOT_ZERO):
                            out += np.bincount(
                                row_of + places[near, d], weights=values[near, d], minlength=len(out)
                            ).astype(np.float32)
        return out

    sums = store.totals(docs, share, _BUCKETS * DIMENSIONS, "f4", np.add).reshape(_BUCKETS, DIMENSIONS)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    out = vectors / 2 + np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Per row the mean word vector and the logarithm of the number of tokens."""
    out = np.zeros((len(column), DIMENSIONS + 1), dtype=np.float64)
    for at, bucket, first in _tokens(column):
        many = np.diff(first)
        some = np.flatnonzero(many)
        if len(some):
            sums = np.add.reduceat(vectors[bucket], first[some], axis=0)
            out[at + some, :DIMENSIONS] = sums / many[some, None]
        out[at : at + len(many), DIMENSIONS] = np.log1p(many)
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; the temperature calibrates its probabilities."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray) -> Network:
    """The network fitted on the rows not held back, its temperature on those held back."""
    return fit_sums(lambda of: of(x, y, calibrate), x.shape[1])


def _side(calibrate: np.ndarray, fitted: str) -> np.ndarray:
    """Rows a step is taken from: those not held back, or all."""
    return ~calibrate if fitted == "rest" else np.ones(len(calibrate), bool)


def fit_sums(total: Callable[[Callable], np.ndarray], width: int) -> Network:
    """The same from sums over all rows: ``total`` adds up what a function makes of parts ``x, y, calibrate``.

    L-BFGS on the loss of the whole; of its steps the one best on the rows held back stays. Without rows
    of both labels the score is the share of label 1 (a half without any label).
    """
    many, ones, back, back_ones = total(
        lambda x, y, c: np.array([len(y), y.sum(), c.sum(), y[c].sum()], dtype=np.float64)
    )
    if ones in (0, many):
        share = (ones + 1) / (many + 2)
        return Network(
            np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1),
            float(np.log(share / (1 - share))),
        )
    fitted = "rest" if 0 < ones - back_ones < many - back else "all"

    def moments(x, y, c):
        x = x[_side(c, fitted)].astype(np.float64)
        return np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))

    sums = total(moments)
    rows = sums[0]
    centre = sums[1 : width + 1] / rows
    scale = np.sqrt(np.maximum(sums[width + 1 :] / rows - centre * centre, 0)) + 1e-3
    rng = np.random.default_rng(11)
    cut = np.cumsum([width * _HIDDEN, _HIDDEN, _HIDDEN])
    start = np.concatenate(
        (rng.normal(0, width**-0.5, width * _HIDDEN), np.zeros(_HIDDEN), rng.normal(0, _HIDDEN**-0.5, _HIDDEN), [0.0])
    )

    def network(p: np.ndarray) -> Network:
        w1, b1, w2, b2 = np.split(p, cut)
        return Network(centre, scale, w1.reshape(width, _HIDDEN), b1, w2, float(b2[0]))

    def value(p: np.ndarray) -> tuple[float, np.ndarray, float]:
        """Loss and its slope on the fitted rows, and the loss on those held back."""
        net = network(p)

        def part(x, y, c):
            z = (x - centre) / scale
            h = np.tanh(z @ net.w1 + net.b1)
            logits = h @ net.w2 + net.b2
            loss = np.logaddexp(0, logits) - y * logits
            use = _side(c, fitted)
            d = np.where(use, 1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y, 0.0)
            inner = np.outer(d, net.w2) * (1 - h * h)
            return np.concatenate(
                ([loss[use].sum(), loss[c].sum()], (z.T @ inner).ravel(), inner.sum(axis=0), h.T @ d, [d.sum()])
            )

        sums = total(part)
        slope = sums[2:] / rows
        slope[: cut[0]] += 1e-4 * p[: cut[0]]
        loss = sums[0] / rows + 0.5e-4 * float(p[: cut[0]] @ p[: cut[0]])
        return loss, slope, sums[1] / back if back else loss

    best = descend(value, start)
    net = network(best)
    temperatures = np.geomspace(0.3, 8, 60)

    def by_temperature(x, y, c):
        use = c if back else np.ones(len(y), bool)
        logits, labels = net.logits(x[use]), y[use]
        return np.array([(np.logaddexp(0, logits / t) - labels * logits / t).sum() for t in temperatures])

    net.temperature = float(temperatures[np.argmin(total(by_temperature))])
    return net


def descend(value: Callable[[np.ndarray], tuple[float, np.ndarray, float]], p: np.ndarray) -> np.ndarray:
    """L-BFGS from ``p``: of the points seen the one of the least third value."""
    loss, slope, held = value(p)
    best, least = p, held
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    length, since = 1 / max(float(np.linalg.norm(slope)), 1e-12), 0
    for _ in range(STEPS):
        # The inverse curvature of the last steps, applied to the slope.
        way, kept = slope.copy(), []
        for s, g in reversed(pairs):
            kept.append((s @ way) / (s @ g))
            way -= kept[-1] * g
        if pairs:
            s, g = pairs[-1]
            way *= (s @ g) / (g @ g)
        for (s, g), k in zip(pairs, reversed(kept), strict=True):
            way += s * (k - (g @ way) / (s @ g))
        down = float(slope @ way)
        if down <= 1e-10:
            break
        for _ in range(6):
            to = p - length * way
            loss_to, slope_to, held_to = value(to)
            if loss_to <= loss - 1e-4 * length * down:
                break
            length /= 4
        else:
            break
        s, g = to - p, slope_to - slope
        if s @ g > 1e-12:
            pairs = [*pairs, (s, g)][-10:]
        since = 0 if held_to < least * (1 - 1e-4) else since + 1
        if held_to < least:
            best, least = to, held_to
        p, loss, slope, length = to, loss_to, slope_to, 1.0
        if since >= 6:
            break
    return best


def held_out(name: str = "doc_id"):
    """Whether a row is never learned from: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors from the texts of all documents not held out, the network from all labelled ones of them.

    Texts do not move: a filter of fixed size picks the labelled ones, whose few numbers meet the labels by
    a join. Every step of the network is a pass over these numbers, of which sums of fixed size come back.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = store.kept(known.where(~held_out() & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(~held_out() & F.col("doc_id").isNotNull())
    vectors = context_vectors(texts.select("text"))
    shared = store.sent(docs, (vectors, store.id_filter(known.select("doc_id"))))

    def numbers(batches):
        vectors, wanted = store.received(shared)
        for batch in batches:
            batch = batch.filter(pa.array(store.passes(wanted, batch.column(0).to_numpy(zero_copy_only=False))))
            x = pooled(batch.column(1), vectors).astype(np.float32)
            offsets = np.arange(len(x) + 1) * x.shape[1]
            values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch({"doc_id": batch.column(0), "x": values})

    width = DIMENSIONS + 1
    tasks = min(MOST_TASKS, 1 + known.count() // TASK_ROWS)
    labelled = texts.mapInArrow(numbers, "doc_id long, x array<float>").join(known, "doc_id")

    def blocks(batches):
        for batch in batches:
            if len(batch):
                x = batch.column(1).flatten().to_numpy().reshape(-1, width)
                ids = batch.column(0).to_numpy().view(np.uint64)
                back = arrays.mix(ids) % np.uint64(CALIBRATE_ONE_IN) == 0
                block = np.column_stack((x, batch.column(2).to_numpy(), back)).astype(np.float32)
                yield pa.record_batch({"block": pa.array([block.tobytes()], pa.binary())})

    table = store.kept(
        labelled.select("doc_id", "x", "label").repartition(tasks).mapInArrow(blocks, "block binary")
    )

    def total(of: Callable) -> np.ndarray:
        def part(batches):
            sums = None
            for batch in batches:
                for block in batch.column(0):
                    rows = np.frombuffer(block.as_buffer(), dtype=np.float32).reshape(-1, width + 2)
                    more = of(rows[:, :width].astype(np.float64), rows[:, width].astype(np.float64), rows[:, -1] > 0)
                    sums = more if sums is None else sums + more
            if sums is not None:
                yield pa.record_batch({"sums": pa.array([sums.tobytes()], pa.binary())})

        # One row of fixed size for each of a bounded number of tasks.
        none = np.asarray(of(np.zeros((0, width)), np.zeros(0), np.zeros(0, bool)), dtype=np.float64)
        return sum((np.frombuffer(bytes(r[0])) for r in table.mapInArrow(part, "sums binary").collect()), none)

    return vectors, fit_sums(total, width)


def _scores(text_column: int, model):
    def rows(batches):
        vectors, net = store.received(model)
        for batch in batches:
            score = net.probabilities(pooled(batch.column(text_column), vectors))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"]
            )

    return rows


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs`` (``doc_id, text``).

    The score is the calibrated probability of label 1 from the whole text alone; 0.7 or more predicts
    1. A null text is scored as an empty one. Ids that are null or repeat have a row each; equal texts
    have equal scores. Labels other than 0 and 1, and null ones, are not learned from. Texts of any length
    are scored whole; an empty table has no rows; other columns, whatever their names, play no part.
    """
    model = store.sent(docs, train(docs, labels))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_scores(1, model), "doc_id long, text string, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be of quality 1, all columns as they are."""
    model = store.sent(docs, train(docs, labels))
    packed = docs.select(F.struct("*").alias("row"))
    at = packed.schema["row"].dataType.names.index("text")

    def rows(batches):
        vectors, net = store.received(model)
        for batch in batches:
            texts = batch.column(0).flatten()[at].cast(pa.string())
            score = net.probabilities(pooled(texts, vectors))
            yield batch.filter(pa.array(score >= 0.7))

    return packed.mapInArrow(rows, packed.schema).select("row.*")
