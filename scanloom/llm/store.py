"""Keeping intermediate tables, and adding up tables of fixed size over all tasks."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession

from scanloom.llm.arrays import mix

def sent(df: DataFrame, model: object) -> Broadcast:
    """A model of bounded size for all tasks. It travels like the functions do, so workers that do not
    have the package installed can read it with ``received``."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))


def received(model: Broadcast):
    return cloudpickle.loads(model.value)


#: Entries of a fixed-size table that travel in one row.
SLICE = 1 << 14


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; where the session names none, one in its warehouse."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return context.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions of DataFrames made in here remove their shuffle files when they end, as their result is
    written elsewhere. Spark settles this when a DataFrame is made, not when it runs."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def kept(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read from there. It survives the loss of executors;
    Spark removes the files once nothing refers to them, if its cleaner is set to."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """The table as Parquet in the shared folder, for results that outlive the job."""
    path = f"{shared_folder(df.sparkSession)}/{label.replace(' ', '-')}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sliced(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's share of a fixed-size table as rows of slices."""
    for at in range(0, len(table), SLICE):
        part = table[at : at + SLICE]
        if part.any():
            yield pa.record_batch(
                {"slice": pa.array([at // SLICE], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())}
            )


def totals(
    df: DataFrame, share: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, kind: str, add: Callable
) -> np.ndarray:
    """The entry-wise total of the tables that ``share`` makes of each task's rows.

    ``size`` entries of ``kind`` whatever the input: the slices are added up in tasks of their own,
    one row at a time, and only the total comes to the driver.
    """

    def shares(batches):
        yield from sliced(share(batches))

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(part.as_buffer(), dtype=kind)
                sums[at] = add(sums[at], values) if at in sums else values
        for at, values in sums.items():
            yield pa.record_batch(
                {"slice": pa.array([at], pa.int32()), "part": pa.array([values.tobytes()], pa.binary())}
            )

    schema = "slice int, part binary"
    sums = df.mapInArrow(shares, schema).repartition(max(1, min(32, size // SLICE)), "slice").mapInArrow(added, schema)
    with shuffles_removed(df.sparkSession):
        rows = sums.select("*").collect()
    table = np.zeros(size, dtype=kind)
    for at, part in rows:
        values = np.frombuffer(bytes(part), dtype=kind)
        table[at * SLICE : at * SLICE + len(values)] = values
    return table


#: Bits of the filter that lets only wanted ids pass; 1 MB whatever the number of ids.
FILTER_BITS = 1 << 23
#: Tasks that fill it.
FILTER_TASKS = 8


def id_filter(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size over a column of long ids: it passes all of them, and few others
    while they are fewer than its bits. What passes is joined with the ids afterwards."""
    def share(batches):
        bits = np.zeros(FILTER_BITS, dtype=bool)
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            bits[mix(values.view(np.uint64)) % np.uint64(FILTER_BITS)] = True
        return np.packbits(bits)

    return totals(ids.repartition(FILTER_TASKS), share, FILTER_BITS // 8, "u1", np.bitwise_or)


def passes(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = mix(ids.view(np.uint64)) % np.uint64(FILTER_BITS)
    return (table[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0

