"""Tables that several later steps read, and places for sinks."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder all executors reach: the session's ``spark.checkpoint.dir``, else its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/scanloom/{app}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


#: Bytes of rows that a task holds before it writes them to its file.
ROW_GROUP = 1 << 24


def written(df: DataFrame, label: str) -> DataFrame:
    """A wide table of any size as files in the shared folder, of which steps read the fields they need.

    It runs at once, and takes no memory afterwards.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables kept by ``settle``, by session.
_kept: dict[int, list[DataFrame]] = {}


def settle(df: DataFrame) -> DataFrame:
    """Keep a table that several steps read, so that they do not scan the sources again.

    Nothing runs until an action needs it. The lineage stays, so what a lost executor held is
    computed anew. ``settled`` or ``release`` gives the room back when results are written.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.setdefault(id(df.sparkSession._jsparkSession), []).append(kept)
    return kept


def release(spark: SparkSession, since: int = 0) -> None:
    """Drop the tables kept so far, or those kept after the first ``since``."""
    tables = _kept.get(id(spark._jsparkSession), [])
    while len(tables) > since:
        tables.pop().unpersist()


@contextlib.contextmanager
def settled(spark: SparkSession) -> Iterator[None]:
    """What is kept inside is dropped at the end; results must be written or collected by then."""
    before = len(_kept.get(id(spark._jsparkSession), []))
    try:
        yield
    finally:
        release(spark, before)
