"""Source trees in any store that Arrow's file systems reach: local folders, HDFS, object stores.

A tree is listed level by level: all folders of a level are one table, its tasks list them, and the
folders found are the next level. Nothing is listed by the driver, and a folder is one row of work. The
files are then dealt to tasks by their bytes, so that every task reads about as much.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions import paths
from scanloom.plans.storage import settle
from scanloom.sources.tree import FLUSH_BYTES, LISTING, _skipped

#: Bytes of content that a task reads.
TASK_BYTES = 128 * 1024 * 1024
#: What a file costs besides its bytes, as bytes.
FILE_BYTES = 64 * 1024


def _uri(root: str) -> str:
    """A root as it is named: URIs as they are, local paths whole."""
    if root.startswith("file:") and "://" not in root:
        return f"file://{root.removeprefix('file:')}"
    return root if "://" in root else os.path.abspath(root)


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def _kind(files: fs.FileSystem, info: fs.FileInfo) -> str:
    if isinstance(files, fs.LocalFileSystem) and os.path.islink(info.path):
        return "symlink"
    return {fs.FileType.File: "file", fs.FileType.Directory: "folder"}.get(info.type, "other")


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names in each folder, without the folders that a scan leaves out."""
    columns = ["project_id", "root", "path", "size", "kind"]
    opened: dict[str, tuple[fs.FileSystem, str]] = {}
    for batch in batches:
        rows = []
        for project, root, folder in batch.itertuples(index=False):
            if root not in opened:
                opened[root] = _open(root)
            files, base = opened[root]
            here = posixpath.join(base, folder) if folder else base
            try:
                found = files.get_file_info(fs.FileSelector(here))
            except (OSError, ValueError):
                rows.append((project, root, (folder or ".") + "/", None, "unreadable"))
                continue
            for info in found:
                path = f"{folder}/{info.base_name}" if folder else info.base_name
                kind = _kind(files, info)
                if kind != "folder":
                    size = os.lstat(info.path).st_size if kind == "symlink" else info.size
                    rows.append((project, root, path, size, kind))
                elif not _skipped(path):
                    rows.append((project, root, path, None, kind))
        frame = pd.DataFrame(rows, columns=columns)
        frame["size"] = frame["size"].astype("Int64")
        yield frame


def _write(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    files, base = _open(root)
    name = f"part-{TaskContext.get().partitionId():05d}.txt"
    out, last, written = None, None, 0
    for batch in batches:
        for folder, line in batch.itertuples(index=False):
            if out is None or folder != last:
                if out is not None:
                    out.close()
                here = posixpath.join(base, folder)
                files.create_dir(here, recursive=True)
                out, last, written = files.open_output_stream(posixpath.join(here, name)), folder, written + 1
            out.write(((line or "") + "\n").encode())
    if out is not None:
        out.close()
    yield pd.DataFrame({"files": [written]})


def write_store(texts: DataFrame, root: str) -> int:
    """Write ``folder, text`` as a tree: one file in each folder below ``root``, each text and a line end.

    The rows of a folder come to one task, ordered; a task that runs again writes its files again. No
    folder is written twice or moved. Returns the number of files.
    """
    root = _uri(root)
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select("folder", "text").repartition(partitions, "folder").sortWithinPartitions("folder", "text")
    return dealt.mapInPandas(lambda batches: _write(batches, root), "files long").agg(F.sum("files")).first()[0]


def list_store(spark: SparkSession, roots: list[str], tasks: int | None = None) -> DataFrame:
    """Every name below the roots, as ``tree.list_tree`` has them; roots are paths or URIs.

    There are as many rounds as the tree is deep; only whether there are further folders comes to the
    driver.
    """
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [(_uri(r), _uri(r), "") for r in roots]
    level = spark.createDataFrame(named, "project_id string, root string, path string")
    listing = None
    while True:
        dealt = level.repartition(tasks, "root", "path")
        found = settle(dealt.mapInPandas(_list_folders, LISTING))
        names = found.where(F.col("kind") != "folder")
        listing = names if listing is None else listing.unionByName(names)
        level = found.where(F.col("kind") == "folder").select("project_id", "root", "path")
        if level.isEmpty():
            return listing


def by_bytes(listing: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The files of a listing with ``task``, a number that files of about ``task_bytes`` together share.

    Bytes are added up along the names, within ranges first and then over the ranges, so that no task
    sees all files. A file that is larger has a number of its own.
    """
    cost = F.coalesce("size", F.lit(0)) + FILE_BYTES
    ranged = listing.repartitionByRange("project_id", "path").sortWithinPartitions("project_id", "path")
    at = F.monotonically_increasing_id()
    ranged = settle(ranged.withColumns({"at": at, "cost": cost})).withColumn("range", F.shiftright("at", 33))
    running = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range").agg(F.sum("cost").alias("sum"))
    # A row for each range.
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("cost").over(running), F.lit(0))
    placed = ranged.withColumn("within", within).join(starts, "range")
    task = F.floor((F.col("start") + F.col("within")) / task_bytes)
    return placed.select(*listing.columns, task.alias("task"))


def _read(batches: Iterator[pd.DataFrame], max_bytes: int | None) -> Iterator[pd.DataFrame]:
    columns = ["project_id", "path", "size", "status", "error", "content"]
    opened: dict[str, tuple[fs.FileSystem, str]] = {}
    rows, held = [], 0

    def flush() -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=columns)
        frame["size"] = frame["size"].astype("Int64")
        return frame

    for batch in batches:
        for project, root, path, size, kind in batch.itertuples(index=False):
            if root not in opened:
                opened[root] = _open(root)
            files, base = opened[root]
            size = None if pd.isna(size) else int(size)
            status, error, content = kind, None, None
            if kind == "unreadable":
                status, error = "read_error", "The folder could not be listed"
            elif kind not in ("file", "symlink"):
                status = "not_file"
            elif kind == "file" and max_bytes is not None and size is not None and size > max_bytes:
                status = "too_large"
            elif kind == "file":
                try:
                    with files.open_input_stream(posixpath.join(base, path)) as f:
                        status, content = "ok", f.read().decode("utf-8", errors="replace")
                except OSError as e:
                    status, error = "read_error", str(e)
            rows.append((project, path, size, status, error, content))
            held += len(content or "")
            if held > FLUSH_BYTES:
                yield flush()
                rows, held = [], 0
    if rows:
        yield flush()


def read_store(listing: DataFrame, max_bytes: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Content and status of the listed files in scope, as ``schemas.FILES`` and ``tree.read_files`` have them."""
    scope = paths.in_scan_scope(F.col("path")) | (F.col("kind") == "unreadable")
    return read_dealt(by_bytes(listing.where(scope), task_bytes), max_bytes)


def read_dealt(dealt: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The same for files that ``by_bytes`` has dealt to tasks, whatever their names."""
    tasks = (dealt.agg(F.max("task")).first()[0] or 0) + 1
    spread = dealt.repartitionByRange(int(tasks), "task").select("project_id", "root", "path", "size", "kind")
    return spread.mapInPandas(lambda batches: _read(batches, max_bytes), schemas.FILES)
