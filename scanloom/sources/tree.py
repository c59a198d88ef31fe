"""Source trees on a file system all executors can reach.

Spark's own file listing leaves out names that start with a dot, ``.env`` among them, so trees are
listed by a data source of their own. Listing and reading are separate steps: the listing is cut by
directory, then the files found are spread evenly before their content is read, so a directory with
very many files does not end up in one task.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scanloom import schemas
from scanloom.functions import paths

LISTING = "project_id string, root string, path string, size bigint, kind string"
FLUSH_BYTES = 32 * 1024 * 1024


class Slice(InputPartition):
    def __init__(self, project_id: str, root: str, directory: str, deep: bool):
        self.project_id = project_id
        self.root = root
        self.directory = directory
        self.deep = deep


def _skipped(relative: str) -> bool:
    name = relative.rsplit("/", 1)[-1]
    ends = (relative == d or relative.endswith("/" + d) for d in paths.SKIPPED_DIRECTORIES)
    return name.startswith(".") or any(ends)


def _scan(root: str, directory: str) -> tuple[list[os.DirEntry], list[str], bool]:
    """Entries of one directory: what is no directory, the relative names of its folders, and whether
    it could be listed."""
    here = os.path.join(root, directory) if directory else root
    other, folders = [], []
    try:
        with os.scandir(here) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                relative = f"{directory}/{e.name}" if directory else e.name
                if e.is_dir(follow_symlinks=False):
                    if not _skipped(relative):
                        folders.append(relative)
                else:
                    other.append(e)
    except OSError:
        return other, folders, False
    return other, folders, True


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options["roots"].split("\n") if r]
        self.slices = int(options.get("slices", "64"))

    def partitions(self) -> list[Slice]:
        """Open directories from the top until there are enough to share out."""
        done: list[Slice] = []
        # The whole path names a project: folders of equal names are different projects.
        todo = [(os.path.abspath(r), os.path.abspath(r), "") for r in self.roots]
        while todo and len(done) + len(todo) < self.slices:
            project, root, directory = todo.pop(0)
            done.append(Slice(project, root, directory, False))
            todo += [(project, root, d) for d in _scan(root, directory)[1]]
        return done + [Slice(p, r, d, True) for p, r, d in todo]

    def read(self, partition: Slice) -> Iterator[tuple]:
        todo = [partition.directory]
        while todo:
            directory = todo.pop()
            files, folders, listed = _scan(partition.root, directory)
            if not listed:
                yield partition.project_id, partition.root, (directory or ".") + "/", None, "unreadable"
            if partition.deep:
                todo += folders
            for e in files:
                path = f"{directory}/{e.name}" if directory else e.name
                kind = "symlink" if e.is_symlink() else "file" if e.is_file() else "other"
                try:
                    size = e.stat(follow_symlinks=False).st_size
                except OSError:
                    size = None
                yield partition.project_id, partition.root, path, size, kind


class TreeSource(DataSource):
    """``spark.read.format("source_tree").option("roots", "/a\\n/b").load()``"""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def list_tree(spark: SparkSession, roots: list[str], slices: int = 64) -> DataFrame:
    """Every name below the roots, one project per root, without the folders a scan leaves out."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("source_tree").option("roots", "\n".join(roots))
    return reader.option("slices", str(slices)).load()


def _read_one(root: str, path: str, size, kind: str, max_bytes: int | None) -> tuple:
    if kind == "unreadable":
        try:
            os.listdir(os.path.join(root, path))
        except OSError as e:
            return "read_error", str(e), None
        return "read_error", "The folder could not be listed", None
    if kind == "symlink":
        return "symlink", None, None
    if kind != "file":
        return "not_file", None, None
    if max_bytes is not None and size is not None and size > max_bytes:
        return "too_large", None, None
    try:
        with open(os.path.join(root, path), "rb") as f:
            return "ok", None, f.read().decode("utf-8", errors="replace")
    except OSError as e:
        return "read_error", str(e), None


def _read_batches(
    batches: Iterator[pd.DataFrame], max_bytes: int | None
) -> Iterator[pd.DataFrame]:
    columns = ["project_id", "path", "size", "status", "error", "content"]
    rows, held = [], 0
    for batch in batches:
        for r in batch.itertuples(index=False):
            size = None if pd.isna(r.size) else int(r.size)
            status, error, content = _read_one(r.root, r.path, size, r.kind, max_bytes)
            rows.append((r.project_id, r.path, size, status, error, content))
            held += len(content or "")
            if held > FLUSH_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def read_files(
    listing: DataFrame, tasks: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Content and status of the listed files in scope, as ``schemas.FILES``.

    Files above ``max_bytes``, if given, are too large and not read. Folders that could not be listed
    are read errors.

    Content is much larger than its listing, so on large trees the number of tasks should follow
    the size of the content; without one the session's shuffle partitions are used.
    """
    scope = paths.in_scan_scope(F.col("path")) | (F.col("kind") == "unreadable")
    wanted = listing.where(scope).select(
        "project_id", "root", "path", F.col("size"), "kind"
    )
    spread = (
        wanted.repartition(tasks, "project_id", "path")
        if tasks
        else wanted.repartition("project_id", "path")
    )
    return spread.mapInPandas(lambda batches: _read_batches(batches, max_bytes), schemas.FILES)
