"""Documents written by many tasks that become visible all at once.

    parts.write.format("documents").option("path", folder).mode("append").save()

Rows are parts of documents in order: ``project_id, ..., text``. Every task writes what it holds as files
of its own, in a folder of the run. Only when all tasks have ended well does the run's name go into the
file ``CURRENT``, in one step; readers follow that name. A task that fails, or is run twice, leaves files
that no list names, and readers see the documents of the run before.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

CURRENT = "CURRENT"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is a local one."""
    if path.startswith("file:") and "://" not in path:
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _put(files: fs.FileSystem, path: str, text: str) -> None:
    with files.open_output_stream(path) as out:
        out.write(text.encode())


@dataclass
class Done(WriterCommitMessage):
    list_name: str
    bytes: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]) -> None:
        self.path = path
        self.run = uuid.uuid4().hex
        self.project, self.text = names.index("project_id"), names.index("text")

    def write(self, rows: Iterator) -> Done:
        """One file for each project in this task; its number gives the order of the parts."""
        files, root = _open(self.path)
        context = TaskContext.get()
        name = f"{context.partitionId():08d}-{context.taskAttemptId()}"
        folder = posixpath.join(root, "runs", self.run)
        files.create_dir(folder, recursive=True)
        written, out, last, total = [], None, None, 0
        for row in rows:
            project = row[self.project]
            if out is None or project != last:
                if out is not None:
                    out.close()
                file = f"{quote(project or '', safe='')}.{name}"
                written.append([project, file])
                out, last = files.open_output_stream(posixpath.join(folder, file)), project
            data = (row[self.text] or "").encode()
            total += len(data)
            out.write(data)
        if out is not None:
            out.close()
        _put(files, posixpath.join(folder, f"{name}.list"), "\n".join(json.dumps(w) for w in written))
        return Done(f"{name}.list", total)

    def commit(self, messages: list[Done | None]) -> None:
        """The run's lists, one name a task, then its own name in one step."""
        files, root = _open(self.path)
        names = [m.list_name for m in messages if m is not None]
        files.create_dir(posixpath.join(root, "runs", self.run), recursive=True)
        _put(files, posixpath.join(root, "runs", self.run, "LISTS"), "\n".join(sorted(names)))
        _put(files, posixpath.join(root, f".{self.run}"), self.run)
        files.move(posixpath.join(root, f".{self.run}"), posixpath.join(root, CURRENT))

    def abort(self, messages: list[Done | None]) -> None:
        """Nothing was visible; what the tasks wrote goes."""
        files, root = _open(self.path)
        folder = posixpath.join(root, "runs", self.run)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], schema.names)


def write_documents_at_once(parts: DataFrame, folder: str) -> None:
    """Write documents from their parts ``project_id, <places>, text``; see the module.

    Parts are spread by ranges of their places, so a very long document is many tasks' work.
    """
    spark = parts.sparkSession
    spark.dataSource.register(DocumentSink)
    order = ["project_id", *[c for c in parts.columns if c not in ("project_id", "text")]]
    dealt = parts.repartitionByRange(*order).sortWithinPartitions(*order).select("project_id", "text")
    dealt.write.format("documents").option("path", folder).mode("append").save()


def current_run(folder: str) -> str | None:
    """The name of the run that readers see."""
    files, root = _open(folder)
    path = posixpath.join(root, CURRENT)
    if files.get_file_info(path).type != fs.FileType.File:
        return None
    with files.open_input_stream(path) as f:
        return f.read().decode()


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """``project_id, part, file``: the files that make up each visible document, in the order of ``part``."""
    run = current_run(folder)
    if run is None:
        return spark.createDataFrame([], "project_id string, part string, file string")
    files, root = _open(folder)
    with files.open_input_stream(posixpath.join(root, "runs", run, "LISTS")) as f:
        lists = [x for x in f.read().decode().split("\n") if x]

    def rows(batches):
        files, root = _open(folder)
        for batch in batches:
            for name in batch["list"]:
                path = posixpath.join(root, "runs", run, name)
                with files.open_input_stream(path) as f:
                    found = [json.loads(x) for x in f.read().decode().split("\n") if x]
                if found:
                    frame = type(batch)(found, columns=["project_id", "file"])
                    frame["part"] = name.removesuffix(".list")
                    frame["file"] = [posixpath.join(root, "runs", run, x) for x in frame["file"]]
                    yield frame[["project_id", "part", "file"]]

    names = spark.createDataFrame([(x,) for x in lists], "list string")
    return names.mapInPandas(rows, "project_id string, part string, file string")


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """``project_id, part, text``: the visible documents, a row for each file."""

    def rows(batches):
        files, _ = _open(folder)
        for batch in batches:
            for k in range(len(batch)):
                one = batch.iloc[[k]].copy()
                with files.open_input_stream(one["file"].iloc[0]) as f:
                    one["text"] = [f.read().decode()]
                yield one[["project_id", "part", "text"]]

    return document_files(spark, folder).mapInPandas(rows, "project_id string, part string, text string")
