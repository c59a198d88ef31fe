"""Scans of streams whose results change with what arrives later.

Two things about a stream of files are state. Whether an environment file lacks its example depends on a
name that may come later: the state of a folder takes such a finding back. And the counts behind a
project's score grow with every batch: the state of a project adds them up. Both tables are written by
batch, and a batch that is repeated after a failure replaces its own rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanloom import schemas
from scanloom.functions import paths
from scanloom.operators import catalog, detect, findings
from scanloom.operators.rulebook import PLANNED_RULES, Rulebook
from scanloom.plans.scan import scannable

_EXAMPLE = ".env.example"
CHANGES = "project_id string, folder string, path string, change int"
COUNTS = "project_id string, severity string, total bigint"


def _track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One folder: findings that its new environment files make, or that its example takes back."""
    known, example = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], False)
    seen, fresh, arrived = set(known), [], False
    for batch in batches:
        for path in batch["path"]:
            if path.rsplit("/", 1)[-1] == _EXAMPLE:
                arrived = True
            elif path not in seen:
                seen.add(path)
                fresh.append(path)
    rows = []
    if arrived and not example:
        rows = [(path, -1) for path in known]
    elif not arrived and not example:
        rows = [(path, 1) for path in fresh]
    state.update((json.dumps(sorted(seen)), example or arrived))
    if rows:
        yield pd.DataFrame(
            [(*key, path, change) for path, change in rows], columns=["project_id", "folder", "path", "change"]
        )


def env_changes(names: DataFrame) -> DataFrame:
    """A stream of names ``project_id, path`` as changes of the findings about missing examples.

    ``change`` is 1 where a file turns out to lack its example, and -1 when the example arrives after
    all. Names that come again change nothing. A folder's state holds its environment files.
    """
    path = F.col("path")
    scanned = paths.in_scan_scope(path) & paths.applies_to(path, catalog.ENV.applicable_to)
    wanted = (paths.basename(path) == _EXAMPLE) | scanned
    keyed = names.where(wanted).select("project_id", paths.dirname(path).alias("folder"), "path")
    return keyed.groupBy("project_id", "folder").applyInPandasWithState(
        _track, CHANGES, "known string, example boolean", "append", GroupStateTimeout.NoTimeout
    )


def content_counts(files: DataFrame, book: Rulebook | None = None) -> DataFrame:
    """A stream of files ``project_id, path, content`` as findings per project and severity so far."""
    book = book or Rulebook()
    if book.custom is not None or len(book.rules) > PLANNED_RULES + len(catalog.BUILT_IN_RULES):
        raise ValueError(f"a stream takes up to {PLANNED_RULES} custom rules")
    rules = [r.rule_id for r in book.rules if r.rule_id != catalog.ENV.rule_id]
    hits = detect.detect(scannable(files), None, book, rules)
    severity = schemas.severity_group(book.describe(F.col("code"))["severity"])
    # Every file counts for its project, so that projects without findings have a row.
    return (
        files.select("project_id", F.lit("files").alias("severity"))
        .unionByName(hits.select("project_id", severity.alias("severity")))
        .groupBy("project_id", "severity")
        .agg(F.count(F.lit(1)).alias("total"))
    )


def _by_batch(stream: DataFrame, mode: str, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(one_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def track_stream(
    files: DataFrame, folder: str, book: Rulebook | None = None, **trigger
) -> tuple[StreamingQuery, StreamingQuery]:
    """Keep counts and missing examples of a stream of files below ``folder``.

    Names of files without content, such as examples, may come with a null content; they count as
    names only.
    """
    known = files.where(F.col("content").isNotNull())
    counts = _by_batch(content_counts(known, book), "update", f"{folder}/counts", f"{folder}/progress-counts", trigger)
    changes = _by_batch(env_changes(files), "append", f"{folder}/changes", f"{folder}/progress-changes", trigger)
    return counts, changes


def missing_examples(spark: SparkSession, folder: str) -> DataFrame:
    """``project_id, path``: environment files that lack their example as of now."""
    changes = spark.read.schema(f"{CHANGES}, batch bigint").parquet(f"{folder}/changes")
    now = changes.groupBy("project_id", "path").agg(F.sum("change").alias("open"))
    return now.where(F.col("open") > 0).select("project_id", "path")


def stream_scores(spark: SparkSession, folder: str, threshold: int = schemas.DEFAULT_THRESHOLD) -> DataFrame:
    """Counts, score and gate of every project as of now, as ``project_scores`` of a whole scan has them."""
    written = spark.read.schema(f"{COUNTS}, batch bigint").parquet(f"{folder}/counts")
    last = written.groupBy("project_id", "severity").agg(F.max_by("total", "batch").alias("total"))
    env = missing_examples(spark, folder).select(
        "project_id", F.lit(catalog.ENV.severity).alias("severity"), F.lit(1).cast("bigint").alias("total")
    )
    each = [F.sum(F.when(F.col("severity") == s, F.col("total")).otherwise(0)).alias(s) for s in schemas.SEVERITIES]
    counts = last.unionByName(env).groupBy("project_id").agg(*each)
    counts = counts.withColumn("total", F.col("critical") + F.col("medium") + F.col("low"))
    return findings.with_score(counts, threshold)
