"""Scan history: append, latest fresh scan, last ten; and both kept up to date scan by scan."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom import schemas


def history_entries(scans: DataFrame) -> DataFrame:
    """Scans as history rows; a scan without a file count has 0."""
    return scans.select(
        "project_id",
        "ts",
        F.col("score").cast("int").alias("score"),
        F.struct(*[F.col(s).cast("int").alias(s) for s in schemas.SEVERITIES]).alias("summary"),
        F.coalesce(F.col("files_scanned").cast("int"), F.lit(0)).alias("files_scanned"),
    )


def append_history(scans: DataFrame, path: str) -> None:
    """Add one entry per scan to the history table."""
    history_entries(scans).write.mode("append").parquet(path)


def read_history(spark, path: str) -> DataFrame:
    return spark.read.schema(schemas.HISTORY).parquet(path)


def is_stale(ts: Column, as_of: Column, minutes: int = schemas.FRESH_MINUTES) -> Column:
    """Never scanned, or scanned more than half an hour ago."""
    return ts.isNull() | (as_of - ts > F.make_dt_interval(mins=F.lit(minutes)))


def latest_fresh(
    projects: DataFrame, history: DataFrame, as_of: Column, minutes: int = schemas.FRESH_MINUTES
) -> DataFrame:
    """The newest entry of each project, all null where it is stale or missing.

    An aggregate, so entries of one project are combined before the shuffle.
    """
    entry = F.struct("ts", "score", "summary", "files_scanned")
    empty = projects.select("project_id", F.lit(None).alias("ts"), F.lit(None).alias("entry"))
    seen = history.select("project_id", "ts", entry.alias("entry"))
    newest = (
        seen.unionByName(empty.select("project_id", *[_typed(seen, c) for c in ("ts", "entry")]))
        .groupBy("project_id")
        .agg(F.max_by("entry", "ts").alias("entry"))
    )
    fresh = F.when(~is_stale(F.col("entry.ts"), as_of, minutes), F.col("entry"))
    return newest.select("project_id", fresh.alias("entry")).select("project_id", "entry.*")


def _typed(like: DataFrame, name: str) -> Column:
    return F.lit(None).cast(like.schema[name].dataType).alias(name)


def last_scans(history: DataFrame, k: int = schemas.HISTORY_LENGTH) -> DataFrame:
    """The last k scans of each project, newest first; only k rows per task reach the shuffle."""
    w = Window.partitionBy("project_id").orderBy(F.col("ts").desc())
    return history.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


# --- scan by scan --------------------------------------------------------------------------------

_ENTRY = "struct<ts:timestamp,scan_id:string,score:int,summary:struct<critical:int,medium:int,low:int>,files_scanned:int>"
NEWEST = f"project_id string, entries array<{_ENTRY}>"


def append_scan(scans: DataFrame, path: str, scan_id: str) -> None:
    """Add the entries of one scan to the history table, once however often it is called.

    A scan's entries are a folder of their own, named by its id and replaced as a whole, so a job that
    is repeated after a failure leaves the table as one run does.
    """
    folder = f"{path}/scan_id={quote(scan_id, safe='')}"
    history_entries(scans).write.mode("overwrite").parquet(folder)


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """The history table of ``append_scan``, with ``scan_id``."""
    return spark.read.schema(f"{schemas.HISTORY}, scan_id string").parquet(path)


def newest_entries(history: DataFrame, k: int = schemas.HISTORY_LENGTH) -> DataFrame:
    """``project_id, entries``: the k newest entries of each project, newest first.

    ``history`` has ``scan_id``; entries of one moment are ordered by it. Each task hands on k rows of a
    project at most.
    """
    w = Window.partitionBy("project_id").orderBy(F.col("ts").desc(), F.col("scan_id").desc())
    entry = F.struct("ts", "scan_id", "score", "summary", "files_scanned").cast(_ENTRY)
    few = history.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    entries = F.sort_array(F.collect_list(entry), asc=False)
    return few.groupBy("project_id").agg(entries.alias("entries"))


def merge_newest(state: DataFrame, more: DataFrame, k: int = schemas.HISTORY_LENGTH) -> DataFrame:
    """Two tables of newest entries as one. It does not matter in which order tables are merged, nor how
    often one is, as entries are told apart by time and scan."""
    both = state.unionByName(more).groupBy("project_id").agg(F.collect_list("entries").alias("lists"))
    together = F.sort_array(F.array_distinct(F.flatten("lists")), asc=False)
    return both.select("project_id", F.slice(together, 1, k).alias("entries"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a state table, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(hadoop.Path(f"{path}/version=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The state table that ``update_newest`` keeps, as its last finished version has it."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], NEWEST)
    return spark.read.schema(NEWEST).parquet(f"{path}/version={versions[-1]}")


def update_newest(
    scans: DataFrame, path: str, scan_id: str, version: int, k: int = schemas.HISTORY_LENGTH
) -> None:
    """Take the entries of one more scan into the state table, as its next ``version``.

    Reads the state, of k entries a project, and the scan, never the history. A version that is there
    already is not written again. A version counts when it is finished; the one before stays as it is.
    """
    spark = scans.sparkSession
    done = _versions(spark, path)
    if done and done[-1] >= version:
        return
    more = newest_entries(history_entries(scans).withColumn("scan_id", F.lit(scan_id)), k)
    merged = merge_newest(read_newest(spark, path), more, k)
    merged.write.mode("overwrite").parquet(f"{path}/version={version}")


def newest_rows(newest: DataFrame) -> DataFrame:
    """The state as rows ``project_id, place, ts, scan_id, score, summary, files_scanned``, as ``last_scans`` has them."""
    rows = newest.select("project_id", F.posexplode("entries").alias("at", "entry"))
    return rows.select("project_id", (F.col("at") + 1).alias("place"), "entry.*")
