"""The scan: files in, findings and scores out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions import paths, text
from scanloom.operators import catalog, detect, findings
from scanloom.operators.rulebook import Rulebook
from scanloom.operators.ruletable import rules_by_path


def scannable(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files a scan reads: names in scope, read without trouble, and not above a limit if one is given.

    ``schemas.MAX_FILE_BYTES`` is the usual limit; without one every file is scanned whole.
    """
    kept = files.where(paths.in_scan_scope(F.col("path")))
    if "status" in files.columns:
        kept = kept.where(F.col("status") == "ok")
    if max_bytes is not None and "size" in files.columns:
        kept = kept.where(F.col("size").isNull() | (F.col("size") <= max_bytes))
    return kept


def read_outcomes(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files in scope with their status; files above the limit, if one is given, are too large."""
    status = F.col("status") if "status" in files.columns else F.lit("ok")
    size = F.col("size") if "size" in files.columns else F.lit(0)
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    # A folder that could not be listed is no file in scope, but an error all the same.
    folder = F.endswith("path", F.lit("/")) & (status == "read_error")
    return files.where(paths.in_scan_scope(F.col("path")) | folder).select(
        "project_id",
        "path",
        (
            status
            if max_bytes is None
            else F.when((status == "ok") & (size > max_bytes), "too_large").otherwise(status)
        )
        .alias("status"),
        error.alias("error"),
    )


def hits(
    files: DataFrame,
    listing: DataFrame | None = None,
    book: Rulebook | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Hits of a whole scan, at most ``cap`` per file if one is given."""
    listing = files.select("project_id", "path") if listing is None else listing
    return findings.cap_per_file(detect.detect(scannable(files), listing, book), cap)


def scan(
    files: DataFrame,
    listing: DataFrame | None = None,
    book: Rulebook | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Findings of a whole scan; all of them, unless ``cap`` limits them per file.

    ``schemas.MAX_FINDINGS_PER_FILE`` is the usual limit of a report.
    """
    return findings.to_findings(hits(files, listing, book, cap), book)


def analyze(
    files: DataFrame,
    rule_ids: Sequence[str] | Column | None = None,
    listing: DataFrame | None = None,
    book: Rulebook | None = None,
) -> DataFrame:
    """Findings of selected rules on the files given, whatever their names; no cap."""
    return findings.to_findings(detect.detect(files, listing, book, rule_ids), book)


def rules_applied(
    files: DataFrame, book: Rulebook | None = None, rule_ids: Sequence[str] | Column | None = None
) -> DataFrame:
    """The ids of the rules that apply to each file, in rule order."""
    book = book or Rulebook()
    rules = book.only(rule_ids)
    planned = F.array_compact(
        F.array(
            *[
                F.when(paths.applies_to(F.col("path"), r.applicable_to), r.rule_id)
                for r in rules
            ]
        )
    )
    custom = book.custom_only(rule_ids)
    if custom is None:
        return files.select("project_id", "path", planned.alias("rules_applied"))
    pairs = rules_by_path(files.select("project_id", "path").distinct(), custom)
    each = pairs.join(book.numbers, "rule_id")
    listed = F.array_sort(F.collect_list(F.struct("rule_ordinal", "rule_id")))
    each = each.groupBy(F.col("project_id").alias("_project"), F.col("path").alias("_path")).agg(listed.alias("_rules"))
    same = F.col("project_id").eqNullSafe(F.col("_project")) & F.col("path").eqNullSafe(F.col("_path"))
    more = F.coalesce(F.transform("_rules", lambda r: r["rule_id"]), F.array().cast("array<string>"))
    return files.join(each, same, "left").select(
        "project_id", "path", F.concat(planned.cast("array<string>"), more).alias("rules_applied")
    )


def rule_errors(files: DataFrame) -> DataFrame:
    """Rule failures as rows. Built-in rules fail on one input only: a manifest that is ``null``."""
    broken = paths.applies_to(F.col("path"), catalog.DEPENDENCY.applicable_to) & (
        text.trim_ws(F.col("content")) == "null"
    )
    return (
        scannable(files)
        .where(broken)
        .select(
            "project_id",
            "path",
            F.lit(f"Rule {catalog.DEPENDENCY.rule_id} failed: manifest is null").alias("error"),
        )
    )


def scan_errors(files: DataFrame) -> DataFrame:
    """Read errors and rule failures; other reasons to skip a file are no errors."""
    unread = read_outcomes(files).where(F.col("status") == "read_error")
    return unread.select(
        "project_id", "path", F.coalesce("error", F.lit("Unknown error")).alias("error")
    ).unionByName(rule_errors(files))


def projects(files: DataFrame) -> DataFrame:
    """One row per file with its project, for counts that must include clean projects."""
    return files.select("project_id")


def project_scores(
    files: DataFrame,
    listing: DataFrame | None = None,
    book: Rulebook | None = None,
    threshold: int = schemas.DEFAULT_THRESHOLD,
    cap: int | None = None,
) -> DataFrame:
    """Counts, score and gate per project. Only project and pattern code leave the scan."""
    book = book or Rulebook()
    found = book.described(hits(files, listing, book, cap)).select(
        "project_id", F.col("facts.severity").alias("severity")
    )
    counts = findings.severity_counts(projects(files), found)
    return findings.with_score(counts, threshold)
