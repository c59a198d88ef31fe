"""Operators over hits and findings: cap, order, count, score, pick."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions import text
from scanloom.operators.numbering import number_rows
from scanloom.operators.rulebook import Rulebook
from scanloom.plans.storage import settle

_FILE = ("project_id", "path")
_IN_FILE = ("rule_ordinal", "ord", "sub", "code")
ORDER = ("severity_rank", "path", "rule_ordinal", "seq")


def cap_per_file(hits: DataFrame, cap: int | None) -> DataFrame:
    """The first ``cap`` hits of each file in rule order; all of them without a cap.

    The limit is applied on the map side first, so a file with very many hits ships at most
    ``cap`` rows per task.
    """
    if cap is None:
        return hits
    w = Window.partitionBy(*_FILE).orderBy(*_IN_FILE)
    return hits.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= cap).drop(
        "_place"
    )


def to_findings(hits: DataFrame, book: Rulebook | None = None) -> DataFrame:
    """Hits as findings: rule facts and messages are filled in after the cap, not shuffled."""
    book = book or Rulebook()
    w = Window.partitionBy(*_FILE, "rule_ordinal").orderBy("ord", "sub", "code")
    return (
        book.described(hits.withColumn("seq", F.row_number().over(w) - 1))
        .select(
            "project_id",
            "path",
            "line",
            F.col("facts.severity").alias("severity"),
            text.fill_template(F.col("facts.template"), F.coalesce("detail", F.lit(""))).alias(
                "message"
            ),
            F.col("facts.rule_id").alias("rule_id"),
            F.col("facts.category").alias("category"),
            "rule_ordinal",
            "seq",
        )
    )


def fill_defaults(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of a pluggable rule with empty severity, rule id or category take the rule's.

    ``findings`` carries ``rule_ordinal``; ``rules`` is a rule table.
    """
    facts = rules.select(
        "rule_ordinal",
        F.col("rule_id").alias("_rule_id"),
        F.col("severity").alias("_severity"),
        F.col("category").alias("_category"),
    )
    joined = findings.join(facts, "rule_ordinal", "left")
    for name in ("severity", "rule_id", "category"):
        joined = joined.withColumn(
            name, F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(f"_{name}"))
        )
    return joined.drop("_rule_id", "_severity", "_category")


# --- counting ------------------------------------------------------------------------------------


def risk_score(critical: Column, medium: Column, low: Column) -> Column:
    w = schemas.SEVERITY_WEIGHTS
    lost = critical * w["critical"] + medium * w["medium"] + low * w["low"]
    return F.greatest(F.lit(0), 100 - lost)


def with_score(counts: DataFrame, threshold: int = schemas.DEFAULT_THRESHOLD) -> DataFrame:
    """Add score, threshold and gate to rows with the three severity counts."""
    return (
        counts.withColumn("score", risk_score(F.col("critical"), F.col("medium"), F.col("low")))
        .withColumn("threshold", F.lit(threshold))
        .withColumn("passed", F.col("score") >= F.col("threshold"))
    )


def severity_counts(projects: DataFrame, severities: DataFrame) -> DataFrame:
    """Findings per project and severity; projects without findings count zero.

    ``severities(project_id, severity)`` needs no other finding column. Projects and findings are
    added up in one aggregation, so no join is needed and hot projects shrink before the shuffle.
    """
    group = schemas.severity_group(F.col("severity"))
    found = severities.select(
        "project_id", *[(group == s).cast("bigint").alias(s) for s in schemas.SEVERITIES]
    )
    none = projects.select("project_id", *[F.lit(0).cast("bigint").alias(s) for s in schemas.SEVERITIES])
    return (
        none.unionByName(found)
        .groupBy("project_id")
        .agg(*[F.sum(s).alias(s) for s in schemas.SEVERITIES])
        .withColumn("total", F.col("critical") + F.col("medium") + F.col("low"))
    )


def scan_metadata(files: DataFrame, errors: DataFrame, rules_loaded: int) -> DataFrame:
    """Files scanned, skipped and error rows per project. Reads statuses, never content."""
    read = files.select(
        "project_id",
        (F.col("status") == "ok").cast("bigint").alias("files_scanned"),
        (F.col("status") != "ok").cast("bigint").alias("files_skipped"),
        F.lit(0).cast("bigint").alias("files_with_errors"),
    )
    failed = errors.select(
        "project_id",
        F.lit(0).cast("bigint").alias("files_scanned"),
        F.lit(0).cast("bigint").alias("files_skipped"),
        F.lit(1).cast("bigint").alias("files_with_errors"),
    )
    return (
        read.unionByName(failed)
        .groupBy("project_id")
        .agg(
            F.sum("files_scanned").alias("files_scanned"),
            F.sum("files_skipped").alias("files_skipped"),
            F.sum("files_with_errors").alias("files_with_errors"),
        )
        .withColumn("rules_loaded", F.lit(rules_loaded))
    )


# --- ordering and picking ------------------------------------------------------------------------


def ranked(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity_rank", schemas.severity_rank(F.col("severity")))


def in_report_order(findings: DataFrame) -> DataFrame:
    """Add ``finding_index``, 0-based: critical, medium, low, then path, rule and position."""
    return number_rows(ranked(findings), ["project_id"], ORDER, "finding_index")


def review_batches(indexed: DataFrame, size: int = schemas.REVIEW_BATCH) -> DataFrame:
    return indexed.withColumn("batch", F.floor(F.col("finding_index") / size))


def top_risks(findings: DataFrame, k: int = schemas.TOP_RISKS) -> DataFrame:
    """The first k critical and medium findings of each project."""
    w = Window.partitionBy("project_id").orderBy(*ORDER)
    return (
        ranked(findings)
        .where(F.col("severity").isin("critical", "medium"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def report_positions(
    findings: DataFrame, severities: Sequence[str] = schemas.SEVERITIES, collation: str | None = None
) -> DataFrame:
    """Places of the visible findings when a report is sorted by severity, file or rule.

    Each sort is stable over the report order. The three are numbered side by side, two of them on
    what identifies a finding and its sort key alone, and joined. File and rule names are compared
    by their bytes, or in the order of a ``collation`` such as ``UNICODE``, as readers expect names to
    be sorted; names it holds equal are then compared by their bytes.
    """
    visible = ranked(findings).where(F.col("severity").isin(*severities))
    identity = ["project_id", "path", "rule_ordinal", "seq"]
    key = [*identity, "severity_rank", "rule_id"]
    by_file = ["path", "severity_rank", "rule_ordinal", "seq"]
    by_rule = ["rule_id", *ORDER]
    if collation is not None:
        names = {f"{c}_in_order": F.collate(F.col(c), collation) for c in ("path", "rule_id")}
        visible = visible.withColumns(names)
        key += list(names)
        by_file, by_rule = ["path_in_order", *by_file], ["rule_id_in_order", *by_rule]
    visible = settle(visible)
    placed = number_rows(visible, ["project_id"], ORDER, "by_severity")
    for order, name in ((by_file, "by_file"), (by_rule, "by_rule")):
        places = number_rows(visible.select(*key), ["project_id"], order, name)
        placed = placed.join(places.select(*identity, name), identity)
    return placed.select(*findings.columns, "severity_rank", "by_severity", "by_file", "by_rule")
