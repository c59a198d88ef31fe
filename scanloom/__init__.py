"""Source-risk analytics on Spark: files in, findings, scores, reports, fixes and reviews out.

    from scanloom import read_tree, scan, project_scores
    files, listing = read_tree(spark, ["/projects/a", "/projects/b"])
    findings = scan(files, listing)
"""

from pyspark.sql import DataFrame, SparkSession

from scanloom.operators.findings import (
    cap_per_file,
    in_report_order,
    report_positions,
    risk_score,
    severity_counts,
    top_risks,
    with_score,
)
from scanloom.operators.fixes import fixed_files, patch_bundle, patch_lines, suggestions
from scanloom.operators.history import append_scan, newest_rows, read_newest, update_newest
from scanloom.operators.linestate import strip_by_line
from scanloom.operators.pluggable import PythonRule, python_rule, python_rules
from scanloom.operators.reports import (
    html_payload,
    json_report,
    risk_detail,
    risk_summary,
    sarif_report,
    write_documents,
)
from scanloom.operators.rulebook import (
    Rulebook,
    admit_rules,
    compile_rules,
    custom_rule,
    dropped_patterns,
    list_rules,
    merge_rules,
    refused_patterns,
)
from scanloom.operators.ruletable import rules_by_path
from scanloom.operators.textdiff import diff_files, patched, text_hunks
from scanloom.plans.scan import analyze, project_scores, scan, scan_errors
from scanloom.plans.storage import release, settle, settled
from scanloom.sources.documentsink import read_parts, write_documents_at_once
from scanloom.sources.rulefiles import load_rule_files, parse_rule_files
from scanloom.sources.store import list_store, read_store
from scanloom.sources.tree import list_tree, read_files
from scanloom.streaming.tracked import missing_examples, stream_scores, track_stream
from scanloom.streaming.watch import scan_stream


def read_tree(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files of source trees with content and status, and the names of all files below them.

    Roots are local folders, or URIs of any store that Arrow's file systems reach.
    """
    if any("://" in root for root in roots):
        listing = list_store(spark, roots)
        return read_store(listing), listing.select("project_id", "path")
    listing = list_tree(spark, roots)
    return read_files(listing), listing.select("project_id", "path")


def load_rules(
    spark: SparkSession, default_file: str | None = None, directory: str | None = None
) -> Rulebook:
    """The built-in rules and, if files are named, the custom rules they hold."""
    if default_file is None and directory is None:
        return Rulebook()
    admitted, _ = admit_rules(load_rule_files(spark, default_file or "", directory))
    return Rulebook().with_custom(compile_rules(admitted))


__all__ = [
    "PythonRule",
    "Rulebook",
    "admit_rules",
    "analyze",
    "append_scan",
    "cap_per_file",
    "compile_rules",
    "custom_rule",
    "diff_files",
    "dropped_patterns",
    "fixed_files",
    "html_payload",
    "in_report_order",
    "json_report",
    "list_rules",
    "list_store",
    "list_tree",
    "load_rule_files",
    "load_rules",
    "merge_rules",
    "missing_examples",
    "newest_rows",
    "parse_rule_files",
    "patch_bundle",
    "patch_lines",
    "patched",
    "project_scores",
    "python_rule",
    "python_rules",
    "read_files",
    "read_newest",
    "read_parts",
    "read_store",
    "read_tree",
    "refused_patterns",
    "release",
    "report_positions",
    "risk_detail",
    "risk_score",
    "risk_summary",
    "rules_by_path",
    "sarif_report",
    "scan",
    "scan_errors",
    "scan_stream",
    "settle",
    "settled",
    "severity_counts",
    "stream_scores",
    "strip_by_line",
    "suggestions",
    "text_hunks",
    "top_risks",
    "track_stream",
    "update_newest",
    "with_score",
    "write_documents",
    "write_documents_at_once",
]
