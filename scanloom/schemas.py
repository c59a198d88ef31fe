"""Row shapes shared by all operators, and the few constants that define the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "project_id string, path string, size bigint, status string, error string, content string"
FINDINGS = (
    "project_id string, path string, line int, severity string, message string, "
    "rule_id string, category string, rule_ordinal int, seq int"
)
SCAN_ERRORS = "project_id string, path string, error string"
RULES = (
    "load_order int, rule_id string, name string, description string, category string, "
    "severity string, applicable_to array<string>, "
    "patterns array<struct<regex:string,flags:string,message:string>>"
)
HISTORY = (
    "project_id string, ts timestamp, score int, "
    "summary struct<critical:int,medium:int,low:int>, files_scanned int"
)

# Limits and weights that decide results.
SEVERITIES = ("critical", "medium", "low")
SEVERITY_WEIGHTS = {"critical": 15, "medium": 6, "low": 2}
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_FINDINGS_PER_FILE = 100
DEFAULT_THRESHOLD = 80
HISTORY_LENGTH = 10
FRESH_MINUTES = 30
REVIEW_BATCH = 10
TOP_RISKS = 3


def severity_rank(severity: Column) -> Column:
    """critical 0, medium 1, everything else 2 (unknown severities sort and count as low)."""
    return F.when(severity == "critical", 0).when(severity == "medium", 1).otherwise(2)


def severity_group(severity: Column) -> Column:
    """The list a finding belongs to: critical, medium, or low for anything else."""
    return F.when(severity.isin("critical", "medium"), severity).otherwise("low")
