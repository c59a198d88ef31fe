"""Small scalar expressions used by reports, fixes and reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions.text import trim_ws

# Key names that mark an environment variable as sensitive.
_SENSITIVE_KEY = r"(?i)password|secret|key|token|private|api_key|auth"


def sarif_level(severity: Column) -> Column:
    return (
        F.when(severity == "critical", "error")
        .when(severity == "medium", "warning")
        .when(severity == "low", "note")
    )


def to_uri(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def html_escape(text: Column) -> Column:
    for raw, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#039;"),
    ):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def script_safe(json: Column) -> Column:
    """JSON that can stand inside a script element: no raw angle brackets."""
    return F.replace(
        F.replace(json, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")
    )


def clamp_percent(x: Column, default: int) -> Column:
    """Rounded half up and held within 0 to 100; the default where x is not a finite number."""
    x = x.cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(x + 0.5).cast("double")))
    return F.when(finite, rounded.cast("int")).otherwise(F.lit(default))


def risk_label(score: Column) -> Column:
    return (
        F.when(score >= 90, "EXCELLENT")
        .when(score >= 80, "LOW RISK")
        .when(score >= 60, "MODERATE")
        .when(score >= 40, "HIGH RISK")
        .otherwise("CRITICAL")
    )


def recommendations(critical: Column, medium: Column, low: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(critical > 0, F.lit("URGENT: Fix critical issues before deployment")),
            F.when(medium > 0, F.lit("Schedule fixes for medium severity issues")),
            F.when(low > 0, F.lit("Address low priority issues when convenient")),
            F.when(
                (critical + medium + low) == 0, F.lit("Maintain secure coding practices")
            ),
        )
    )


def readiness_class(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(F.contains(low, F.lit("ready")) | F.contains(low, F.lit("safe")), "go")
        .when(F.contains(low, F.lit("caution")) | F.contains(low, F.lit("moderate")), "hold")
        .otherwise("stop")
    )


def mask_secret(value: Column) -> Column:
    return (
        F.when(value.isNull() | (value == ""), "(not set)")
        .when(F.length(value) <= 8, "***")
        .otherwise(F.concat(F.substring(value, 1, 4), F.lit("***")))
    )


def env_placeholder(key: Column) -> Column:
    sensitive = F.concat(
        F.lit("YOUR_"), F.regexp_replace(F.upper(key), "[^A-Z0-9]", "_"), F.lit("_HERE")
    )
    plain = F.concat(
        F.lit("your_"), F.regexp_replace(F.lower(key), "[^a-z0-9]", "_"), F.lit("_here")
    )
    return F.when(F.rlike(key, F.lit(_SENSITIVE_KEY)), sensitive).otherwise(plain)


def env_template_line(line: Column) -> Column:
    """``KEY=value`` becomes ``KEY=<placeholder>``; blanks, comments and other lines stay."""
    trimmed = trim_ws(line)
    at = F.instr(line, "=")
    key = trim_ws(F.substring(line, F.lit(1), at - 1))
    keep = (trimmed == "") | F.startswith(trimmed, F.lit("#")) | (at <= 1)
    return F.when(keep, line).otherwise(F.concat(key, F.lit("="), env_placeholder(key)))


def fenced_json(text: Column) -> Column:
    """The text of the first ```json fence, else of the first fence, else the whole text."""
    tagged = r"(?s)```json\n?(.*?)\n?```"
    plain = r"(?s)```\n?(.*?)\n?```"
    inner = F.when(
        F.rlike(text, F.lit(tagged)), F.regexp_extract(text, tagged, 1)
    ).when(F.rlike(text, F.lit(plain)), F.regexp_extract(text, plain, 1))
    return F.coalesce(F.nullif(trim_ws(inner), F.lit("")), trim_ws(text))


def number_text(x: Column) -> Column:
    """A double as JavaScript prints it: whole numbers without a fraction."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def diff_stamp(as_of: Column) -> Column:
    return F.date_format(as_of, "yyyy-MM-dd HH:mm:ss")
