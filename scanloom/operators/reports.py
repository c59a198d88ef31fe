"""Reports as documents made of rows.

A project can have any number of findings, so no report is gathered into one value. A document is a
table of text parts: concatenated in order of ``section`` and ``item`` the parts of a project are the
document. Each part of the JSON documents here is a run of whole tokens, so parts may also be put on
lines of their own (``write_documents``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions import scalars
from scanloom.operators import findings as ops
from scanloom.operators.numbering import number_rows

# Fixed values of the exchange format.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = (
    "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/"
    "sarif-schema-2.1.0.json"
)
TOOL_NAME = "scanloom"
TOOL_VERSION = "0.1.0"


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def finding_struct() -> Column:
    """A finding with its public names; a missing line is left out of the JSON."""
    return F.struct(
        F.col("path").alias("filePath"),
        F.col("line"),
        F.col("severity"),
        F.col("message"),
        F.col("rule_id").alias("ruleId"),
        F.col("category"),
    )


def _counts_struct(total: bool = False) -> Column:
    names = list(schemas.SEVERITIES) + (["total"] if total else [])
    return F.struct(*[F.col(n) for n in names])


def _fixed_parts(projects: DataFrame, parts: Mapping[int, Column]) -> DataFrame:
    """The parts every project has: its frame around the findings."""
    rows = F.array(
        *[F.struct(F.lit(s).alias("section"), t.alias("text")) for s, t in parts.items()]
    )
    framed = projects.select("project_id", rows.alias("rows"))
    return framed.select("project_id", F.explode_outer("rows").alias("part")).select(
        "project_id",
        "part.section",
        F.lit(0).cast("bigint").alias("item"),
        F.col("part.text").alias("text"),
    )


def _open_object(json: Column) -> Column:
    """The JSON of an object without its closing brace, to be continued."""
    return F.substring(json, F.lit(1), F.length(json) - 1)


def _listed(indexed: DataFrame, section: Column, json: Column) -> DataFrame:
    """One part per finding, separated by commas."""
    comma = F.when(F.col("item") > 0, ",").otherwise("")
    return indexed.select(
        "project_id", section.alias("section"), "item", F.concat(comma, json).alias("text")
    )


def _by_severity(
    head: Column, tail: Column, projects: DataFrame, findings: DataFrame
) -> DataFrame:
    """A document with the findings in one list per severity."""
    frame = _fixed_parts(
        projects,
        {
            0: F.concat(head, F.lit(',"findings":{"critical":[')),
            2: F.lit('],"medium":['),
            4: F.lit('],"low":['),
            6: F.concat(F.lit("]}"), tail),
        },
    )
    rows = ops.ranked(findings)
    rows = number_rows(
        rows,
        ["project_id", "severity_rank"],
        ["path", "rule_ordinal", "seq"],
        "item",
    )
    section = F.col("severity_rank") * 2 + 1
    return frame.unionByName(_listed(rows, section, F.to_json(finding_struct())))


def json_report(
    scores: DataFrame, findings: DataFrame, as_of: Column, provider: str = "none"
) -> DataFrame:
    """The scan report of each project: counts, score, gate and findings by severity.

    ``scores`` has one row per project, also for projects without findings.
    """
    head = F.to_json(
        F.struct(
            iso_instant(as_of).alias("timestamp"),
            F.col("project_id").alias("path"),
            F.lit(provider).alias("provider"),
            _counts_struct().alias("summary"),
            "score",
            "threshold",
            "passed",
        )
    )
    return _by_severity(_open_object(head), F.lit("}"), scores, findings)


def sarif_rules(rules: DataFrame) -> DataFrame:
    """The rules section of the exchange format, one row per rule with its 0-based index."""
    entry = F.struct(
        F.col("rule_id").alias("id"),
        F.struct(F.col("name").alias("text")).alias("shortDescription"),
        F.struct(F.col("description").alias("text")).alias("fullDescription"),
        F.struct(scalars.sarif_level(F.col("severity")).alias("level")).alias(
            "defaultConfiguration"
        ),
        F.struct("category").alias("properties"),
    )
    return rules.select(
        (F.col("rule_ordinal") - 1).alias("rule_index"), "rule_id", F.to_json(entry).alias("json")
    )


def sarif_results(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings as results of the exchange format; the index of an unknown rule stays null."""
    known = rules.select("rule_id", (F.col("rule_ordinal") - 1).alias("rule_index"))
    return findings.join(known, "rule_id", "left").select(
        *findings.columns,
        scalars.sarif_level(F.col("severity")).alias("level"),
        scalars.to_uri(F.col("path")).alias("uri"),
        F.coalesce(F.nullif("line", F.lit(0)), F.lit(1)).alias("start_line"),
        F.lit(1).alias("start_column"),
        "rule_index",
    )


def _sarif_result() -> Column:
    location = F.struct(
        F.struct(
            F.struct(F.col("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
            F.struct(
                F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn")
            ).alias("region"),
        ).alias("physicalLocation")
    )
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"),
            "level",
            F.struct(F.col("message").alias("text")).alias("message"),
            F.array(location).alias("locations"),
            F.col("rule_index").alias("ruleIndex"),
        )
    )


def sarif_report(
    projects: DataFrame, findings: DataFrame, rules: DataFrame
) -> DataFrame:
    """The exchange document of each project. The rule list is configuration and fits one part."""
    listed = sarif_rules(rules).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rule_index", "json"))), lambda r: r["json"]
            ),
            ",",
        ).alias("rules_json")
    )
    head = F.concat(
        F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":'),
        F.lit(f'{{"driver":{{"name":"{TOOL_NAME}","version":"{TOOL_VERSION}","rules":['),
        listed.scalar(),
        F.lit(']}},"results":['),
    )
    frame = _fixed_parts(projects, {0: head, 2: F.lit("]}]}")})
    rows = sarif_results(ops.in_report_order(findings), rules).withColumnRenamed(
        "finding_index", "item"
    )
    return frame.unionByName(_listed(rows, F.lit(1), _sarif_result()))


def html_rows(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows behind the interactive report."""
    described = rules.select("rule_id", F.col("description").alias("rule_description"))
    return (
        ops.in_report_order(findings)
        .join(described, "rule_id", "left")
        .select(
            "project_id",
            F.col("finding_index").alias("idx"),
            "severity",
            "rule_id",
            "path",
            F.coalesce("line", F.lit(0)).alias("line"),
            "message",
            "category",
            F.coalesce("rule_description", F.lit("")).alias("rule_description"),
        )
    )


def html_payload(
    projects: DataFrame, findings: DataFrame, rules: DataFrame
) -> DataFrame:
    """The same rows as JSON that is safe inside a script element."""
    json = F.to_json(
        F.struct(
            "idx",
            "severity",
            F.col("rule_id").alias("ruleId"),
            F.col("path").alias("filePath"),
            "line",
            "message",
            "category",
            F.col("rule_description").alias("ruleDescription"),
        )
    )
    frame = _fixed_parts(projects, {0: F.lit("["), 2: F.lit("]")})
    rows = html_rows(findings, rules).withColumn("item", F.col("idx"))
    return frame.unionByName(_listed(rows, F.lit(1), scalars.script_safe(json)))


def html_header(scores: DataFrame) -> DataFrame:
    """Score and threshold as the interactive report shows them."""
    return (
        scores.withColumn("score", scalars.clamp_percent(F.col("score"), 0))
        .withColumn("threshold", scalars.clamp_percent(F.col("threshold"), 80))
        .withColumn("passed", F.col("score") >= F.col("threshold"))
    )


def risk_summary(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """Score, counts and top risks, one row per project. At most three risks each are gathered."""
    risk = F.struct(
        "rank",
        F.struct(
            F.col("rule_id").alias("ruleId"),
            "severity",
            "message",
            F.col("path").alias("filePath"),
        ).alias("risk"),
    )
    top = (
        ops.top_risks(findings)
        .groupBy("project_id")
        .agg(F.transform(F.array_sort(F.collect_list(risk)), lambda r: r["risk"]).alias("top_risks"))
    )
    return scores.join(top, "project_id", "left").select(
        "project_id",
        "score",
        *schemas.SEVERITIES,
        "total",
        F.coalesce(
            "top_risks",
            F.array().cast(
                "array<struct<ruleId:string,severity:string,message:string,filePath:string>>"
            ),
        ).alias("top_risks"),
    )


def risk_summary_json(summary: DataFrame, as_of: Column) -> DataFrame:
    return summary.select(
        "project_id",
        F.to_json(
            F.struct(
                "score",
                iso_instant(as_of).alias("scannedAt"),
                F.col("project_id").alias("path"),
                _counts_struct(total=True).alias("summary"),
                F.col("top_risks").alias("topRisks"),
            )
        ).alias("text"),
    )


def risk_detail(
    scores: DataFrame, findings: DataFrame, as_of: Column
) -> DataFrame:
    """The detailed risk report of each project as a document."""
    head = F.to_json(
        F.struct(
            "score",
            iso_instant(as_of).alias("scannedAt"),
            F.col("project_id").alias("path"),
            _counts_struct(total=True).alias("summary"),
        )
    )
    return _by_severity(_open_object(head), F.lit("}"), scores, findings)


def latest_scan_view(latest: DataFrame, findings: DataFrame) -> DataFrame:
    """The latest fresh scan of each project with its findings, or a message where there is none.

    ``latest`` comes from ``history.latest_fresh``: a null ``ts`` marks projects without one.
    """
    head = F.to_json(
        F.struct(
            "score",
            F.col("project_id").alias("path"),
            iso_instant(F.col("ts")).alias("scannedAt"),
            "summary",
        )
    )
    fresh = latest.where(F.col("ts").isNotNull())
    stale = latest.where(F.col("ts").isNull()).select(
        "project_id",
        F.lit(0).alias("section"),
        F.lit(0).cast("bigint").alias("item"),
        F.lit('{"message":"No scan results available. Run a scan first."}').alias("text"),
    )
    frame = _fixed_parts(
        fresh,
        {
            0: F.concat(_open_object(head), F.lit(',"findings":[')),
            2: F.concat(
                F.lit('],"metadata":'),
                F.to_json(F.struct(F.col("files_scanned").alias("filesScanned"))),
                F.lit("}"),
            ),
        },
    )
    shown = findings.join(fresh.select("project_id"), "project_id", "left_semi")
    rows = ops.in_report_order(shown).withColumnRenamed("finding_index", "item")
    return (
        frame.unionByName(_listed(rows, F.lit(1), F.to_json(finding_struct()))).unionByName(stale)
    )


def score_labels(scores: DataFrame) -> DataFrame:
    """Label, advice and gate behind a score."""
    return scores.withColumn("label", scalars.risk_label(F.col("score"))).withColumn(
        "advice",
        scalars.recommendations(F.col("critical"), F.col("medium"), F.col("low")),
    )


def write_documents(parts: DataFrame, folder: str) -> None:
    """Write documents as text, one folder per project; its files in name order are the document.

    Parts are spread by range of their place, so a very long document is written by many tasks.
    """
    order = ["project_id", *[c for c in parts.columns if c not in ("project_id", "text")]]
    (
        parts.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("project_id", "text")
        .write.partitionBy("project_id")
        .text(folder)
    )
