"""The data side of reviews by an external model: requests out, checked answers in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions import scalars
from scanloom.operators import findings as ops
from scanloom.operators.reports import finding_struct

_NUMBER = r"^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL\(.*)$"


@dataclass(frozen=True)
class Field:
    """One field of an answer: its type, the value where it is missing, and its limits."""

    name: str
    kind: str
    default: object = None
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()
    items: tuple[Field, ...] = ()

    @property
    def sql_type(self) -> str:
        if self.kind == "number":
            return "double"
        if self.kind == "strings":
            return "array<string>"
        if self.kind == "objects":
            inner = ",".join(f"{f.name}:{f.sql_type}" for f in self.items)
            return f"array<struct<{inner}>>"
        return "string"


# The five answer shapes with their defaults and limits.
_UNREADY = "Unable to determine ship readiness."
REVIEW = (
    Field("prioritizedRisks", "strings"),
    Field("quickFixes", "strings"),
    Field("shipReadiness", "string", _UNREADY),
)
FIX = (
    Field("filePath", "string", ""),
    Field("patch", "string", ""),
    Field("description", "string", ""),
    Field("confidence", "number", 0.0, 0, 1),
    Field("testSuggestion", "string", ""),
)
ANALYSIS = (
    Field("severity", "string", "unknown"),
    Field("cvss", "number", 0.0, 0, 10),
    Field("impact", "string", ""),
    Field("exploitability", "string", ""),
    Field("remediation", "string", ""),
    Field("falsePositiveRisk", "string", "medium", choices=("low", "medium", "high")),
)
RANKING = (
    Field(
        "rankings",
        "objects",
        items=(
            Field("findingIndex", "number"),
            Field("priority", "number"),
            Field("reasoning", "string"),
        ),
    ),
    Field("overallScore", "number", 0.0, 0, 100),
    Field("shipReadiness", "string", _UNREADY),
    Field("timeEstimate", "string", "Unknown"),
)
SUGGESTED_RULES = (
    Field(
        "suggestedRules",
        "objects",
        items=tuple(Field(n, "string") for n in ("id", "pattern", "severity", "description")),
    ),
    Field("reasoning", "string", ""),
    Field("coverageGap", "string", ""),
)

# What stands in for an analysis that failed.
FAILED_ANALYSIS = {
    "severity": "medium",
    "cvss": 0.0,
    "impact": "Analysis failed — manual review recommended",
    "exploitability": "Unknown",
    "remediation": "Review finding manually",
    "falsePositiveRisk": "medium",
}
SAFE_TO_SHIP = "No findings detected. Safe to ship."


# --- checking answers ----------------------------------------------------------------------------


def _is(value: Column, field: Field) -> Column:
    """Whether a present JSON value has the field's type and lies within its limits."""
    kind = F.schema_of_variant(value)
    if field.kind == "number":
        number = F.try_variant_get(value, "$", "double")
        ok = F.rlike(kind, F.lit(_NUMBER))
        if field.low is not None:
            ok = ok & number.between(field.low, field.high)
        return ok
    if field.kind == "string":
        ok = kind == "STRING"
        if field.choices:
            ok = ok & F.try_variant_get(value, "$", "string").isin(*field.choices)
        return ok
    inside = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    if field.kind == "strings":
        each = lambda x: _matches(x, Field("", "string"))
    else:
        each = lambda x: _all_present(x, field.items)
    return F.startswith(kind, F.lit("ARRAY")) & F.forall(inside, each)


def _matches(value: Column, field: Field) -> Column:
    return F.coalesce(_is(value, field), F.lit(False))


def _all_present(value: Column, fields: tuple[Field, ...]) -> Column:
    ok = F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
    for f in fields:
        ok = ok & _matches(F.try_variant_get(value, f"$.{f.name}", "variant"), f)
    return F.coalesce(ok, F.lit(False))


def _default(field: Field) -> Column:
    if field.kind in ("strings", "objects"):
        return F.array().cast(field.sql_type)
    return F.lit(field.default)


def parse_answer(answers: DataFrame, fields: tuple[Field, ...], text: str = "response") -> DataFrame:
    """Add the fields of a JSON answer, and ``valid``.

    All or nothing: an answer that is not one JSON object, or has any field of a wrong type, out of
    limits or null, yields the defaults throughout. A missing field yields its own default, unknown
    fields are dropped. JSON inside a code fence is found first. The text is parsed inside brackets
    so that anything after the object is an error.
    """
    wrapped = F.concat(F.lit("["), scalars.fenced_json(F.col(text)), F.lit("]"))
    parsed = answers.withColumn("_list", F.try_parse_json(wrapped))
    one = F.when(
        F.try_variant_get("_list", "$[1]", "variant").isNull(),
        F.try_variant_get("_list", "$[0]", "variant"),
    )
    parsed = parsed.withColumn("_one", one).drop("_list")
    values = {f.name: F.try_variant_get("_one", f"$.{f.name}", "variant") for f in fields}
    parsed = parsed.withColumns({f"_{f.name}": values[f.name] for f in fields})
    valid = F.coalesce(F.startswith(F.schema_of_variant("_one"), F.lit("OBJECT")), F.lit(False))
    for f in fields:
        value = F.col(f"_{f.name}")
        valid = valid & (value.isNull() | _matches(value, f))
    parsed = parsed.withColumn("valid", valid)
    return parsed.select(
        *answers.columns,
        "valid",
        *[
            F.coalesce(
                F.when(F.col("valid"), F.try_variant_get(f"_{f.name}", "$", f.sql_type)),
                _default(f),
            ).alias(f.name)
            for f in fields
        ],
    )


# --- requests ------------------------------------------------------------------------------------


def analysis_requests(findings: DataFrame) -> DataFrame:
    """One request per finding, numbered in report order and batched by ten."""
    indexed = ops.review_batches(ops.in_report_order(findings))
    payload = F.to_json(finding_struct())
    return indexed.select(
        "project_id",
        "finding_index",
        "batch",
        payload.alias("payload"),
        scalars.token_estimate(payload).alias("token_estimate"),
    )


def fill_failed(requests: DataFrame, analyses: DataFrame) -> DataFrame:
    """Analyses by request; a request without an answer gets the fixed one."""
    names = [f.name for f in ANALYSIS]
    answered = analyses.select(
        "project_id", "finding_index", F.struct(*names).alias("answer")
    )
    fixed = F.struct(*[F.lit(FAILED_ANALYSIS[n]).alias(n) for n in names])
    return (
        requests.join(answered, ["project_id", "finding_index"], "left")
        .withColumn("answer", F.coalesce("answer", fixed))
        .select("project_id", "finding_index", "answer.*")
    )


def ranking_request(findings: DataFrame, analyses: DataFrame) -> DataFrame:
    """The ranking payload of each project as parts: a list of index, finding and analysis."""
    indexed = ops.in_report_order(findings).join(
        analyses.select(
            "project_id", "finding_index", F.struct(*[f.name for f in ANALYSIS]).alias("analysis")
        ),
        ["project_id", "finding_index"],
        "left",
    )
    entry = F.to_json(
        F.struct(
            F.col("finding_index").alias("index"), finding_struct().alias("finding"), "analysis"
        )
    )
    comma = F.when(F.col("finding_index") > 0, ",").otherwise("")
    rows = indexed.select(
        "project_id",
        F.lit(1).alias("section"),
        F.col("finding_index").alias("item"),
        F.concat(comma, entry).alias("text"),
    )
    frame = findings.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    ends = F.array(
        F.struct(F.lit(0).alias("section"), F.lit("[").alias("text")),
        F.struct(F.lit(2).alias("section"), F.lit("]").alias("text")),
    )
    return rows.unionByName(
        frame.select("project_id", F.explode(ends).alias("p")).select(
            "project_id", "p.section", F.lit(0).cast("bigint").alias("item"), "p.text"
        )
    )


# --- results -------------------------------------------------------------------------------------


def top_rankings(rankings: DataFrame, k: int = schemas.TOP_RISKS) -> DataFrame:
    """The k rankings of smallest priority of each answer, ties in the order given.

    The list is sorted where it stands: it is part of one answer, so no row is moved.
    """
    placed = F.transform(
        "rankings",
        lambda r, i: F.struct(
            r["priority"].alias("priority"),
            i.alias("place"),
            r["findingIndex"].alias("findingIndex"),
            r["reasoning"].alias("reasoning"),
        ),
    )
    best = F.slice(F.array_sort(placed), 1, k)
    return rankings.select(
        "project_id", "shipReadiness", F.posexplode_outer(best).alias("rank", "r")
    ).select(
        "project_id",
        "shipReadiness",
        "rank",
        "r.findingIndex",
        "r.reasoning",
    )


def review_result(
    projects: DataFrame, indexed: DataFrame, analyses: DataFrame, rankings: DataFrame
) -> DataFrame:
    """Risks, quick fixes and readiness per project.

    ``indexed`` has findings with ``finding_index``, ``analyses`` one row per finding, ``rankings``
    one checked ranking answer per project. Only the three picked findings of a project are joined.
    """
    top = top_rankings(rankings)
    whole = F.col("findingIndex") == F.floor("findingIndex")
    keyed = top.withColumn("finding_index", F.when(whole, F.col("findingIndex").cast("bigint")))
    picked = (
        keyed.join(
            indexed.select("project_id", F.col("finding_index").cast("bigint"), "message"),
            ["project_id", "finding_index"],
            "left",
        )
        .join(
            analyses.select(
                "project_id", F.col("finding_index").cast("bigint"), "cvss", "remediation"
            ),
            ["project_id", "finding_index"],
            "left",
        )
        .withColumn(
            "risk",
            F.when(
                F.col("message").isNotNull() & F.col("cvss").isNotNull(),
                F.concat(
                    F.lit("[CVSS "),
                    scalars.number_text(F.col("cvss")),
                    F.lit("] "),
                    "message",
                    F.lit(" — "),
                    "reasoning",
                ),
            ).otherwise(F.col("reasoning")),
        )
        .withColumn("fix", F.coalesce("remediation", F.lit(FAILED_ANALYSIS["remediation"])))
    )
    entry = F.when(F.col("rank").isNotNull(), F.struct("rank", "risk", "fix"))
    gathered = picked.groupBy("project_id").agg(
        F.array_sort(F.collect_list(entry)).alias("top"),
        F.first("shipReadiness").alias("shipReadiness"),
    )
    counted = (
        projects.select("project_id", F.lit(0).alias("one"))
        .unionByName(indexed.select("project_id", F.lit(1).alias("one")))
        .groupBy("project_id")
        .agg(F.sum("one").alias("n"))
    )
    none = F.array().cast("array<string>")
    some = F.col("n") > 0
    return counted.join(gathered, "project_id", "left").select(
        "project_id",
        F.coalesce(F.when(some, F.transform("top", lambda t: t["risk"])), none).alias(
            "prioritizedRisks"
        ),
        F.coalesce(F.when(some, F.transform("top", lambda t: t["fix"])), none).alias("quickFixes"),
        F.when(some, F.coalesce("shipReadiness", F.lit(_UNREADY)))
        .otherwise(F.lit(SAFE_TO_SHIP))
        .alias("shipReadiness"),
    )


def fill_fix_paths(fixes: DataFrame, finding_path: str = "finding_path") -> DataFrame:
    """Fix answers without a path are about the file of their finding."""
    path = F.coalesce(F.nullif(F.col("filePath"), F.lit("")), F.col(finding_path))
    return fixes.withColumn("filePath", path)


def usage_totals(usage: DataFrame) -> DataFrame:
    """Tokens and cost over all requests, per provider."""
    return usage.groupBy("provider").agg(
        F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cost").alias("cost")
    )


def suggested_rule_table(answers: DataFrame, order: list[str]) -> DataFrame:
    """Suggested rules as a rule table ready for admission.

    An answer names no category, name or reach; they become the id, ``suggested`` and scripts.
    Rules load in the order of the given columns, then of their place in the answer.
    """
    rows = answers.select(*order, F.posexplode("suggestedRules").alias("place", "rule"))
    patterns = F.array(
        F.struct(
            F.col("rule.pattern").alias("regex"),
            F.lit("").alias("flags"),
            F.col("rule.description").alias("message"),
        )
    )
    return rows.select(
        F.struct(*order, "place").alias("load_order"),
        F.col("rule.id").alias("rule_id"),
        F.col("rule.id").alias("name"),
        F.col("rule.description").alias("description"),
        F.lit("suggested").alias("category"),
        F.col("rule.severity").alias("severity"),
        F.array(F.lit(".ts"), F.lit(".js")).alias("applicable_to"),
        patterns.alias("patterns"),
    )
