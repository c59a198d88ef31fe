"""Registered queries: each reads the given tables and runs one operator or report over all of them.

``REGISTRY`` maps a name to the Spark query and to the SQL that must give the same rows, or to None
where there is no such SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle as o
from scanloom import schemas
from scanloom.functions import paths, scalars, text
from scanloom.operators import findings as ops
from scanloom.operators import fixes, history, reports, review, rulebook
from scanloom.operators.linestate import strip_by_line
from scanloom.operators.pluggable import python_rule
from scanloom.operators.rulebook import Rulebook
from scanloom.plans import corpus, scan, storage
from scanloom.streaming.watch import scan_stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def keep(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn

    return keep


def as_of() -> Column:
    return F.lit("2024-06-01 12:00:00").cast("timestamp")


# --- flagship: real text -------------------------------------------------------------------------

_DOC_SCAN = f"""WITH {o.DOCUMENTS}, all_files AS (SELECT * FROM files), {o.raw_lines('files')},
{o.findings(o.HITS['hardcoded-secrets'])}, {o.SCORES}"""


def document_hits(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.documents(spark, sf)
    found = scan.detect.detect(files, rule_ids=["hardcoded-secrets"])
    return found


@register("risk_by_project", f"{_DOC_SCAN} SELECT project_id, critical, medium, low, score, passed FROM scores")
def risk_by_project(spark, sf):
    book = Rulebook()
    found = document_hits(spark, sf).select(
        "project_id", book.describe(F.col("code"))["severity"].alias("severity")
    )
    files = corpus.table(spark, sf, "documents").select(F.col("source").alias("project_id"))
    scores = ops.with_score(ops.severity_counts(files, found))
    return scores.select("project_id", "critical", "medium", "low", "score", "passed")


@register("rule_secrets", f"{_DOC_SCAN} SELECT {o.FINDING_COLUMNS} FROM findings")
def rule_secrets(spark, sf):
    return ops.to_findings(document_hits(spark, sf))


# --- paths, lines, comments ----------------------------------------------------------------------


@register(
    "source_scan_filter",
    f"""WITH {o.WORKSPACE}, listing AS (
  SELECT project_id, path FROM all_files UNION ALL SELECT * FROM env_examples)
SELECT project_id, path, {o.SCOPE} AS scanned, {o.SCOPE} AND {o.SCRIPTS} AS script,
  regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/?[^/]*$', '') AS folder FROM listing""",
)
def source_scan_filter(spark, sf):
    path = F.col("path")
    scanned = paths.in_scan_scope(path)
    return corpus.workspace_listing(spark, sf).select(
        "project_id",
        "path",
        scanned.alias("scanned"),
        (scanned & paths.applies_to(path, (".ts", ".js", ".jsx", ".tsx"))).alias("script"),
        paths.basename(path).alias("name"),
        paths.dirname(path).alias("folder"),
    )


@register(
    "rule_reach",
    f"""WITH {o.WORKSPACE}, {o.BUILT_IN}, reach AS (
  SELECT rule_id, unnest(string_split(applicable_to, ',')) AS p FROM built_in)
SELECT DISTINCT project_id, path, rule_id FROM files JOIN reach ON
  CASE WHEN starts_with(p, '.') THEN ends_with(lower(path), p)
       ELSE regexp_extract(lower(path), '[^/]*$') = lower(p) END""",
)
def rule_reach(spark, sf):
    applied = scan.rules_applied(scan.scannable(corpus.workspace(spark, sf)))
    return applied.select("project_id", "path", F.explode("rules_applied").alias("rule_id"))


@register(
    "comment_strip",
    f"""WITH {o.CODE}, files AS (SELECT * FROM code), {o.stripped_lines('files')}
SELECT project_id, path, line, raw, stripped FROM lines""",
)
def comment_strip(spark, sf):
    content = F.col("content")
    both = F.arrays_zip(
        text.split_lines(content).alias("raw"),
        text.split_lines(text.strip_comments(content)).alias("stripped"),
    )
    zipped = corpus.code(spark, sf).select("project_id", "path", both.alias("both"))
    return zipped.select("project_id", "path", F.posexplode_outer("both").alias("pos", "l")).select(
        "project_id", "path", (F.col("pos") + 1).alias("line"), "l.raw", "l.stripped"
    )


@register(
    "comment_strip_by_line",
    f"""WITH {o.CODE}, files AS (SELECT * FROM code), {o.stripped_lines('files')}
SELECT project_id, path, line, raw, stripped FROM lines""",
)
def comment_strip_by_line(spark, sf):
    lines = corpus.code(spark, sf).select(
        "project_id", "path", F.posexplode(text.split_lines(F.col("content"))).alias("pos", "raw")
    )
    return strip_by_line(
        lines.select("project_id", "path", (F.col("pos") + 1).alias("line"), "raw")
    )


@register(
    "inline_strip",
    f"""WITH {o.CODE}, {o.raw_lines('code')}
SELECT project_id, path, line, array_to_string(list_filter(regexp_extract_all(raw, {o.q(o.PIECES)}),
  lambda t: NOT starts_with(t, '//') AND NOT starts_with(t, '/*')), '') AS stripped FROM lines""",
)
def inline_strip(spark, sf):
    lines = corpus.code(spark, sf).select(
        "project_id", "path", F.posexplode(text.split_lines(F.col("content"))).alias("pos", "raw")
    )
    return lines.select(
        "project_id",
        "path",
        (F.col("pos") + 1).alias("line"),
        text.strip_inline_comments(F.col("raw")).alias("stripped"),
    )


@register(
    "comment_line_filter",
    f"""WITH {o.CODE}, {o.raw_lines('code')} SELECT project_id, path, line, raw FROM lines WHERE {o.COMMENT}""",
)
def comment_line_filter(spark, sf):
    lines = corpus.code(spark, sf).select(
        "project_id", "path", F.posexplode(text.split_lines(F.col("content"))).alias("pos", "raw")
    )
    return lines.where(text.is_comment_line(F.col("raw"))).select(
        "project_id", "path", (F.col("pos") + 1).alias("line"), "raw"
    )


@register(
    "path_containment",
    f"""WITH {o.CODE}, tried AS (
  SELECT f, 'src/../' || path AS path FROM (SELECT split_part(regexp_extract(path, 'f[0-9]+'), 'f', 2)::INT AS f, path FROM code)
  UNION ALL SELECT split_part(regexp_extract(path, 'f[0-9]+'), 'f', 2)::INT, '../../' || path FROM code
  UNION ALL SELECT split_part(regexp_extract(path, 'f[0-9]+'), 'f', 2)::INT, '/srv/app/' || path FROM code
  UNION ALL SELECT split_part(regexp_extract(path, 'f[0-9]+'), 'f', 2)::INT, '/srv/app2/' || path FROM code
  UNION ALL SELECT split_part(regexp_extract(path, 'f[0-9]+'), 'f', 2)::INT, './a/.././' || path FROM code)
SELECT path, NOT starts_with(path, '../') AND NOT starts_with(path, '/srv/app2/') AS inside FROM tried""",
)
def path_containment(spark, sf):
    code = corpus.code_paths(corpus.table(spark, sf, "events"))
    prefixes = F.array(
        *[F.lit(p) for p in ("src/../", "../../", "/srv/app/", "/srv/app2/", "./a/.././")]
    )
    tried = code.select("path", F.explode(prefixes).alias("prefix")).select(
        F.concat("prefix", "path").alias("path")
    )
    return tried.select("path", paths.is_within(F.lit("/srv/app"), F.col("path")).alias("inside"))


@register(
    "mask_secret",
    r"""SELECT doc_id, coalesce(CASE WHEN secret = '' THEN '(not set)' WHEN length(secret) <= 8 THEN '***'
  ELSE substr(secret, 1, 4) || '***' END, '(not set)') AS masked
FROM (SELECT doc_id, regexp_extract(text, 'token = "([^"]*)"', 1) AS secret FROM documents)""",
)
def mask_secret(spark, sf):
    secret = F.regexp_extract("text", 'token = "([^"]*)"', 1)
    return corpus.table(spark, sf, "documents").select(
        "doc_id", scalars.mask_secret(secret).alias("masked")
    )


# --- rules one by one ----------------------------------------------------------------------------


def _rule(rule_id: str, source: Callable = corpus.workspace) -> Query:
    def run(spark, sf):
        files = scan.scannable(source(spark, sf))
        return scan.analyze(files, [rule_id], corpus.env_listing(spark, sf))

    return run


for _name, _rule_id in {
    "rule_sql_injection": "sql-injection",
    "rule_xss": "xss-vulnerable",
    "rule_cors": "cors-permissive",
    "rule_error_leak": "error-info-leak",
    "rule_weak_crypto": "weak-crypto",
    "rule_docker_ports": "docker-expose-postgres",
    "rule_env_missing": "env-missing-example",
    "rule_insecure_dependency": "insecure-dependency",
    "rule_console_excess": "console-log-excessive",
    "rule_secrets_in_code": "hardcoded-secrets",
}.items():
    register(_name, o.rule_query(_rule_id))(_rule(_rule_id))


# --- custom rules --------------------------------------------------------------------------------


def custom_book() -> Rulebook:
    reach = (".ts", ".js")
    return Rulebook().with_custom(
        [
            rulebook.custom_rule(
                "page-tracking",
                "Page tracking",
                "Finds tracking calls",
                "privacy",
                "critical",
                reach,
                [(r"track\(\d+\)", "", "Tracker {match} called"), (r"gtag\(", "", "Tag {match}")],
            ),
            rulebook.custom_rule(
                "year-number",
                "Year number",
                "Finds four-digit numbers",
                "style",
                "low",
                reach,
                [(r"\b\d{4}\b", "", "Number {match} found, {match} kept")],
            ),
            rulebook.custom_rule(
                "script-block",
                "Script block",
                "Finds scripts",
                "xss",
                "medium",
                reach,
                [("<SCRIPT", "gi", "Inline script"), ("onload=", "i", "Handler {match}")],
            ),
        ]
    )


_TEXT_FILES = """
files AS (
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS project_id, 'pages/' || page_id || '.js' AS path, html AS content FROM pages
  UNION ALL SELECT source, 'docs/' || doc_id || '.ts', text FROM documents)"""


@register(
    "custom_rules",
    f"""WITH {_TEXT_FILES}, {o.raw_lines('files')}, found AS ({o.custom_hits()}),
placed AS (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY rule_ordinal, ord) AS place FROM found)
SELECT project_id, path, line, severity, message, rule_id FROM placed WHERE place <= 100""",
)
def custom_rules(spark, sf):
    book = custom_book()
    files = corpus.pages(spark, sf).unionByName(corpus.documents(spark, sf))
    found = scan.detect.detect(files, None, book, ["page-tracking", "year-number", "script-block"])
    return ops.to_findings(found, book).select(
        "project_id", "path", "line", "severity", "message", "rule_id"
    )


def candidate_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules someone might submit, one per part; many are broken or repeat an id."""
    key, size = F.col("p_partkey"), F.col("p_size")
    rule_id = (
        F.when(key % 97 == 0, "xss-vulnerable")
        .when(key % 97 == 1, "weak-crypto")
        .otherwise(F.concat(F.lit("r"), (key % 700).cast("string")))
    )
    severity = (
        F.when(size % 5 == 0, "critical")
        .when(size % 5 == 1, "medium")
        .when(size % 5 < 4, "low")
        .when(size % 2 == 0, "high")
        .otherwise("medium")
    )
    reach = (
        F.when(key % 41 == 0, F.array(F.lit(".ts"), F.lit(None).cast("string")))
        .when(key % 43 == 0, F.lit(None).cast("array<string>"))
        .otherwise(F.array(F.lit(".ts"), F.lit(".js")))
    )
    kind = key % 10
    one = (
        F.when(kind == 0, F.concat(F.lit("("), "p_name"))
        .when(kind == 1, "")
        .when(kind == 2, "a" * 501)
        .when(kind == 3, F.concat(F.lit("["), "p_brand"))
        .when(kind == 4, F.concat(F.lit("*"), "p_brand"))
        .when(kind == 5, r"\b[0-9]{2}\b")
        .otherwise(F.concat("p_brand", F.lit(r"\s+[A-Z]{2,3}$")))
    )
    two = F.when(key % 4 != 0, F.split_part("p_name", F.lit(" "), F.lit(1)))
    pattern = lambda c: F.struct(
        c.alias("regex"), F.lit("").alias("flags"), F.lit("Found {match}").alias("message")
    )
    return corpus.table(spark, sf, "part").select(
        key.cast("int").alias("load_order"),
        rule_id.alias("rule_id"),
        F.col("p_name").alias("name"),
        F.when(key % 53 != 0, F.concat("p_type", F.lit(" rule"))).alias("description"),
        F.lower("p_type").alias("category"),
        severity.alias("severity"),
        reach.alias("applicable_to"),
        F.array(pattern(one), pattern(two)).alias("patterns"),
    )


@register(
    "custom_rule_admission",
    f"""WITH {o.CANDIDATES}
SELECT load_order, rule_id, reason IS NULL AS admitted, coalesce(reason, '') AS reason,
  CASE WHEN reason IS NULL THEN usable::INT ELSE 0 END AS patterns FROM judged""",
)
def custom_rule_admission(spark, sf):
    admitted, rejected = rulebook.admit_rules(candidate_rules(spark, sf))
    good = admitted.select(
        "load_order",
        "rule_id",
        F.lit(True).alias("admitted"),
        F.lit("").alias("reason"),
        F.size("patterns").alias("patterns"),
    )
    bad = rejected.select(
        "load_order",
        "rule_id",
        F.lit(False).alias("admitted"),
        "reason",
        F.lit(0).alias("patterns"),
    )
    return good.unionByName(bad)


def merged_rules(spark: SparkSession, sf: str) -> DataFrame:
    admitted, _ = rulebook.admit_rules(candidate_rules(spark, sf))
    return rulebook.merge_rules(Rulebook().table(spark), admitted)


@register(
    "rulebook_merge",
    f"WITH {o.MERGED} SELECT source, load_order, rule_id, name, category, severity, applicable_to FROM merged",
)
def rulebook_merge(spark, sf):
    return merged_rules(spark, sf).select(
        "source",
        "load_order",
        "rule_id",
        "name",
        "category",
        "severity",
        F.array_join("applicable_to", ",").alias("applicable_to"),
    )


@register(
    "rule_listing",
    f"""WITH {o.MERGED} SELECT rule_id AS id, name, description, severity, category, applicable_to
FROM merged WHERE category = 'economy'""",
)
def rule_listing(spark, sf):
    listed = rulebook.list_rules(merged_rules(spark, sf), "economy")
    return listed.withColumn("applicable_to", F.array_join("applicable_to", ","))


# --- whole scans ---------------------------------------------------------------------------------


def workspace_findings(spark: SparkSession, sf: str, cap: int | None = None) -> DataFrame:
    return scan.scan(corpus.workspace(spark, sf), corpus.workspace_listing(spark, sf), cap=cap)


def stored_findings(spark: SparkSession, sf: str) -> DataFrame:
    return storage.settle(workspace_findings(spark, sf))


def workspace_scores(spark: SparkSession, sf: str, found: DataFrame) -> DataFrame:
    projects = workspace_names(spark, sf).select("project_id")
    return ops.with_score(ops.severity_counts(projects, found))


def workspace_names(spark: SparkSession, sf: str) -> DataFrame:
    """Project and path of the workspace files, composed without their content."""
    code = corpus.code_paths(corpus.table(spark, sf, "events")).select("project_id", "path")
    others = corpus.manifests(spark, sf).unionByName(corpus.env_files(spark, sf))
    return code.unionByName(others.select("project_id", "path"))


@register("all_findings", f"WITH {o.SCAN} SELECT {o.FINDING_COLUMNS} FROM findings")
def all_findings(spark, sf):
    return workspace_findings(spark, sf)


@register("all_findings_capped", f"WITH {o.SCAN_CAPPED} SELECT {o.FINDING_COLUMNS} FROM findings")
def all_findings_capped(spark, sf):
    return workspace_findings(spark, sf, o.CAP)


@register(
    "targeted_analysis",
    f"""WITH {o.WORKSPACE}, {o.stripped_lines('files')},
{o.findings(' UNION ALL '.join(o.HITS[r] for r in ('sql-injection', 'xss-vulnerable', 'weak-crypto')))}
SELECT path, count(*) AS findings_count, string_agg(rule_id || ':' || line, ',' ORDER BY rule_ordinal, seq) AS found
FROM findings GROUP BY project_id, path""",
)
def targeted_analysis(spark, sf):
    files = scan.scannable(corpus.workspace(spark, sf))
    found = scan.analyze(files, ["sql-injection", "xss-vulnerable", "weak-crypto"])
    entry = F.struct("rule_ordinal", "seq", F.concat("rule_id", F.lit(":"), "line").alias("t"))
    return (
        found.groupBy("project_id", "path")
        .agg(
            F.count(F.lit(1)).alias("findings_count"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), ","
            ).alias("found"),
        )
        .drop("project_id")
    )


@register(
    "project_scores",
    f"""WITH {o.SCAN}, {o.SCORES} SELECT project_id, critical, medium, low, total, score, threshold, passed FROM scores""",
)
def project_scores(spark, sf):
    files, listing = corpus.workspace(spark, sf), corpus.workspace_listing(spark, sf)
    scored = scan.project_scores(files, listing)
    return scored.select(
        "project_id", "critical", "medium", "low", "total", "score", "threshold", "passed"
    )


@register(
    "finding_order",
    f"""WITH {o.SCAN}, {o.INDEXED}
SELECT project_id, finding_index, finding_index // 10 AS batch, path, rule_id, line FROM indexed""",
)
def finding_order(spark, sf):
    indexed = ops.review_batches(ops.in_report_order(stored_findings(spark, sf)))
    return indexed.select("project_id", "finding_index", "batch", "path", "rule_id", "line")


@register(
    "top_risks",
    f"""WITH {o.SCAN}, picked AS (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {o.REPORT_ORDER}) AS rank FROM findings WHERE severity <> 'low')
SELECT project_id, rank, rule_id, severity, message, path FROM picked WHERE rank <= 3""",
)
def top_risks(spark, sf):
    top = ops.top_risks(workspace_findings(spark, sf))
    return top.select("project_id", "rank", "rule_id", "severity", "message", "path")


@register(
    "report_sorts",
    f"""WITH {o.SCAN}, visible AS (SELECT * FROM findings WHERE severity IN ('critical', 'medium'))
SELECT project_id, path, rule_id, seq,
  row_number() OVER (PARTITION BY project_id ORDER BY {o.REPORT_ORDER}) - 1 AS by_severity,
  row_number() OVER (PARTITION BY project_id ORDER BY path, {o.REPORT_ORDER}) - 1 AS by_file,
  row_number() OVER (PARTITION BY project_id ORDER BY rule_id, {o.REPORT_ORDER}) - 1 AS by_rule FROM visible""",
)
def report_sorts(spark, sf):
    positions = ops.report_positions(stored_findings(spark, sf), ("critical", "medium"))
    return positions.select(
        "project_id", "path", "rule_id", "seq", "by_severity", "by_file", "by_rule"
    )


def outcome_files(spark: SparkSession, sf: str) -> DataFrame:
    """Workspace files with read outcomes: some links, some too large, some unreadable."""
    h = F.length("path") * 7 + F.length("content")
    return corpus.workspace(spark, sf).select(
        "project_id",
        "path",
        F.when(h % 13 == 0, F.lit(20 * 1024 * 1024)).otherwise(F.length("content")).alias("size"),
        F.when(h % 11 == 0, "symlink").when(h % 17 == 0, "read_error").otherwise("ok").alias("status"),
        F.when(h % 17 == 0, "denied").alias("error"),
        "content",
    )


_OUTCOMES = f"""{o.WORKSPACE}, outcomes AS (
  SELECT project_id, path, CASE WHEN h % 11 = 0 THEN 'symlink' WHEN h % 17 = 0 THEN 'read_error'
    WHEN h % 13 = 0 THEN 'too_large' ELSE 'ok' END AS status
  FROM (SELECT *, length(path) * 7 + length(content) AS h FROM files))"""


@register(
    "scan_metadata",
    f"""WITH {_OUTCOMES} SELECT project_id, count(*) FILTER (status = 'ok') AS files_scanned,
  count(*) FILTER (status <> 'ok') AS files_skipped, count(*) FILTER (status = 'read_error') AS files_with_errors,
  10 AS rules_loaded FROM outcomes GROUP BY project_id""",
)
def scan_metadata(spark, sf):
    files = outcome_files(spark, sf)
    return ops.scan_metadata(scan.read_outcomes(files, schemas.MAX_FILE_BYTES), scan.scan_errors(files), len(Rulebook().rules))


@register(
    "read_outcomes",
    f"WITH {_OUTCOMES} SELECT project_id, path, status FROM outcomes",
)
def read_outcomes(spark, sf):
    return scan.read_outcomes(outcome_files(spark, sf), schemas.MAX_FILE_BYTES).select("project_id", "path", "status")


# --- reports -------------------------------------------------------------------------------------

_FINDING_JSON = (
    """'{"filePath":' || to_json(path) || CASE WHEN line IS NULL THEN '' ELSE ',"line":' || line END || """
    """',"severity":"' || severity || '","message":' || to_json(message) || ',"ruleId":"' || rule_id || """
    """'","category":"' || category || '"}'"""
)
_HEAD = (
    """'{"timestamp":"2024-06-01T12:00:00.000Z","path":"' || project_id || '","provider":"none","summary":{"critical":' """
    """|| critical || ',"medium":' || medium || ',"low":' || low || '},"score":' || score || ',"threshold":80,"passed":' """
    """|| passed || ',"findings":{"critical":['"""
)
_RISK_HEAD = (
    """'{"score":' || score || ',"scannedAt":"2024-06-01T12:00:00.000Z","path":"' || project_id || '","summary":{"critical":' """
    """|| critical || ',"medium":' || medium || ',"low":' || low || ',"total":' || total || '}'"""
)


def _by_severity_sql(head: str) -> str:
    return f"""SELECT project_id, unnest([0, 2, 4, 6]) AS section, 0 AS item,
  unnest([{head}, '],"medium":[', '],"low":[', ']}}}}']) AS text FROM scores
UNION ALL SELECT project_id, 2 * {o.RANK} + 1, item, CASE WHEN item > 0 THEN ',' ELSE '' END || {_FINDING_JSON}
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, {o.RANK} ORDER BY path, rule_ordinal, seq) - 1 AS item FROM findings)"""


@register("report_json", f"WITH {o.SCAN}, {o.SCORES} {_by_severity_sql(_HEAD)}")
def report_json(spark, sf):
    found = stored_findings(spark, sf)
    return reports.json_report(workspace_scores(spark, sf, found), found, as_of())


@register(
    "risk_detail",
    f"""WITH {o.SCAN}, {o.SCORES} {_by_severity_sql(_RISK_HEAD + """ || ',"findings":{"critical":['""")}""",
)
def risk_detail(spark, sf):
    found = stored_findings(spark, sf)
    return reports.risk_detail(workspace_scores(spark, sf, found), found, as_of())


@register(
    "risk_report",
    f"""WITH {o.SCAN}, {o.SCORES}, picked AS (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {o.REPORT_ORDER}) AS rank FROM findings WHERE severity <> 'low'),
top AS (
  SELECT project_id, string_agg('{{"ruleId":"' || rule_id || '","severity":"' || severity || '","message":' || to_json(message) ||
    ',"filePath":' || to_json(path) || '}}', ',' ORDER BY rank) AS risks FROM picked WHERE rank <= 3 GROUP BY project_id)
SELECT project_id, {_RISK_HEAD} || ',"topRisks":[' || coalesce(risks, '') || ']}}' AS text FROM scores LEFT JOIN top USING (project_id)""",
)
def risk_report(spark, sf):
    found = stored_findings(spark, sf)
    scores = workspace_scores(spark, sf, found)
    return reports.risk_summary_json(reports.risk_summary(scores, found), as_of())


_LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' END"


@register(
    "sarif_results",
    f"""WITH {o.SCAN}, {o.BUILT_IN}
SELECT project_id, f.rule_id, {_LEVEL.replace('severity', 'f.severity')} AS level, message, replace(path, chr(92), '/') AS uri,
  coalesce(line, 1) AS start_line, 1 AS start_column, b.rule_ordinal - 1 AS rule_index, seq
FROM findings f LEFT JOIN built_in b USING (rule_id)""",
)
def sarif_results(spark, sf):
    rows = reports.sarif_results(workspace_findings(spark, sf), Rulebook().table(spark))
    return rows.select(
        "project_id",
        "rule_id",
        "level",
        "message",
        "uri",
        "start_line",
        "start_column",
        "rule_index",
        "seq",
    )


_SARIF_RULES = (
    f"""SELECT string_agg('{{"id":"' || rule_id || '","shortDescription":{{"text":' || to_json(name) || '}},"fullDescription":{{"text":' """
    f"""|| to_json(description) || '}},"defaultConfiguration":{{"level":"' || {_LEVEL} || '"}},"properties":{{"category":"' || category || '"}}}}', """
    """',' ORDER BY rule_ordinal) AS rules FROM built_in"""
)


@register(
    "sarif_document",
    f"""WITH {o.SCAN}, {o.INDEXED}, {o.BUILT_IN}, rule_list AS ({_SARIF_RULES})
SELECT project_id, unnest([0, 2]) AS section, 0 AS item, unnest(['{{"$schema":"{reports.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":'
  || '{{"driver":{{"name":"{reports.TOOL_NAME}","version":"{reports.TOOL_VERSION}","rules":[' || (SELECT rules FROM rule_list) || ']}}}},"results":[',
  ']}}]}}']) AS text FROM (SELECT DISTINCT project_id FROM all_files)
UNION ALL SELECT project_id, 1, finding_index, CASE WHEN finding_index > 0 THEN ',' ELSE '' END ||
  '{{"ruleId":"' || rule_id || '","level":"' || {_LEVEL} || '","message":{{"text":' || to_json(message) ||
  '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(path) || ',"uriBaseId":"%SRCROOT%"}},"region":{{"startLine":'
  || coalesce(line, 1) || ',"startColumn":1}}}}}}],"ruleIndex":' || (rule_ordinal - 1) || '}}' FROM indexed""",
)
def sarif_document(spark, sf):
    found = stored_findings(spark, sf)
    projects = workspace_names(spark, sf).select("project_id").distinct()
    return reports.sarif_report(projects, found, Rulebook().table(spark))


@register(
    "html_payload",
    f"""WITH {o.SCAN}, {o.INDEXED}, {o.BUILT_IN}
SELECT project_id, unnest([0, 2]) AS section, 0 AS item, unnest(['[', ']']) AS text FROM (SELECT DISTINCT project_id FROM all_files)
UNION ALL SELECT project_id, 1, finding_index, CASE WHEN finding_index > 0 THEN ',' ELSE '' END || replace(replace(
  '{{"idx":' || finding_index || ',"severity":"' || i.severity || '","ruleId":"' || rule_id || '","filePath":' || to_json(path) ||
  ',"line":' || coalesce(line, 0) || ',"message":' || to_json(message) || ',"category":"' || i.category || '","ruleDescription":' ||
  to_json(coalesce(b.description, '')) || '}}', '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e')
FROM indexed i LEFT JOIN built_in b USING (rule_id)""",
)
def html_payload(spark, sf):
    found = stored_findings(spark, sf)
    projects = workspace_names(spark, sf).select("project_id").distinct()
    return reports.html_payload(projects, found, Rulebook().table(spark))


@register(
    "score_labels",
    f"""WITH {o.LOG} SELECT project_id, ts, score::INT AS score,
  CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 80 THEN 'LOW RISK' WHEN score >= 60 THEN 'MODERATE'
    WHEN score >= 40 THEN 'HIGH RISK' ELSE 'CRITICAL' END AS label,
  concat_ws('|', CASE WHEN critical > 0 THEN 'URGENT: Fix critical issues before deployment' END,
    CASE WHEN medium > 0 THEN 'Schedule fixes for medium severity issues' END,
    CASE WHEN low > 0 THEN 'Address low priority issues when convenient' END,
    CASE WHEN critical + medium + low = 0 THEN 'Maintain secure coding practices' END) AS advice FROM scan_log""",
)
def score_labels(spark, sf):
    labelled = reports.score_labels(corpus.scan_log(spark, sf))
    return labelled.select(
        "project_id",
        "ts",
        F.col("score").cast("int").alias("score"),
        "label",
        F.array_join("advice", "|").alias("advice"),
    )


@register(
    "clamped_scores",
    """SELECT event_id, CASE WHEN value IS NULL OR isnan(v) OR isinf(v) THEN 0 ELSE greatest(0, least(100, floor(v + 0.5)))::INT END AS shown
FROM (SELECT *, CASE event_id % 50 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN -value ELSE value END AS v FROM events)""",
)
def clamped_scores(spark, sf):
    kind = F.col("event_id") % 50
    v = (
        F.when(kind == 0, float("nan"))
        .when(kind == 1, float("inf"))
        .when(kind == 2, -F.col("value"))
        .otherwise(F.col("value"))
    )
    return corpus.table(spark, sf, "events").select(
        "event_id", scalars.clamp_percent(v, 0).alias("shown")
    )


@register(
    "html_escape",
    """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped,
  replace(url, chr(92), '/') AS uri FROM pages""",
)
def html_escape(spark, sf):
    return corpus.table(spark, sf, "pages").select(
        "page_id",
        scalars.html_escape(F.col("html")).alias("escaped"),
        scalars.to_uri(F.col("url")).alias("uri"),
    )


@register(
    "readiness_class",
    """SELECT conv_id, turn, CASE WHEN contains(lower(text), 'ready') OR contains(lower(text), 'safe') THEN 'go'
  WHEN contains(lower(text), 'caution') OR contains(lower(text), 'moderate') THEN 'hold' ELSE 'stop' END AS class
FROM (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' Not Ready' WHEN 1 THEN ' use CAUTION' ELSE '' END AS text FROM conversations)""",
)
def readiness_class(spark, sf):
    kind = F.col("turn") % 4
    note = F.when(kind == 0, " Not Ready").when(kind == 1, " use CAUTION").otherwise("")
    return corpus.table(spark, sf, "conversations").select(
        "conv_id", "turn", scalars.readiness_class(F.concat("text", note)).alias("class")
    )


# --- fixes ---------------------------------------------------------------------------------------


@register("env_template", f"WITH {o.SCAN}, {o.FIXES}, {o.TEMPLATE} SELECT project_id, k, text FROM template_lines")
def env_template(spark, sf):
    return fixes.env_template(corpus.workspace(spark, sf), corpus.workspace_listing(spark, sf))


@register(
    "env_placeholders",
    """SELECT c_custkey, CASE WHEN regexp_matches(k, '(?i)password|secret|key|token|private|api_key|auth')
  THEN 'YOUR_' || regexp_replace(upper(k), '[^A-Z0-9]', '_', 'g') || '_HERE'
  ELSE 'your_' || regexp_replace(lower(k), '[^a-z0-9]', '_', 'g') || '_here' END AS placeholder
FROM (SELECT c_custkey, c_name || CASE c_custkey % 3 WHEN 0 THEN '.ApiKey' WHEN 1 THEN '-auth' ELSE '' END AS k FROM customer)""",
)
def env_placeholders(spark, sf):
    kind = F.col("c_custkey") % 3
    key = F.concat("c_name", F.when(kind == 0, ".ApiKey").when(kind == 1, "-auth").otherwise(""))
    return corpus.table(spark, sf, "customer").select(
        "c_custkey", scalars.env_placeholder(key).alias("placeholder")
    )


@register(
    "logging_note",
    f"WITH {o.SCAN}, {o.FIXES}, {o.NOTE} SELECT project_id, k, text FROM note_lines",
)
def logging_note(spark, sf):
    found = stored_findings(spark, sf)
    return fixes.logging_note(found, corpus.workspace_listing(spark, sf), as_of())


@register(
    "docker_fix",
    f"""WITH {o.WORKSPACE}, {o._DOCKER}, {o.raw_lines('files')}
SELECT project_id, path, string_agg(raw, {o.NL} ORDER BY line) AS content
FROM lines JOIN docker_edits USING (project_id, path) WHERE NOT regexp_matches(raw, {o.q(f'(?i)^{o.WS}*EXPOSE{o.WS}+5432')})
GROUP BY project_id, path""",
)
def docker_fix(spark, sf):
    edits = fixes.docker_edits(scan.scannable(corpus.workspace(spark, sf)))
    kept = F.array_join(fixes.kept_lines(F.col("old"), F.col("removed")), "\n")
    return edits.select("project_id", "path", kept.alias("content"))


@register(
    "fix_suggestions",
    f"""WITH {o.SCAN}, {o.FIXES} SELECT project_id, n, path, rule_id, description, can_auto_apply FROM suggested""",
)
def fix_suggestions(spark, sf):
    return suggested(spark, sf)[0].select(
        "project_id", "n", "path", "rule_id", "description", "can_auto_apply"
    )


def suggested(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    files = fixes.fixable_files(scan.scannable(corpus.workspace(spark, sf)))
    files = storage.settle(files)
    listing = corpus.workspace_listing(spark, sf)
    found = stored_findings(spark, sf)
    return fixes.suggestions(files, listing, found), files, listing, found


@register(
    "fix_split",
    f"""WITH {o.SCAN}, {o.FIXES} SELECT project_id, count(*) FILTER (can_auto_apply) AS automatic,
  count(*) FILTER (NOT can_auto_apply) AS manual FROM suggested GROUP BY project_id""",
)
def fix_split(spark, sf):
    return suggested(spark, sf)[0].groupBy("project_id").agg(
        F.count_if("can_auto_apply").alias("automatic"),
        F.count_if(~F.col("can_auto_apply")).alias("manual"),
    )


def all_patch_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    every, files, listing, found = suggested(spark, sf)
    return every, fixes.patch_lines(files, listing, found, as_of())


def stored_bundle(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suggestions, the patch document made of them and the findings, from stored tables."""
    every, files, listing, found = suggested(spark, sf)
    lines = fixes.patch_lines(files, listing, found, as_of())
    every, lines = storage.settle(every), storage.settle(lines)
    projects = workspace_names(spark, sf).select("project_id")
    return every, fixes.patch_bundle(projects, every, lines, as_of()), found


@register(
    "new_file_patches",
    f"""WITH {o.SCAN}, {o.FIXES}, {o.TEMPLATE}, {o.NOTE}, {o.NEW_PATCHES}
SELECT project_id, path, line_no, text FROM new_patches""",
)
def new_file_patches(spark, sf):
    _, lines = all_patch_lines(spark, sf)
    return lines.where("fix_ordinal < 3").select("project_id", "path", "line_no", "text")


@register(
    "patched_content",
    f"""WITH {o.SCAN}, {o.FIXES}, {o.TEMPLATE}, {o.NOTE}, {o.NEW_PATCHES}
SELECT project_id, path, k + 3 AS line_no, text FROM new_contents""",
)
def patched_content(spark, sf):
    every, lines = all_patch_lines(spark, sf)
    return fixes.fixed_files(every, lines).select("project_id", "path", "line_no", "text")


@register(
    "edit_patches",
    f"""WITH {o.SCAN}, {o.FIXES}, {o.EDIT_PATCHES} SELECT project_id, path, line_no, text FROM edit_patches""",
)
def edit_patches(spark, sf):
    _, lines = all_patch_lines(spark, sf)
    return lines.where("fix_ordinal = 3").select("project_id", "path", "line_no", "text")


_BUNDLE = f"WITH {o.SCAN}, {o.SCORES}, {o.FIXES}, {o.TEMPLATE}, {o.NOTE}, {o.NEW_PATCHES}, {o.EDIT_PATCHES}, {o.BUNDLE}"


@register("patch_bundle", f"{_BUNDLE} SELECT project_id, n, line_no, text FROM bundle")
def patch_bundle(spark, sf):
    return stored_bundle(spark, sf)[1]


@register(
    "patch_banners",
    f"""WITH {o.SCAN}, {o.FIXES}
SELECT project_id, n, '# Fix ' || n || '/' || total || ': ' || rule_id AS title FROM suggested""",
)
def patch_banners(spark, sf):
    bundle = stored_bundle(spark, sf)[1]
    return bundle.where("n > 0 AND line_no = 1").select(
        "project_id", "n", F.col("text").alias("title")
    )


_FIX_HEAD = (
    """'{"timestamp":"2024-06-01T12:00:00.000Z","path":"' || project_id || '","provider":"none","summary":{"critical":' """
    """|| critical || ',"medium":' || medium || ',"low":' || low || '},"patch":"'"""
)


@register(
    "fix_json",
    f"""{_BUNDLE}
SELECT project_id, unnest([0, 2, 4]) AS section, 0 AS item, 0 AS part,
  unnest([{_FIX_HEAD}, '","suggestions":[', ']}}']) AS text FROM scores
UNION ALL SELECT project_id, 1, n, line_no, CASE WHEN n = 0 AND line_no = 0 THEN '' ELSE '\\n' END ||
  substr(to_json(text)::VARCHAR, 2, length(to_json(text)::VARCHAR) - 2) FROM bundle
UNION ALL SELECT project_id, 3, n, 0, CASE WHEN n > 1 THEN ',' ELSE '' END || '{{"ruleId":"' || rule_id || '","filePath":' ||
  to_json(path) || ',"description":' || to_json(description) || ',"canAutoApply":' || can_auto_apply || '}}' FROM suggested""",
)
def fix_json(spark, sf):
    every, bundle, found = stored_bundle(spark, sf)
    return fixes.fix_report(workspace_scores(spark, sf, found), every, bundle, as_of())


@register(
    "targeted_fix",
    f"""WITH {o.WORKSPACE}, {o.stripped_lines('files')}, {o.findings(o.HITS['docker-expose-postgres'])}, {o.FIXES}
SELECT project_id, n, path, rule_id, can_auto_apply FROM suggested WHERE project_id IN (SELECT project_id FROM findings)""",
)
def targeted_fix(spark, sf):
    files = scan.scannable(corpus.workspace(spark, sf))
    listing = corpus.workspace_listing(spark, sf)
    made = fixes.targeted_suggestions(files, listing, "docker-expose-postgres")
    return made.select("project_id", "n", "path", "rule_id", "can_auto_apply")


# --- history -------------------------------------------------------------------------------------


@register(
    "scan_history_top10",
    f"""WITH {o.LOG}, placed AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC) AS place FROM scan_log)
SELECT project_id, place, ts, score::INT AS score, files_scanned::INT AS files_scanned FROM placed WHERE place <= 10""",
)
def scan_history_top10(spark, sf):
    last = history.last_scans(history.history_entries(corpus.scan_log(spark, sf)))
    return last.select("project_id", "place", "ts", "score", "files_scanned")


def _now(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.table(spark, sf, "events").agg(F.max("ts"))


@register(
    "latest_fresh_scan",
    f"""WITH {o.LOG}, now AS (SELECT max(ts) AS t FROM events), newest AS (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC) AS rn FROM scan_log)
SELECT project_id, CASE WHEN fresh THEN ts END AS ts, CASE WHEN fresh THEN score::INT END AS score,
  CASE WHEN fresh THEN critical::INT END AS critical, CASE WHEN fresh THEN files_scanned::INT END AS files_scanned
FROM (SELECT *, (SELECT t FROM now) - ts <= INTERVAL 30 MINUTE AS fresh FROM newest WHERE rn = 1)""",
)
def latest_fresh_scan(spark, sf):
    log = corpus.scan_log(spark, sf)
    latest = history.latest_fresh(
        log.select("project_id"), history.history_entries(log), _now(spark, sf).scalar()
    )
    return latest.select(
        "project_id", "ts", "score", F.col("summary.critical").alias("critical"), "files_scanned"
    )


_LATEST = f"""{o.SCAN}, {o.LOG}, now AS (SELECT max(ts) AS t FROM events), newest AS (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC) AS rn FROM scan_log),
latest AS (SELECT *, (SELECT t FROM now) - ts <= INTERVAL 30 MINUTE AS fresh FROM newest WHERE rn = 1),
shown AS (
  SELECT 'u' || substr(project_id, 2) AS project_id, row_number() OVER (PARTITION BY project_id ORDER BY {o.REPORT_ORDER}) - 1 AS item,
    {_FINDING_JSON} AS json FROM findings)"""


@register(
    "latest_scan_view",
    f"""WITH {_LATEST}
SELECT project_id, unnest([0, 2]) AS section, 0 AS item, unnest(['{{"score":' || score || ',"path":"' || project_id || '","scannedAt":"' ||
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '","summary":{{"critical":' || critical || ',"medium":' || medium || ',"low":' || low ||
  '}},"findings":[', '],"metadata":{{"filesScanned":' || files_scanned || '}}}}']) AS text FROM latest WHERE fresh
UNION ALL SELECT project_id, 0, 0, '{{"message":"No scan results available. Run a scan first."}}' FROM latest WHERE NOT fresh
UNION ALL SELECT project_id, 1, item, CASE WHEN item > 0 THEN ',' ELSE '' END || json
FROM shown WHERE project_id IN (SELECT project_id FROM latest WHERE fresh)""",
)
def latest_scan_view(spark, sf):
    log = corpus.scan_log(spark, sf)
    latest = history.latest_fresh(
        log.select("project_id"), history.history_entries(log), _now(spark, sf).scalar()
    )
    found = stored_findings(spark, sf).withColumn(
        "project_id", F.concat(F.lit("u"), F.substring("project_id", 2, 9))
    )
    return reports.latest_scan_view(latest, found)


@register(
    "history_append",
    f"""WITH {o.LOG} SELECT project_id, ts, score::INT AS score, critical::INT AS critical, medium::INT AS medium, low::INT AS low,
  files_scanned::INT AS files_scanned FROM scan_log""",
)
def history_append(spark, sf):
    path = storage.fresh_path(spark, "history")
    log = corpus.scan_log(spark, sf)
    good = F.col("score") >= 50
    history.append_history(log.where(good), path)
    history.append_history(log.where(~good), path)
    return history.read_history(spark, path).select(
        "project_id", "ts", "score", "summary.critical", "summary.medium", "summary.low", "files_scanned"
    )


# --- reviews -------------------------------------------------------------------------------------


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a reviewer in eight forms, one per assistant turn."""
    from pyspark.sql import Window

    conv, turn, form = F.col("conv_id"), F.col("turn"), F.col("form")
    text_of = lambda c: c.cast("string")
    score10 = (conv * 7 + turn * 3) % 101
    cvss = F.concat(text_of(F.floor(score10 / 10)), F.lit("."), text_of(score10 % 10))
    json = F.concat(
        F.lit('{"severity":"'),
        F.when(turn % 3 == 0, "critical").when(turn % 3 == 1, "medium").otherwise("low"),
        F.lit('","cvss":'),
        F.when(form == 5, "11").otherwise(cvss),
        F.when(form == 3, "")
        .when(form == 4, ',"impact":null')
        .otherwise(F.concat(F.lit(',"impact":"impact '), text_of(conv), F.lit('"'))),
        F.lit(',"exploitability":"step '),
        text_of(turn),
        F.lit('","remediation":"fix '),
        text_of(conv),
        F.lit("-"),
        text_of(turn),
        F.lit('","falsePositiveRisk":"'),
        F.when(form == 6, "none").otherwise("low"),
        F.lit('","extra":[1,{"a":2}]}'),
    )
    w = Window.partitionBy("conv_id").orderBy("turn")
    return (
        corpus.table(spark, sf, "conversations")
        .where("role = 'assistant'")
        .withColumn("form", (conv + turn) % 8)
        .withColumn("finding_index", (F.row_number().over(w) - 1).cast("bigint"))
        .withColumn("json", json)
        .select(
            F.concat(F.lit("c"), text_of(conv)).alias("project_id"),
            "finding_index",
            "conv_id",
            "turn",
            "form",
            F.when(form == 1, F.concat(F.lit("Here:\n```json\n"), "json", F.lit("\n``` done")))
            .when(form == 2, F.concat(F.lit("```\n"), "json", F.lit("\n```")))
            .when(form == 7, F.col("text"))
            .otherwise(F.col("json"))
            .alias("response"),
        )
    )


@register(
    "review_validate",
    f"""WITH {o.ANSWERS} SELECT project_id, finding_index, valid, severity, cvss, impact, exploitability, remediation, "falsePositiveRisk" FROM analyses""",
)
def review_validate(spark, sf):
    checked = review.parse_answer(answers(spark, sf), review.ANALYSIS)
    return checked.select(
        "project_id", "finding_index", "valid", *[f.name for f in review.ANALYSIS]
    )


@register(
    "fenced_json",
    f"WITH {o.ANSWERS} SELECT conv_id, turn, trim(CASE WHEN form = 7 THEN text ELSE json END, ' ' || chr(9) || chr(10) || chr(13)) AS json FROM answers JOIN turns USING (conv_id, turn, form)",
)
def fenced_json(spark, sf):
    return answers(spark, sf).select(
        "conv_id", "turn", scalars.fenced_json(F.col("response")).alias("json")
    )


@register(
    "review_requests",
    f"""WITH {o.SCAN}, {o.INDEXED}
SELECT project_id, finding_index, finding_index // 10 AS batch, payload, ceil(length(payload) / 4)::BIGINT AS token_estimate
FROM (SELECT *, {_FINDING_JSON} AS payload FROM indexed)""",
)
def review_requests(spark, sf):
    return review.analysis_requests(stored_findings(spark, sf))


_FILLED = f"""filled AS (
  SELECT project_id, finding_index, conv_id, turn,
    CASE WHEN form = 7 THEN 'medium' ELSE severity END AS severity, CASE WHEN form = 7 THEN 0 ELSE cvss END AS cvss,
    CASE WHEN form = 7 THEN 'Analysis failed — manual review recommended' ELSE impact END AS impact,
    CASE WHEN form = 7 THEN 'Unknown' ELSE exploitability END AS exploitability,
    CASE WHEN form = 7 THEN 'Review finding manually' ELSE remediation END AS remediation,
    CASE WHEN form = 7 THEN 'medium' ELSE "falsePositiveRisk" END AS "falsePositiveRisk"
  FROM analyses JOIN (SELECT project_id, finding_index, conv_id, turn, form FROM answers) USING (project_id, finding_index))"""


def filled_analyses(spark: SparkSession, sf: str) -> DataFrame:
    given = answers(spark, sf)
    checked = review.parse_answer(given.where("form <> 7"), review.ANALYSIS)
    return review.fill_failed(given.select("project_id", "finding_index"), checked)


@register(
    "review_failure_fill",
    f"""WITH {o.ANSWERS}, {_FILLED}
SELECT project_id, finding_index, severity, cvss, impact, exploitability, remediation, "falsePositiveRisk" FROM filled""",
)
def review_failure_fill(spark, sf):
    return filled_analyses(spark, sf)


def ranking_answers(spark: SparkSession, sf: str) -> DataFrame:
    """One ranking answer per conversation; some rank a finding that does not exist."""
    given = answers(spark, sf)
    entry = F.struct(
        F.col("finding_index"),
        F.concat(
            F.lit('{"findingIndex":'),
            F.col("finding_index").cast("string"),
            F.lit(',"priority":'),
            ((F.col("turn") * 5 + F.col("conv_id")) % 4).cast("string"),
            F.lit(',"reasoning":"turn '),
            F.col("turn").cast("string"),
            F.lit('"}'),
        ).alias("text"),
    )
    ghost = F.when(
        F.col("conv_id") % 3 == 0, ',{"findingIndex":99,"priority":0,"reasoning":"ghost"}'
    ).otherwise("")
    return (
        given.groupBy("project_id", "conv_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(
            "project_id",
            F.concat(
                F.lit('{"rankings":['),
                F.array_join(F.transform("entries", lambda e: e["text"]), ","),
                ghost,
                F.lit('],"overallScore":'),
                F.when(F.col("conv_id") % 7 == 0, "150").otherwise("50"),
                F.lit(',"shipReadiness":"Ready after '),
                F.col("conv_id").cast("string"),
                F.lit('"}'),
            ).alias("response"),
        )
    )


_RANKED = f"""{_FILLED},
ranks AS (
  SELECT project_id, conv_id, finding_index, (turn * 5 + conv_id) % 4 AS priority, 'turn ' || turn AS reasoning, finding_index AS place
  FROM filled WHERE conv_id % 7 <> 0 UNION ALL
  SELECT 'c' || conv_id, conv_id, 99, 0, 'ghost', 1000 FROM (SELECT DISTINCT conv_id FROM answers) WHERE conv_id % 3 = 0 AND conv_id % 7 <> 0),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority, place) AS rank FROM ranks) WHERE rank <= 3),
texts AS (
  SELECT b.project_id, rank, coalesce('[CVSS ' || CASE WHEN f.cvss = floor(f.cvss) THEN f.cvss::BIGINT::VARCHAR ELSE f.cvss::VARCHAR END
      || '] Finding ' || f.conv_id || '/' || f.turn || ' — ' || b.reasoning, b.reasoning) AS risk,
    coalesce(f.remediation, 'Review finding manually') AS fix
  FROM best b LEFT JOIN filled f ON f.project_id = b.project_id AND f.finding_index = b.finding_index),
gathered AS (
  SELECT project_id, string_agg(risk, '|' ORDER BY rank) AS risks, string_agg(fix, '|' ORDER BY rank) AS fixes FROM texts GROUP BY project_id),
everyone AS (SELECT DISTINCT conv_id, 'c' || conv_id AS project_id FROM conversations)"""


@register(
    "review_result",
    f"""WITH {o.ANSWERS}, {_RANKED}
SELECT project_id, coalesce(risks, '') AS risks, coalesce(fixes, '') AS fixes,
  CASE WHEN project_id NOT IN (SELECT project_id FROM answers) THEN 'No findings detected. Safe to ship.'
    WHEN conv_id % 7 = 0 THEN 'Unable to determine ship readiness.' ELSE 'Ready after ' || conv_id END AS readiness
FROM everyone LEFT JOIN gathered USING (project_id)""",
)
def review_result(spark, sf):
    given = answers(spark, sf)
    indexed = given.select(
        "project_id",
        "finding_index",
        F.concat(F.lit("Finding "), "conv_id", F.lit("/"), "turn").alias("message"),
    )
    ranked = review.parse_answer(ranking_answers(spark, sf), review.RANKING)
    projects = corpus.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("project_id")
    )
    result = review.review_result(projects, indexed, filled_analyses(spark, sf), ranked)
    return result.select(
        "project_id",
        F.array_join("prioritizedRisks", "|").alias("risks"),
        F.array_join("quickFixes", "|").alias("fixes"),
        F.col("shipReadiness").alias("readiness"),
    )


@register(
    "ranking_request",
    f"""WITH {o.ANSWERS}, {_FILLED}
SELECT project_id, unnest([0, 2]) AS section, 0 AS item, unnest(['[', ']']) AS text FROM (SELECT DISTINCT project_id FROM answers)
UNION ALL SELECT project_id, 1, place, CASE WHEN place > 0 THEN ',' ELSE '' END || '{{"index":' || place ||
  ',"finding":{{"filePath":"t' || lpad(turn::VARCHAR, 6, '0') || '","line":' || turn || ',"severity":"low","message":' || to_json(response) ||
  ',"ruleId":"review","category":"review"}},"analysis":{{"severity":"' || severity || '","cvss":' || cvss::DOUBLE::VARCHAR ||
  ',"impact":"' || impact || '","exploitability":"' || exploitability || '","remediation":"' || remediation ||
  '","falsePositiveRisk":"' || "falsePositiveRisk" || '"}}}}'
FROM (SELECT a.project_id, a.turn, a.response, f.severity, f.cvss, f.impact, f.exploitability, f.remediation, f."falsePositiveRisk",
    a.finding_index AS place
  FROM answers a JOIN filled f ON f.project_id = a.project_id AND f.finding_index = a.finding_index)""",
)
def ranking_request(spark, sf):
    given = answers(spark, sf)
    found = given.select(
        "project_id",
        F.concat(F.lit("t"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("path"),
        F.col("turn").cast("int").alias("line"),
        F.lit("low").alias("severity"),
        F.col("response").alias("message"),
        F.lit("review").alias("rule_id"),
        F.lit("review").alias("category"),
        F.lit(1).alias("rule_ordinal"),
        F.col("turn").cast("int").alias("seq"),
    )
    return review.ranking_request(storage.settle(found), storage.settle(filled_analyses(spark, sf)))


@register(
    "review_usage",
    """SELECT role AS provider, sum(ceil(length(text) / 4))::BIGINT AS input, sum(length(text))::BIGINT AS output,
  sum(length(text) * 0.5)::DOUBLE AS cost FROM conversations GROUP BY role""",
)
def review_usage(spark, sf):
    usage = corpus.table(spark, sf, "conversations").select(
        F.col("role").alias("provider"),
        scalars.token_estimate(F.col("text")).alias("input"),
        F.length("text").cast("bigint").alias("output"),
        (F.length("text") * F.lit(0.5)).alias("cost"),
    )
    return review.usage_totals(usage)


@register(
    "fix_response_fill",
    """SELECT conv_id, turn, CASE WHEN form = 2 THEN false ELSE true END AS valid,
  CASE WHEN form = 0 THEN 'src/t' || turn || '.ts' ELSE 'found/' || conv_id || '.ts' END AS "filePath",
  CASE WHEN form = 2 THEN 0 ELSE 0.5 END::DOUBLE AS confidence
FROM (SELECT *, (conv_id + turn) % 4 AS form FROM conversations)""",
)
def fix_response_fill(spark, sf):
    form = (F.col("conv_id") + F.col("turn")) % 4
    path = F.concat(F.lit('"filePath":"src/t'), "turn", F.lit('.ts",'))
    response = F.concat(
        F.lit("{"),
        F.when(form == 0, path).when(form == 1, '"filePath":"",').otherwise(""),
        F.lit('"patch":"p","confidence":'),
        F.when(form == 2, "2").otherwise("0.5"),
        F.lit("}"),
    )
    given = (
        corpus.table(spark, sf, "conversations")
        .select(
            "conv_id",
            "turn",
            F.concat(F.lit("found/"), "conv_id", F.lit(".ts")).alias("finding_path"),
            response.alias("response"),
        )
    )
    filled = review.fill_fix_paths(review.parse_answer(given, review.FIX))
    return filled.select("conv_id", "turn", "valid", "filePath", "confidence")


@register(
    "suggested_rules",
    """WITH s AS (SELECT conv_id, turn, unnest([0, 1]) AS place FROM conversations WHERE (conv_id + turn) % 5 <> 0)
SELECT 'rule-' || conv_id || '-' || turn || '-' || place AS rule_id,
  CASE WHEN (turn + place) % 4 = 3 THEN 'unknown severity' WHEN place = 1 AND turn % 2 = 0 THEN 'no usable pattern' ELSE '' END AS reason FROM s""",
)
def suggested_rules(spark, sf):
    conv, turn = F.col("conv_id"), F.col("turn")

    def rule(place: int) -> Column:
        pattern = F.when(turn % 2 == 0, "(broken").otherwise("leak") if place else F.lit("track\\\\(")
        severity = (turn + place) % 4
        return F.concat(
            F.lit('{"id":"rule-'),
            conv.cast("string"),
            F.lit("-"),
            turn.cast("string"),
            F.lit(f'-{place}","pattern":"'),
            pattern,
            F.lit('","severity":"'),
            F.when(severity == 0, "critical")
            .when(severity == 1, "medium")
            .when(severity == 2, "low")
            .otherwise("urgent"),
            F.lit('","description":"d"}'),
        )

    gap = F.when((conv + turn) % 5 == 0, "5").otherwise('"none"')
    response = F.concat(
        F.lit('{"suggestedRules":['), rule(0), F.lit(","), rule(1), F.lit('],"coverageGap":'), gap, F.lit("}")
    )
    given = (
        corpus.table(spark, sf, "conversations")
        .select("conv_id", "turn", response.alias("response"))
    )
    checked = review.parse_answer(given, review.SUGGESTED_RULES)
    admitted, rejected = rulebook.admit_rules(
        review.suggested_rule_table(checked, ["conv_id", "turn"])
    )
    return admitted.select("rule_id", F.lit("").alias("reason")).unionByName(
        rejected.select("rule_id", "reason")
    )


# --- pluggable rules and streams -----------------------------------------------------------------


def _long_lines(path: str, content: str):
    for i, line in enumerate(content.split("\n")):
        if len(line) > 400:
            yield i + 1, None, f"Line of {len(line)} characters"


@register(
    "python_rule",
    f"""WITH {o.DOCUMENTS}, {o.raw_lines('files')}
SELECT project_id, path, line, 'low' AS severity, 'Line of ' || length(raw) || ' characters' AS message, 'long-line' AS rule_id
FROM lines WHERE length(raw) > 400""",
)
def python_rule_query(spark, sf):
    found, _ = python_rule(
        corpus.documents(spark, sf), "long-line", "low", "style", (".ts",), _long_lines
    )
    return found.select("project_id", "path", "line", "severity", "message", "rule_id")


_DOC_SCAN_ALL = f"""WITH {o.DOCUMENTS}, env_examples AS (SELECT NULL::VARCHAR AS project_id, NULL::VARCHAR AS path),
{o.stripped_lines('files')}, {o.findings(' UNION ALL '.join(o.HITS.values()))}"""


@register("stream_scan", f"{_DOC_SCAN_ALL} SELECT {o.FINDING_COLUMNS} FROM findings")
def stream_scan(spark, sf):
    """The findings of all rules on documents that arrive as a stream."""
    files = corpus.arriving(spark, sf, "documents").select(
        F.col("source").alias("project_id"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"),
        F.col("text").alias("content"),
    )
    target = storage.fresh_path(spark, "stream")
    query = scan_stream(files, f"{target}/findings", f"{target}/progress")
    query.awaitTermination()
    return spark.read.parquet(f"{target}/findings").drop("batch")


# More queries, in a module of their own.
from checks import mechanisms  # noqa: E402, F401
