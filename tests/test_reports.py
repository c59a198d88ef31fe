import datetime
import json

import pytest
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.operators import findings, fixes, history, reports
from scanloom.operators.numbering import number_rows
from scanloom.operators.rulebook import Rulebook
from scanloom.plans import scan, storage


def as_of():
    return F.lit("2024-06-01 12:00:00").cast("timestamp")


def document(parts, project_id="p"):
    order = [c for c in parts.columns if c not in ("project_id", "text")]
    rows = parts.where(F.col("project_id") == project_id).orderBy(*order).collect()
    return "".join(r["text"] for r in rows)


@pytest.fixture
def scanned(project):
    files = project(
        {
            "src/a.ts": "eval(x)\ncors()\n" + "console.log(1)\n" * 6,
            "b/Dockerfile": "FROM x\nRUN a\nRUN b\nRUN c\nEXPOSE 5432 6379\nEXPOSE 5432\nCMD d\nCMD e\nCMD f\nCMD g",
            ".env": "API_KEY=1\nNAME=x\n",
        }
    ).union(project({"a.ts": "fine"}, "clean"))
    found = storage.settle(scan.scan(files))
    scores = findings.with_score(findings.severity_counts(files.select("project_id"), found))
    return files, found, scores


def test_number_rows_in_hot_groups(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        F.pmod(F.xxhash64("id"), 500).alias("a"),
        F.col("id").alias("b"),
    )
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r["a"], r["b"])):
        want[r["b"]] = sum(1 for k in want.values() if k[0] == r["g"])
        want[r["b"]] = (r["g"], want[r["b"]])
    numbered = number_rows(df, ["g"], ["a", "b"], "n")
    assert numbered.columns == ["g", "a", "b", "n"]
    assert {r["b"]: (r["g"], r["n"]) for r in numbered.collect()} == want
    ranged = number_rows(df, ["g"], ["a", "b"], "n")
    assert ranged.count() == 3000


def test_json_report(scanned):
    _, found, scores = scanned
    parts = reports.json_report(scores, found, as_of())
    doc = json.loads(document(parts))
    assert doc["timestamp"] == "2024-06-01T12:00:00.000Z"
    assert doc["summary"] == {"critical": 1, "medium": 5, "low": 1}
    assert (doc["score"], doc["threshold"], doc["passed"]) == (53, 80, False)
    assert [f["ruleId"] for f in doc["findings"]["critical"]] == ["xss-vulnerable"]
    assert list(doc["findings"]["critical"][0]) == ["filePath", "line", "severity", "message", "ruleId", "category"]
    assert "line" not in doc["findings"]["medium"][0] and doc["findings"]["medium"][0]["filePath"] == ".env"
    assert [len(doc["findings"][s]) for s in schemas.SEVERITIES] == [1, 5, 1]
    clean = json.loads(document(parts, "clean"))
    assert clean["score"] == 100 and clean["findings"] == {"critical": [], "medium": [], "low": []}


def test_sarif(spark, scanned):
    files, found, _ = scanned
    projects = files.select("project_id").distinct()
    extra = found.limit(1).withColumn("rule_id", F.lit("unknown")).withColumn("path", F.lit("a\\b"))
    parts = reports.sarif_report(projects, found.unionByName(extra), Rulebook().table(spark))
    doc = json.loads(document(parts))
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and len(run["tool"]["driver"]["rules"]) == 10
    assert run["results"][0]["level"] == "error" and run["results"][0]["ruleIndex"] == 9
    unknown = [r for r in run["results"] if r["ruleId"] == "unknown"][0]
    assert "ruleIndex" not in unknown
    assert unknown["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a/b"
    env = [r for r in run["results"] if r["ruleId"] == "env-missing-example"][0]
    assert env["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 1}
    assert json.loads(document(parts, "clean"))["runs"][0]["results"] == []


def test_html_payload(spark, scanned):
    files, found, scores = scanned
    nasty = found.withColumn("message", F.lit("</script><b>"))
    parts = reports.html_payload(files.select("project_id").distinct(), nasty, Rulebook().table(spark))
    text = document(parts)
    assert "<" not in text and ">" not in text
    rows = json.loads(text)
    assert [r["idx"] for r in rows] == list(range(7)) and rows[0]["message"] == "</script><b>"
    assert rows[0]["ruleDescription"] and rows[1]["line"] == 0
    assert reports.html_header(scores).count() == 2


def test_risk_report(scanned):
    _, found, scores = scanned
    summary = {r["project_id"]: r for r in reports.risk_summary(scores, found).collect()}
    assert [r["ruleId"] for r in summary["p"]["top_risks"]] == ["xss-vulnerable", "env-missing-example", "docker-expose-postgres"]
    assert summary["clean"]["top_risks"] == []
    detail = json.loads(document(reports.risk_detail(scores, found, as_of())))
    assert detail["summary"]["total"] == 7 and len(detail["findings"]["medium"]) == 5


def test_written_documents(spark, scanned, tmp_path):
    _, found, scores = scanned
    target = str(tmp_path / "docs")
    reports.write_documents(reports.json_report(scores, found, as_of()), target)
    files = sorted((tmp_path / "docs" / "project_id=p").glob("part-*"))
    assert json.loads("".join(f.read_text() for f in files))["score"] == 53


def test_fixes(spark, scanned):
    files, found, scores = scanned
    listing = files.select("project_id", "path")
    every = storage.settle(fixes.suggestions(files, listing, found))
    rows = [(r["n"], r["rule_id"], r["path"], r["can_auto_apply"]) for r in every.orderBy("n").collect()]
    assert rows == [
        (1, "env-missing-example", ".env.example", True),
        (2, "logging-migration-note", "LOGGING_MIGRATION_NOTE.md", True),
        (3, "docker-expose-postgres", "b/Dockerfile", False),
        (4, "docker-expose-postgres", "b/Dockerfile", False),
        (5, "docker-expose-postgres", "b/Dockerfile", False),
    ]
    lines = storage.settle(fixes.patch_lines(files, listing, found, as_of()))
    env = [r["text"] for r in lines.where("fix_ordinal = 1").orderBy("line_no").collect()]
    assert env == [
        "--- /dev/null\t2024-06-01 12:00:00",
        "+++ b/.env.example\t2024-06-01 12:00:00",
        "@@ -1,0 +1,7 @@",
        "+# Environment Variables Template",
        "+# Copy this file to .env and fill in your values",
        "+",
        "+API_KEY=YOUR_API_KEY_HERE",
        "+NAME=your_name_here",
        "+",
        "+",
    ]
    docker = [r["text"] for r in lines.where("fix_ordinal = 3").orderBy("line_no").collect()]
    assert docker[2:] == [
        "@@ -2,8 +2,6 @@", " RUN a", " RUN b", " RUN c", "-EXPOSE 5432 6379", "-EXPOSE 5432", " CMD d", " CMD e", " CMD f",
    ]
    content = fixes.fixed_files(every, lines)
    note = [r["text"] for r in content.where("fix_ordinal = 2").orderBy("line_no").collect()]
    assert "| src/a.ts | 6 |" in note and note[-1] == "" and len(note) == 15 + len(fixes.NOTE_FOOTER)
    assert content.where("fix_ordinal = 3").count() == 0

    bundle = storage.settle(fixes.patch_bundle(files.select("project_id"), every, lines, as_of()))
    text = [r["text"] for r in bundle.where("project_id = 'p'").orderBy("n", "line_no").collect()]
    assert text[:3] == ["# scanloom Auto-Fix Patch", "# Generated: 2024-06-01T12:00:00.000Z", "# Total suggestions: 5"]
    assert text[5] == "# Fix 1/5: env-missing-example" and text[10] == "" and text[11] == env[0]
    assert text[11 + len(env) : 14 + len(env)] == ["", "", fixes.BAR]
    clean = [r["text"] for r in bundle.where("project_id = 'clean'").orderBy("n", "line_no").collect()]
    assert clean == [fixes.NO_FIXES, ""]

    report = json.loads(document(fixes.fix_report(scores, every, bundle, as_of())))
    assert report["patch"] == "\n".join(text) and len(report["suggestions"]) == 5
    assert json.loads(document(fixes.fix_report(scores, every, bundle, as_of()), "clean"))["suggestions"] == []


def test_patch_text(spark):
    patch = "--- a\n+++ b\n@@ -1,0 +1,2 @@\n+one\n same\n-gone\n"
    got = spark.range(1).select(fixes.patch_text_content(F.lit(patch))).first()[0]
    assert got == "one\nsame"
    assert spark.range(1).select(fixes.patch_text_content(F.lit("none"))).first()[0] == ""


def test_targeted_fix(scanned):
    files, _, _ = scanned
    listing = files.select("project_id", "path")
    made = fixes.targeted_suggestions(files, listing, "docker-expose-postgres", "b/Dockerfile")
    assert [r["rule_id"] for r in made.orderBy("n").collect()] == ["env-missing-example"] + ["docker-expose-postgres"] * 3
    assert fixes.targeted_suggestions(files, listing, "sql-injection").count() == 0


def test_defaults_of_pluggable_findings(spark, scanned):
    _, found, _ = scanned
    bare = found.where("rule_id = 'xss-vulnerable'").withColumn("severity", F.lit("")).withColumn("category", F.lit(None).cast("string"))
    row = findings.fill_defaults(bare, Rulebook().table(spark)).first()
    assert (row["severity"], row["category"], row["rule_id"]) == ("critical", "xss", "xss-vulnerable")


def test_history(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, 10)
    rows = [("p", start + datetime.timedelta(minutes=i), 81 + i, 0, 1, 2, None if i == 14 else i) for i in range(15)]
    scans = spark.createDataFrame(rows, "project_id string, ts timestamp, score int, critical int, medium int, low int, files_scanned int")
    path = str(tmp_path / "history")
    history.append_history(scans.where("score <= 90"), path)
    history.append_history(scans.where("score > 90"), path)
    entries = history.read_history(spark, path)
    last = [r["score"] for r in history.last_scans(entries).orderBy("place").collect()]
    assert last == list(range(95, 85, -1))
    projects = spark.createDataFrame([("p",), ("q",)], "project_id string")
    at = lambda h, m: F.lit(datetime.datetime(2024, 1, 1, h, m))
    fresh = {r["project_id"]: r for r in history.latest_fresh(projects, entries, at(10, 44)).collect()}
    assert fresh["p"]["score"] == 95 and fresh["p"]["files_scanned"] == 0 and fresh["q"]["score"] is None
    stale = history.latest_fresh(projects, entries, at(10, 45))
    assert stale.where("ts IS NOT NULL").count() == 0
    found = spark.createDataFrame([], schemas.FINDINGS)
    view = reports.latest_scan_view(history.latest_fresh(projects, entries, at(10, 44)), found)
    assert json.loads(document(view))["summary"] == {"critical": 0, "medium": 1, "low": 2}
    assert "message" in json.loads(document(view, "q"))
