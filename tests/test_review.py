import json

import pytest
from pyspark.sql import functions as F

from scanloom.operators import review, rulebook

GOOD = {"severity": "high", "cvss": 9.1, "impact": "i", "exploitability": "e", "remediation": "r", "falsePositiveRisk": "low"}
DEFAULT = ("unknown", 0.0, "", "", "", "medium")


def parse(spark, fields, *answers):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, response string")
    out = review.parse_answer(df, fields).orderBy("i").collect()
    return [tuple(r[f.name] for f in fields) for r in out], [r["valid"] for r in out]


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, ("high", 9.1, "i", "e", "r", "low")),
        ({"cvss": 7}, ("high", 7.0, "i", "e", "r", "low")),
        ({"cvss": 1e1, "more": {"x": [1]}}, ("high", 10.0, "i", "e", "r", "low")),
        ({"cvss": 10.5}, DEFAULT),
        ({"cvss": "7"}, DEFAULT),
        ({"cvss": True}, DEFAULT),
        ({"impact": None}, DEFAULT),
        ({"impact": 3}, DEFAULT),
        ({"falsePositiveRisk": "none"}, DEFAULT),
    ],
)
def test_analysis(spark, change, expected):
    values, valid = parse(spark, review.ANALYSIS, json.dumps(GOOD | change))
    assert values == [expected] and valid == [expected != DEFAULT]


def test_shapes_of_answers(spark):
    missing = json.dumps({k: v for k, v in GOOD.items() if k != "impact"})
    values, valid = parse(
        spark, review.ANALYSIS, missing, "{}", "[]", '"x"', "null", "not json", "{} {}", "{},{}",
        "```json\n" + json.dumps(GOOD) + "\n```", None,
    )
    assert values[0] == ("high", 9.1, "", "e", "r", "low")
    assert values[1:8] == [DEFAULT] * 7 and values[8][0] == "high" and values[9] == DEFAULT
    assert valid == [True, True, False, False, False, False, False, False, True, False]


def test_lists(spark):
    ranking = {"rankings": [{"findingIndex": 1, "priority": 2.5, "reasoning": "r", "x": 1}], "overallScore": 50}
    values, _ = parse(
        spark, review.RANKING, json.dumps(ranking), json.dumps(ranking | {"overallScore": 101}),
        '{"rankings": [{"findingIndex": 1, "priority": 2}]}', '{"rankings": []}', '{"rankings": {}}',
    )
    first = values[0][0][0]
    assert (first["findingIndex"], first["priority"], first["reasoning"]) == (1.0, 2.5, "r")
    assert values[0][1:] == (50.0, "Unable to determine ship readiness.", "Unknown")
    assert all(v[0] == [] for v in values[1:])
    values, valid = parse(
        spark, review.REVIEW, '{"prioritizedRisks": ["a"], "quickFixes": []}', '{"prioritizedRisks": ["a", 1]}',
    )
    assert values[0][:2] == (["a"], []) and values[1][0] == [] and valid == [True, False]


def test_result(spark):
    indexed = spark.createDataFrame([("p", 0, "m0"), ("p", 1, "m1"), ("p", 2, "m2")], "project_id string, finding_index long, message string")
    analyses = spark.createDataFrame([("p", 0, 9.1, "fix0"), ("p", 2, 7.0, "fix2")], "project_id string, finding_index long, cvss double, remediation string")
    answer = {
        "rankings": [
            {"findingIndex": 2, "priority": 2, "reasoning": "r2"}, {"findingIndex": 1, "priority": 1, "reasoning": "r1"},
            {"findingIndex": 0, "priority": 1, "reasoning": "r0"}, {"findingIndex": 9, "priority": 3, "reasoning": "r9"},
        ],
        "shipReadiness": "Hold",
    }
    answers = spark.createDataFrame([("p", json.dumps(answer))], "project_id string, response string")
    projects = spark.createDataFrame([("p",), ("clean",)], "project_id string")
    ranked = review.parse_answer(answers, review.RANKING)
    got = {r["project_id"]: r for r in review.review_result(projects, indexed, analyses, ranked).collect()}
    assert got["p"]["prioritizedRisks"] == ["r1", "[CVSS 9.1] m0 — r0", "[CVSS 7] m2 — r2"]
    assert got["p"]["quickFixes"] == ["Review finding manually", "fix0", "fix2"]
    assert got["p"]["shipReadiness"] == "Hold"
    assert got["clean"]["shipReadiness"].startswith("No findings") and got["clean"]["quickFixes"] == []


def test_suggested_rules_and_paths(spark):
    answer = {"suggestedRules": [
        {"id": "a", "pattern": "x+", "severity": "low", "description": "d"},
        {"id": "b", "pattern": "(", "severity": "low", "description": "d"},
        {"id": "a", "pattern": "y", "severity": "critical", "description": "e"},
    ]}
    answers = spark.createDataFrame([(1, json.dumps(answer))], "n int, response string")
    table = review.suggested_rule_table(review.parse_answer(answers, review.SUGGESTED_RULES), ["n"])
    admitted, rejected = rulebook.admit_rules(table)
    assert [(r["rule_id"], r["reason"]) for r in rejected.collect()] == [("b", "no usable pattern")]
    rules = rulebook.compile_rules(rulebook.first_by_id(admitted))
    assert [(r.rule_id, r.severity, r.patterns[0].regex) for r in rules] == [("a", "low", "x+")]
    fixes = spark.createDataFrame([('{"patch": "p"}', "f.ts")], "response string, finding_path string")
    assert review.fill_fix_paths(review.parse_answer(fixes, review.FIX)).first()["filePath"] == "f.ts"
