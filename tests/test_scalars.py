import datetime
import re

from pyspark.sql import functions as F

from scanloom.functions import paths, scalars
from scanloom.functions.editdiff import removal_hunks
from scanloom.operators import findings, history


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_reach(spark):
    def covers(patterns, path):
        a = one(spark, paths.applies_to(F.lit(path), patterns))
        arr = F.array(*[F.lit(p) for p in patterns]).cast("array<string>")
        assert a == one(spark, paths.applies_to_any(F.lit(path), arr))
        return a

    assert covers([".ts"], "src/INDEX.TS")
    assert not covers([".js"], "a.jsx")
    assert covers([".env"], "app.env")
    assert covers(["Dockerfile"], "a/Dockerfile") and not covers(["Dockerfile"], "Dockerfile.bak")
    assert covers(["config/default.json"], "src/config/default.json")
    assert not covers(["config/default.json"], "src/config/default.json.bak")
    assert not covers([], "a.ts")


def test_scope(spark):
    inside = ["a.ts", "x/.env", "Dockerfile", "p/package.json", "src/core/rule.ts", "rebuild/a.js"]
    outside = [
        "node_modules/a.ts",
        "x/dist/a.js",
        ".git/a.ts",
        ".cfg/a.ts",
        ".hidden.ts",
        "a.TS",
        "src/core/rules/a.ts",
        "x/tests/fixtures/a.ts",
        "notes.md",
        "x.env",
    ]
    df = spark.createDataFrame([(p,) for p in inside + outside], "path string")
    got = [r[0] for r in df.where(paths.in_scan_scope(F.col("path"))).collect()]
    assert got == inside


def test_containment(spark):
    base = F.lit("/srv/app")
    cases = {
        "src/app.ts": True,
        ".": True,
        "../../../etc/passwd": False,
        "/etc/passwd": False,
        "../app/x": True,
        "../app2/x": False,
        "/srv/app/a/../..": False,
    }
    for path, expected in cases.items():
        assert one(spark, paths.is_within(base, F.lit(path))) is expected, path
    assert one(spark, paths.relative_to(F.lit("/srv/app/a/b.ts"), base)) == "a/b.ts"


def test_score(spark):
    for (c, m, low), score in {
        (0, 0, 0): 100,
        (1, 0, 0): 85,
        (0, 3, 0): 82,
        (0, 0, 5): 90,
        (1, 2, 3): 67,
        (7, 0, 0): 0,
    }.items():
        assert one(spark, findings.risk_score(F.lit(c), F.lit(m), F.lit(low))) == score


def test_labels(spark):
    labels = [one(spark, scalars.risk_label(F.lit(s))) for s in (90, 89, 80, 79, 60, 40, 39)]
    assert labels == [
        "EXCELLENT", "LOW RISK", "LOW RISK", "MODERATE", "MODERATE", "HIGH RISK", "CRITICAL",
    ]
    assert one(spark, scalars.readiness_class(F.lit("Not ready"))) == "go"
    assert one(spark, scalars.clamp_percent(F.lit(79.5), 0)) == 80
    assert one(spark, scalars.clamp_percent(F.lit(-3.0), 0)) == 0
    assert one(spark, scalars.clamp_percent(F.lit(float("nan")), 80)) == 80
    assert [one(spark, scalars.sarif_level(F.lit(s))) for s in ("critical", "medium", "low")] == [
        "error", "warning", "note",
    ]


def test_masks_and_placeholders(spark):
    assert one(spark, scalars.mask_secret(F.lit(None).cast("string"))) == "(not set)"
    assert one(spark, scalars.mask_secret(F.lit("12345678"))) == "***"
    assert one(spark, scalars.mask_secret(F.lit("sk-abcdefgh"))) == "sk-a***"
    lines = {
        "API_KEY=abc": "API_KEY=YOUR_API_KEY_HERE",
        "DATABASE_PASSWORD=x=y": "DATABASE_PASSWORD=YOUR_DATABASE_PASSWORD_HERE",
        "APP_NAME=demo": "APP_NAME=your_app_name_here",
        " Api.Token = z": "Api.Token=YOUR_API_TOKEN_HERE",
        "# c=1": "# c=1",
        "=x": "=x",
        "": "",
        "plain": "plain",
    }
    for line, expected in lines.items():
        assert one(spark, scalars.env_template_line(F.lit(line))) == expected


def test_small_text_functions(spark):
    assert one(spark, scalars.html_escape(F.lit("<a b=\"c\">'&"))) == "&lt;a b=&quot;c&quot;&gt;&#039;&amp;"
    assert one(spark, scalars.script_safe(F.lit("</script>"))) == "\\u003c/script\\u003e"
    assert one(spark, scalars.to_uri(F.lit("a\\b"))) == "a/b"
    assert [one(spark, scalars.number_text(F.lit(x))) for x in (9.1, 7.0, 0.0)] == ["9.1", "7", "0"]
    assert one(spark, scalars.token_estimate(F.lit("abcde"))) == 2
    fenced = {
        "x ```json\n{}\n``` y": "{}",
        "```\n[1]\n```": "[1]",
        " {} ": "{}",
        "``````": "``````",
        "```a``` ```json\nb\n```": "b",
    }
    for text, expected in fenced.items():
        assert one(spark, scalars.fenced_json(F.lit(text))) == expected


def test_staleness(spark):
    now = F.lit(datetime.datetime(2024, 1, 1, 12, 0))
    at = lambda m: F.lit(datetime.datetime(2024, 1, 1, 11, m))
    assert one(spark, history.is_stale(at(30), now)) is False
    assert one(spark, history.is_stale(at(29), now)) is True
    assert one(spark, history.is_stale(F.lit(None).cast("timestamp"), now)) is True


def test_removal_hunks(spark):
    def hunks(old, removed):
        df = spark.createDataFrame([(old, removed)], "old array<string>, removed array<int>")
        return df.select(removal_hunks(F.col("old"), F.col("removed"))).first()[0]

    old = [f"l{k}" for k in range(20)]
    assert hunks(old, []) == []
    assert hunks(old, [0]) == ["@@ -1,4 +1,3 @@", "-l0", " l1", " l2", " l3"]
    assert hunks(["a"], [0]) == ["@@ -1,1 +0,0 @@", "-a"]
    # Six lines between two changes share a hunk, seven do not.
    assert [x for x in hunks(old, [2, 9]) if x[0] == "@"] == ["@@ -1,13 +1,11 @@"]
    assert [x for x in hunks(old, [2, 10]) if x[0] == "@"] == ["@@ -1,6 +1,5 @@", "@@ -8,7 +7,6 @@"]
    text = hunks(old, [5, 18])
    assert [x[1:] for x in text if x[0] == "-"] == ["l5", "l18"]
    assert text[-1] == " l19"


def test_removal_hunks_apply(spark):
    import random

    rng = random.Random(1)
    for _ in range(15):
        old = [rng.choice("abc") for _ in range(rng.randint(1, 30))]
        removed = sorted(rng.sample(range(len(old)), rng.randint(0, min(4, len(old)))))
        df = spark.createDataFrame([(old, removed)], "old array<string>, removed array<int>")
        text = df.select(removal_hunks(F.col("old"), F.col("removed"))).first()[0]
        new, at = [], 0
        for line in text:
            if line[0] == "@":
                a, n, b, m = map(int, re.findall("[0-9]+", line))
                new += old[at : a - 1]
                at = a - 1
                assert len(new) == (b - 1 if m else b)
            else:
                assert old[at] == line[1:]
                at += 1
                new += [line[1:]] if line[0] == " " else []
        assert new + old[at:] == [x for k, x in enumerate(old) if k not in removed]
