"""Comment state over ranges, diffs of any two texts, and rules in code in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from scanloom.functions import text
from scanloom.operators import textdiff
from scanloom.operators.linestate import strip_by_line
from scanloom.operators.pluggable import PythonRule, python_rules

# --- comment state -------------------------------------------------------------------------------


@pytest.mark.parametrize("range_lines", [1, 3, 7, 1000])
def test_ranges_equal_whole_text(spark, range_lines):
    rng = random.Random(range_lines)
    pieces = ["/*", "*/", "*/ a /*", "/* a */", "x", "// /*", "'/*'", '"*/', "`", "*/ // /*", ""]
    files = [(f"f{k}" if k else None, "\n".join(rng.choice(pieces) + rng.choice(["", " y"]) for _ in range(rng.randint(1, 40)))) for k in range(30)]
    df = spark.createDataFrame(files, "path string, content string")
    whole = df.select(
        "path",
        F.posexplode(F.arrays_zip(text.split_lines("content").alias("raw"), text.split_lines(text.strip_comments("content")).alias("s"))).alias("line", "l"),
    ).select("path", "line", "l.raw", F.col("l.s").alias("stripped"))
    got = strip_by_line(whole.drop("stripped"), ["path"], range_lines=range_lines)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))


def test_no_window_over_a_whole_file(spark):
    df = spark.range(10).selectExpr("'f' AS path", "id AS line", "'x' AS raw")
    plan = strip_by_line(df, ["path"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line and "from_in" not in line]
    assert windows and all("_range" in w.rsplit("], [", 2)[1] or "_count" in w or "_map" in w for w in windows)


# --- diffs ---------------------------------------------------------------------------------------


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("alphabet", [1, 2, 4, 30])
def test_scripts_are_shortest_and_exact(alphabet):
    rng = random.Random(alphabet)
    for _ in range(300):
        a = [str(rng.randrange(alphabet)) for _ in range(rng.randint(0, 25))]
        b = list(a) if rng.random() < 0.5 else [str(rng.randrange(alphabet)) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.choice([0, 1])] = [str(rng.randrange(alphabet + 2))] * rng.choice([0, 1, 2])
        pairs = textdiff.kept_lines(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) == longest_common(a, b)
        patch = textdiff.hunks(a, b)
        assert textdiff.applied(a, patch) == b
        assert textdiff.applied(b, textdiff.hunks(b, a)) == a
        assert (patch == []) == (a == b)


def test_hunks_are_standard():
    old = [f"line {k}" for k in range(30)]
    new = [*old[:5], "fresh", *old[5:9], *old[10:20], "LINE 20", *old[21:]]
    assert textdiff.hunks(old, new) == [
        "@@ -3,11 +3,11 @@", " line 2", " line 3", " line 4", "+fresh", " line 5", " line 6", " line 7", " line 8", "-line 9",
        " line 10", " line 11", " line 12",
        "@@ -18,7 +18,7 @@", " line 17", " line 18", " line 19", "-line 20", "+LINE 20", " line 21", " line 22", " line 23",
    ]
    assert textdiff.hunks([], ["a", ""]) == ["@@ -0,0 +1,2 @@", "+a", "+"]
    assert textdiff.hunks(["a"], []) == ["@@ -1,1 +0,0 @@", "-a"]


def test_patches_that_do_not_fit():
    old = ["a", "b", "c"]
    good = textdiff.hunks(old, ["a", "x", "c"])
    assert textdiff.applied(old, ["--- a", "+++ b", *good]) == ["a", "x", "c"]
    assert textdiff.applied(["a", "y", "c"], good) is None
    assert textdiff.applied(old, ["@@ -9,1 +9,1 @@", "-a", "+b"]) is None
    assert textdiff.applied(old, ["@@ nonsense"]) is None
    assert textdiff.applied(old, good[:-1]) is None
    assert textdiff.applied(old, [*good, "trailing"]) is None
    assert textdiff.applied(old, []) == old


def test_large_texts_that_differ_little_or_wholly():
    old = [str(k) for k in range(60_000)]
    new = [x for x in old if x != "30000"] + ["end"]
    assert len(textdiff.kept_lines(old, new)) == 59_999
    assert textdiff.kept_lines(old, [f"n{k}" for k in range(60_000)]) == []


def test_diff_of_tables(spark):
    columns = "project_id string, path string, content string"
    before = spark.createDataFrame([("p", "same", "x"), ("p", "gone", "a\nb"), ("p", "edit", "a\nb\nc"), ("q", "null", None)], columns)
    after = spark.createDataFrame([("p", "same", "x"), ("p", "new", ""), ("p", "edit", "a\nB\nc"), ("q", "null", None)], columns)
    rows = textdiff.diff_files(before, after, F.lit("2024-06-01 12:00:00").cast("timestamp")).orderBy("path", "line_no").collect()
    got = {}
    for r in rows:
        got.setdefault(r.path, []).append(r.text.split("\t")[0])
    assert got == {
        "edit": ["--- a/edit", "+++ b/edit", "@@ -1,3 +1,3 @@", " a", "-b", "+B", " c"],
        "gone": ["--- a/gone", "+++ /dev/null", "@@ -1,2 +0,0 @@", "-a", "-b"],
        "new": ["--- /dev/null", "+++ b/new", "@@ -0,0 +1,1 @@", "+"],
    }
    texts = before.join(after.withColumnRenamed("content", "new"), ["project_id", "path"], "full")
    back = texts.withColumn("got", textdiff.patched("content", textdiff.text_hunks("content", "new")))
    assert back.where("not (got <=> new)").count() == 0


# --- rules in code -------------------------------------------------------------------------------


def test_python_rules(project):
    def fails(path, content):
        yield 1, None, "lost with the failure"
        raise RuntimeError("no")

    def leaves(path, content):
        raise SystemExit("left")

    rules = [
        PythonRule("lines", "low", "size", (".ts", "Dockerfile"), lambda p, c: [(len(c.split("\n")), "", "Lines"), (None, "critical", p)]),
        PythonRule("fails", "low", "c", (".ts",), fails),
        PythonRule("leaves", "low", "c", ("a.ts",), leaves),
        PythonRule("bad", "low", "c", ("/b.ts",), lambda p, c: [("x", None, "m")]),
        PythonRule("none", "low", "c", (".ts",), lambda p, c: None),
        PythonRule("lines", "low", "again", (".ts",), fails),
        PythonRule("no check", "low", "c", (".ts",), None),
    ]
    files = project({"/r/A.TS": "1\n2", "/r/x/b.ts": "1", "/r/Dockerfile": None or "x", "/r/c.py": "1"})
    found = python_rules(files, rules, F.lit("/r"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPythonUDTF") == 1
    rows = found.collect()
    got = {(r.path, r.rule_id, r.seq, r.line, r.severity, r.message, r.rule_ordinal) for r in rows if r.error is None}
    assert got == {
        ("A.TS", "lines", 0, 2, "low", "Lines", 1000), ("A.TS", "lines", 1, None, "critical", "/r/A.TS", 1000),
        ("x/b.ts", "lines", 0, 1, "low", "Lines", 1000), ("x/b.ts", "lines", 1, None, "critical", "/r/x/b.ts", 1000),
        ("Dockerfile", "lines", 0, 1, "low", "Lines", 1000), ("Dockerfile", "lines", 1, None, "critical", "/r/Dockerfile", 1000),
    }
    errors = {(r.path, r.rule_id): r.error for r in rows if r.error is not None}
    assert errors == {
        ("A.TS", "fails"): "Rule fails failed: no", ("x/b.ts", "fails"): "Rule fails failed: no",
        ("A.TS", "leaves"): "Rule leaves failed: left",
        ("x/b.ts", "bad"): "Rule bad failed: invalid literal for int() with base 10: 'x'",
        ("A.TS", "none"): "Rule none failed: 'NoneType' object is not iterable",
        ("x/b.ts", "none"): "Rule none failed: 'NoneType' object is not iterable",
    }


def test_diffs_hold_few_texts_at_a_time(spark):
    """A batch of Arrow holds ten thousand texts and all their lines; rows come in batches of a hundred."""
    from pyspark.util import PythonEvalType

    assert textdiff.text_hunks.evalType == textdiff.patched.evalType == PythonEvalType.SQL_BATCHED_UDF
    texts = spark.createDataFrame([("a\nb", None), (None, "a"), ("a", "a"), ("", None)], "a string, b string")
    got = texts.select(textdiff.text_hunks("a", "b").alias("h")).withColumn("n", F.size("h")).collect()
    assert [r.n for r in got] == [3, 2, 0, 2]
