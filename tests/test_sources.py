import os

import pytest
from pyspark.sql import functions as F

import scanloom
from scanloom.operators.rulebook import admit_rules, compile_rules
from scanloom.sources import rulefiles, tree


@pytest.fixture
def roots(tmp_path):
    def put(path, content):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())

    put("one/src/a.ts", "eval(x)\n")
    put("one/.env", "A=1")
    put("one/deep/.env", "A=1")
    put("one/deep/.env.example", "")
    put("one/node_modules/x/b.ts", "eval(x)")
    put("one/.git/c.ts", "eval(x)")
    put("one/tests/fixtures/d.ts", "eval(x)")
    put("one/bad.js", b"\xff\xfe cors()")
    put("two/package.json", '{"dependencies": {"colors": "1"}}')
    put("two/big.ts", b"x" * (10 * 1024 * 1024 + 1))
    put("two/notes.md", "")
    os.symlink(tmp_path / "one/src/a.ts", tmp_path / "two/link.ts")
    return [str(tmp_path / "one"), str(tmp_path / "two")]


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_listing(spark, roots, slices):
    rows = tree.list_tree(spark, roots, slices).collect()
    assert {r["project_id"] for r in rows} == set(roots)
    assert sorted((os.path.basename(r["project_id"]), r["path"], r["kind"]) for r in rows) == [
        ("one", ".env", "file"),
        ("one", "bad.js", "file"),
        ("one", "deep/.env", "file"),
        ("one", "deep/.env.example", "file"),
        ("one", "src/a.ts", "file"),
        ("two", "big.ts", "file"),
        ("two", "link.ts", "symlink"),
        ("two", "notes.md", "file"),
        ("two", "package.json", "file"),
    ]


def test_scan_of_a_tree(spark, roots):
    files, listing = scanloom.read_tree(spark, roots)
    name = os.path.basename
    status = {(name(r["project_id"]), r["path"]): r["status"] for r in files.collect()}
    assert status == {
        ("one", ".env"): "ok", ("one", "bad.js"): "ok", ("one", "deep/.env"): "ok", ("one", "src/a.ts"): "ok",
        ("two", "big.ts"): "ok", ("two", "link.ts"): "symlink", ("two", "package.json"): "ok",
    }
    found = sorted((name(r["project_id"]), r["path"], r["rule_id"]) for r in scanloom.scan(files, listing).collect())
    assert found == [
        ("one", ".env", "env-missing-example"),
        ("one", "bad.js", "cors-permissive"),
        ("one", "src/a.ts", "xss-vulnerable"),
        ("two", "package.json", "insecure-dependency"),
    ]


def test_size_limit_is_a_parameter(spark, roots):
    files = tree.read_files(tree.list_tree(spark, roots), max_bytes=10 * 1024 * 1024)
    assert [r["status"] for r in files.where("path = 'big.ts'").collect()] == ["too_large"]


def test_equal_base_names_are_different_projects(spark, tmp_path):
    for side in ("x", "y"):
        (tmp_path / side / "app").mkdir(parents=True)
        (tmp_path / side / "app" / ".env").write_text("A=1")
    (tmp_path / "y" / "app" / ".env.example").write_text("A=")
    files, listing = scanloom.read_tree(spark, [str(tmp_path / s / "app") for s in ("x", "y")])
    found = scanloom.scan(files, listing).collect()
    assert [(r["project_id"], r["rule_id"]) for r in found] == [(str(tmp_path / "x" / "app"), "env-missing-example")]


def test_unreadable_folder(spark, tmp_path):
    listing = tree.list_tree(spark, [str(tmp_path / "missing")])
    out = tree.read_files(listing).first()
    assert out["status"] == "read_error" and "missing" in out["error"]
    assert scanloom.scan_errors(tree.read_files(listing)).count() == 1


def test_unreadable_file(spark):
    row = [("p", "/nowhere", "a.ts", 3, "file")]
    out = tree.read_files(spark.createDataFrame(row, tree.LISTING)).first()
    assert out["status"] == "read_error" and "a.ts" in out["error"]
    errors = scanloom.scan_errors(tree.read_files(spark.createDataFrame(row, tree.LISTING)))
    assert errors.count() == 1


RULES = """
rules:
  - id: todo
    name: Todo
    description: Finds todos
    category: style
    severity: low
    applicableTo: ['.ts']
    patterns:
      - {regex: 'TODO:\\s*(\\w+)', flags: gi, message: 'Found {match}'}
      - {regex: '(', message: broken}
  - id: no-patterns
    pattern: x
    severity: low
    applicableTo: ['.ts']
  - {id: 7, name: n, description: d, category: c, severity: low, applicableTo: ['.ts'], patterns: [{regex: a, message: m}]}
  - {id: dated, name: 2024-01-01, description: yes, category: c, severity: low, applicableTo: ['.ts'], patterns: [{regex: a, message: m}]}
  - {id: flagged, name: n, description: d, category: c, severity: low, applicableTo: ['.ts'], patterns: [{regex: a, flags: q, message: m}]}
"""


def test_rule_files(spark, project, tmp_path):
    main = tmp_path / "scan-rules.yml"
    main.write_text(RULES)
    folder = tmp_path / "more"
    folder.mkdir()
    (folder / "b.yaml").write_text("rules: 3")
    (folder / "c.yml").write_text("{ not yaml")
    (folder / "d.yml").write_text(RULES.replace("id: todo", "id: weak-crypto"))
    table = rulefiles.load_rule_files(spark, str(main), str(folder))
    admitted, rejected = admit_rules(table)
    reasons = {(r["load_order"], r["reason"]) for r in rejected.collect()}
    assert {(1, "missing text"), (2, "missing text"), (4, "no usable pattern")} <= reasons
    rules = compile_rules(admitted)
    assert [(r.rule_id, r.name, len(r.patterns)) for r in rules] == [
        ("todo", "Todo", 1), ("dated", "2024-01-01", 1), ("weak-crypto", "Todo", 1), ("dated", "2024-01-01", 1),
    ]
    book = scanloom.load_rules(spark, str(main), str(folder))
    assert [r.rule_id for r in book.rules[10:]] == ["todo", "dated"]
    found = scanloom.scan(project({"a.ts": "// todo:  me"}), book=book).orderBy("rule_ordinal").collect()
    assert [(r["rule_ordinal"], r["message"]) for r in found] == [(11, "Found todo:  me")]
    assert rulefiles.load_rule_files(spark, str(tmp_path / "none.yml")).count() == 0


def test_python_rule(spark, project):
    def check(path, content):
        if "boom" in content:
            raise ValueError("boom")
        yield 1, None, "first"
        yield None, "critical", "second"

    files = project({"a.ts": "x", "b.ts": "boom", "c.py": "x"})
    found, errors = scanloom.python_rule(files, "mine", "low", "style", (".ts",), check)
    rows = found.orderBy("seq").collect()
    assert [(r["path"], r["line"], r["severity"], r["seq"]) for r in rows] == [("a.ts", 1, "low", 0), ("a.ts", None, "critical", 1)]
    assert [(r["path"], r["error"]) for r in errors.collect()] == [("b.ts", "Rule mine failed: boom")]


def test_stream(spark, project, tmp_path):
    folder = str(tmp_path / "in")
    project({"a.ts": "eval(x)"}).write.parquet(folder)
    stream = spark.readStream.schema("project_id string, path string, content string").parquet(folder)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    scanloom.scan_stream(stream, out, progress).awaitTermination()
    project({"b.ts": "cors()"}).write.mode("append").parquet(folder)
    scanloom.scan_stream(stream, out, progress).awaitTermination()
    got = {(r["path"], r["batch"]) for r in spark.read.parquet(out).where(F.col("rule_id") != "").collect()}
    assert got == {("a.ts", 0), ("b.ts", 1)}
