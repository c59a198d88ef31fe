"""Custom rules that stay a table, against the same rules as a list."""

import random

import pytest
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.operators import detect, findings, rulebook, ruletable
from scanloom.operators.rulebook import Rulebook, RuleTable, custom_rule
from scanloom.plans import scan
from scanloom.streaming import tracked

REACH = ([".ts"], ["Dockerfile"], ["/src/a.js", ".tsx"], [".TS", "b.py"])


def written_rules():
    for k in range(150):
        patterns = [(rf"\bword{k}\b(?!x)", "i" if k % 2 else "", f"Found {{match}} {k}")]
        if k % 3 == 0:
            patterns.append((rf"(?:alpha|beta){k}", "", "second"))
        if k % 5 == 0:
            patterns.append((r"É[𝄞a]", "", "beyond 16 bits"))
        if k % 50 == 0:
            patterns += [(r"^\d+$", "", "digits only"), (r"^(?:(a)|b)\1$", "", "no text, a group")]
        yield f"r{k}", schemas.SEVERITIES[k % 3], REACH[k % 4], patterns


def as_table(spark, rules, load_order=lambda k: k):
    rows = [(load_order(k), i, "n", "d", "c", s, reach, patterns) for k, (i, s, reach, patterns) in enumerate(rules)]
    admitted, _ = rulebook.admit_rules(spark.createDataFrame(rows, schemas.RULES))
    return rulebook.compile_rules(admitted)


def as_list(rules):
    return [custom_rule(i, "n", "d", "c", s, reach, patterns) for i, s, reach, patterns in rules]


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(8)

    def line():
        words = [f"{rng.choice(['word', 'WORD', 'alpha', 'beta'])}{rng.randrange(160)}{rng.choice(['', '', 'x'])}" for _ in range(rng.randrange(6))]
        return rng.choice([" ".join(words), "123", "b", "aa", "ab", "𝄞 É𝄞 word3", "İword3 word3", ""])

    names = ["a.ts", "x/src/a.js", "src/a.js", "q.TSX", "Dockerfile", "z/dockerfile", "b.py", "c.py", "ab.py"]
    rows = [("p", f"{k}/{rng.choice(names)}", "\n".join(line() for _ in range(rng.randrange(40)))) for k in range(60)]
    rows += [("p", "n.ts", None), ("p", "same.ts", "word4 word4"), ("p", "same.ts", "word4 word4")]
    return spark.createDataFrame(rows, "project_id string, path string, content string").repartition(4).cache()


def found(files, book):
    hits = detect.detect(files, None, book, ["r0", *(f"r{k}" for k in range(1, 150))])
    names = ["project_id", "path", "rule_ordinal", "ord", "sub", "line", "code", "detail"]
    texts = findings.to_findings(hits, book).select("path", "line", "severity", "message", "rule_id", "category", "seq")
    return sorted(map(tuple, hits.select(*names).collect())), sorted(map(tuple, texts.collect()))


@pytest.mark.parametrize(
    "limits",
    [{}, {"ASKED_AHEAD": 2, "KNOWN_KEYS": 1, "STRETCH": 7, "LEAST_BITS": 1 << 10, "MOST_BITS": 1 << 10}],
)
def test_a_table_of_rules_finds_what_a_list_finds(spark, files, monkeypatch, limits):
    table = as_table(spark, written_rules())
    assert isinstance(table, RuleTable) and len(table) == 150
    for name, value in limits.items():
        monkeypatch.setattr(ruletable, name, value)
    book, listed = Rulebook().with_custom(table), Rulebook().with_custom(as_list(written_rules()))
    # Nothing of the table is in the book itself.
    assert book.rules == Rulebook().rules
    got, want = found(files, book), found(files, listed)
    assert got == want and len(want[0]) > 300
    assert sorted(map(tuple, book.table(spark).collect())) == sorted(map(tuple, listed.table(spark).collect()))


def test_only_candidate_lines_leave_the_files(spark):
    table = as_table(spark, ((f"r{k}", "low", [".ts"], [(rf"needle{k}\b", "", "m")]) for k in range(2000)))
    content = "\n".join(f"needles{k} needle{k} need{k}" if k % 100 == 0 else f"line {k} of a text" for k in range(20_000))
    files = spark.createDataFrame([("p", "a.ts", content)], "project_id string, path string, content string")
    book = Rulebook().with_custom(table)
    hits = detect.detect(files, None, book)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(r.detail for r in hits.collect()) == sorted(f"needle{k}" for k in range(0, 2000, 100))
    texts = table.rows.selectExpr("explode(patterns.texts) AS t").selectExpr("explode(t) AS text")
    find = ruletable._filtered(texts)[0]()
    # The text of a longer number begins with those of shorter ones.
    assert {t for _, t in find("needle1234 needlx1")} == {"needle1", "needle12", "needle123", "needle1234"}


def test_repeats_and_clashes_keep_the_first_rule(spark):
    def rules(n):
        yield "weak-crypto", "low", [".ts"], [("a", "", "m")]
        for k in range(n):
            yield f"r{k}", "low", [".ts"], [(r"\p{sc=Emoji}" if k == 3 else f"x{k}", "", "m"), (f"y{k}", "", "m")]
            if k % 10 == 0:
                yield f"r{k + 1}", "medium", [".ts"], [(f"z{k}", "", "m")]

    def codes(book):
        rows = book.custom.join(book.numbers, "rule_id").orderBy("rule_ordinal").collect()
        return [(r.rule_id, r.severity, r.rule_ordinal, r.first_code, len(r.patterns)) for r in rows]

    def listed(book):
        return [(r.rule_id, r.severity, r.ordinal, book.first_code(r), len(r.patterns)) for r in book.rules[len(Rulebook().rules) :]]

    table = as_table(spark, rules(150), lambda k: 1000 - k)
    want = Rulebook().with_custom(list(table))
    book = Rulebook().with_custom(table)
    assert codes(book) == listed(want) and len(listed(want)) == 150
    more = as_list([("r1", "low", [".js"], [("a", "", "m")]), ("s1", "low", [".js"], [("word", "", "m")])])
    assert codes(book.with_custom(more)) == listed(want.with_custom(more))
    # Once repeats are gone, few rules become part of the plan.
    few = as_table(spark, (("a", "low", [".ts"], [(f"x{k}", "", "m")]) for k in range(120)))
    planned = Rulebook().with_custom(few)
    assert isinstance(few, RuleTable) and planned.custom is None and planned.rules[-1].patterns[0].regex == "x0"


def test_a_column_names_rules(spark, files):
    rules = list(written_rules())
    for book in (Rulebook().with_custom(as_table(spark, rules)), Rulebook().with_custom(as_list(rules[:90]))):
        hits = detect.detect(files, None, book, _named("r0", "r4"))
        assert {r.rule_id for r in findings.to_findings(hits, book).collect()} == {"r0", "r4"}
        assert detect.detect(files, None, book, _named("none")).count() == 0


def _named(*ids):
    return F.col("rule_id").isin(*ids)


def test_plans_over_a_table_of_rules(spark, files):
    book, listed = Rulebook().with_custom(as_table(spark, written_rules())), Rulebook().with_custom(as_list(written_rules()))

    def rows(df):
        return sorted(map(str, df.collect()))

    assert rows(scan.scan(files, book=book, cap=5)) == rows(scan.scan(files, book=listed, cap=5))
    assert rows(scan.project_scores(files, book=book)) == rows(scan.project_scores(files, book=listed))
    some = ["r3", "r8", "weak-crypto"]
    assert rows(scan.rules_applied(files, book, some)) == rows(scan.rules_applied(files, listed, some))
    with pytest.raises(ValueError):
        tracked.content_counts(files, book)
