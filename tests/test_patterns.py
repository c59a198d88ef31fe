"""JavaScript patterns: what they find, why they are refused, and many of them in one read."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions import charsets, jspattern, paths
from scanloom.functions.jspattern import translate
from scanloom.operators import detect, rulebook, ruletable
from scanloom.operators.rulebook import Rulebook, custom_rule
from scanloom.plans import scan

#: Pattern, flags, text, and what JavaScript's exec finds first in it (None: nothing).
FOUND = [
    (r"[a-z&&[aeiou]]", "v", "xyzen", "e"),
    (r"[[a-z][0-9]]+", "v", "-a5-", "a5"),
    (r"[\w--\d]+", "v", "12ab_3", "ab_"),
    (r"[\p{L}--[a-z]]+", "v", "abÉÀc", "ÉÀ"),
    (r"[\p{Lu}&&\p{ASCII}]+", "v", "éÉAB", "AB"),
    (r"[^\p{Lu}a]+", "u", "ABaxyZ", "xy"),
    (r"[\q{abc|d|}x]", "v", "zabc", ""),
    (r"[\q{abc|d}x]", "v", "zabc", "abc"),
    (r"[^\d--5]", "v", "1", None),
    (r"[a-c--b]+", "v", "bac", "ac"),
    (r"\p{Letter}+", "u", "1ab", "ab"),
    (r"\p{Script=Greek}+", "u", "abγδ", "γδ"),
    (r"\p{gc=Decimal_Number}", "v", "a٣", "٣"),
    (r"\P{Any}", "u", "a", None),
    (r"(?i:a)b", "", "Ab AB", "Ab"),
    (r"a(?-i:b)", "i", "AB Ab", "Ab"),
    (r"(?s:.)x", "", "\nx", "\nx"),
    (r"^(?:(a)|b\1)$", "", "b", "b"),
    (r"(?:(a)|b)\1$", "", "aa", "aa"),
    (r"^(?:(a)|b)\1$", "", "b", "b"),
    (r"^(?:(a)|b)\1$", "", "ab", None),
    (r"^\1(a)$", "", "a", "a"),
    (r"(a\1)", "", "aa", "a"),
    (r"(?<y>\d\d)-|(?<y>\d)/\k<y>", "", "1/1", "1/1"),
    (r"(?:(?<n>a)|(?<n>b))\k<n>", "", "ab bb", "bb"),
    (r"^(a|b)*\1$", "", "abb", "abb"),
    (r"^(a|b)*\1$", "", "aba", None),
    (r"(\w)\1", "i", "xaA", "aA"),
    (r"\0", "", "a\0", "\0"),
    (r"\101\8", "", "A8", "A8"),
    (r"[\101\b]+", "", "x\bA", "\bA"),
    (r"\c1", "", r"\c1", r"\c1"),
    (r"[\c1]", "", "\x11", "\x11"),
    (r"\u{61}", "u", "xa", "a"),
    (r"\u{2}", "", "uu", "uu"),
    (r"😀", "", "a😀", "😀"),
    (r"[😀-😂]", "u", "a😁", "😁"),
    (r"x{,3}", "", "x{,3}", "x{,3}"),
    (r"a]}", "", "a]}", "a]}"),
    (r"É", "i", "é", "é"),
    (r"ß", "iu", "ẞ", "ẞ"),
    (r"\w", "iu", "ſ", "ſ"),
    (r"\w", "i", "ſ", None),
    (r"s", "i", "ſ", None),
    (r"[^k]", "i", "K", None),
    (r"(?<=\$)\d+(?!\d|%)", "", "5 $12% $34", "34"),
    (r"(?=a)*b", "", "b", "b"),
    (r"a$", "m", "a b", "a"),
    (r"^b", "m", "a\rb", "b"),
    (r"\bk\b", "iu", "kK k", "k"),
    (r"[]|a", "", "a", "a"),
    (r"[^]", "", "\n", "\n"),
    (r"[\d-x]+", "", "a1-x", "1-x"),
    (r"[&&]", "", "a&", "&"),
    (r"a{2}?", "", "aaa", "aa"),
]
#: Pattern, flags, and why it is refused.
REFUSED = [
    ("(", "", "a group without an end"),
    ("a)", "", "a closing bracket too many"),
    ("[a", "", "a class without an end"),
    ("*a", "", "nothing to repeat"),
    ("a**", "", "nothing to repeat"),
    ("{1}", "", "nothing to repeat"),
    ("a{3,1}", "", "numbers out of order in a quantifier"),
    ("[z-a]", "", "a range out of order"),
    ("\\", "", "a backslash at the end"),
    ("a", "gg", "unusable flags"),
    ("a", "uv", "unusable flags"),
    (r"(?<n>a)(?<n>b)", "", "a group name used twice"),
    (r"(?<n>a)\k<m>", "", "a reference to no group"),
    (r"(?<1>a)", "", "an unusable group name"),
    (r"\2(a)", "u", "a reference to no group"),
    (r"\-", "u", "an unknown escape: \\-"),
    (r"}", "u", "a lone bracket"),
    (r"[\d-x]", "u", "a range of classes"),
    (r"(?<=a)*", "", "nothing to repeat"),
    (r"(?=a)*", "u", "nothing to repeat"),
    (r"\p{Emoji}", "u", "a property the engine does not know: Emoji"),
    (r"\p{scx=Grek}", "u", "a property the engine does not know: scx=Grek"),
    (r"\p{L", "u", "an unusable property"),
    (r"[a&&&b]", "v", "three signs of an operator"),
    (r"[a--b&&c]", "v", "operators mixed in a class"),
    (r"[ab--c]", "v", "operators mixed in a class"),
    (r"[(]", "v", "a sign that needs a backslash in a class"),
    (r"[a!!b]", "v", "a sign that needs a backslash in a class"),
    (r"[^\q{ab}]", "v", "a negated class of strings"),
    (r"(?ii:a)", "", "unusable modifiers"),
    (r"(?z)", "", "an unknown kind of group"),
    (r"(?:(a)|b)*\1", "", "a reference to a group that a repetition may skip"),
    (r"(?<=a*)b", "", "a lookbehind without a longest match"),
    (r"(?<=(a)\1)b", "", "a reference in a lookbehind"),
    (r"😀+", "", "a quantifier for half a character"),
    (r"[😀]", "", "half a character"),
    (r"\uD83D", "u", "half a character"),
    ("(?:" * 2000 + ")" * 2000, "", "brackets too deep"),
]


def test_what_patterns_find(spark):
    rows = []
    for pattern, flags, text, found in FOUND:
        done = translate(pattern, flags)
        assert done.regex is not None, (pattern, done.reason)
        rows.append((pattern, flags, done.regex, text, found))
    df = spark.createDataFrame(rows, "pattern string, flags string, regex string, text string, found string")
    got = df.withColumn("got", F.when(F.rlike("text", F.col("regex")), F.expr("regexp_extract(text, regex, 0)")))
    assert [tuple(r)[:3] + (r.got,) for r in got.where("not (got <=> found)").collect()] == []


@pytest.mark.parametrize(("pattern", "flags", "reason"), REFUSED)
def test_why_patterns_are_refused(pattern, flags, reason):
    assert translate(pattern, flags) == jspattern.Translated(None, reason)


@pytest.mark.parametrize(
    ("pattern", "flags", "plain", "folded"),
    [
        (r"(?:eval|exec)\(", "", ("eval", "exec"), ()),
        (r"(?:eval|EX)\(", "", (), ()),
        (r"pa(?:ssword|phrase)\s*=", "i", (), ("phrase", "ssword")),
        (r"foo(?i:bar)", "", (), ("foobar",)),
        (r"(?:abcd)+x?", "", ("abcd",), ()),
        (r"(abc)(def)", "", ("abcdef",), ()),
        (r"k1k2", "iu", (), ()),
        (r"привет", "", ("привет",), ()),
        (r"a|b", "", (), ()),
    ],
)
def test_needed_texts(pattern, flags, plain, folded):
    assert translate(pattern, flags).needs == jspattern.Needs(plain, folded)


def test_sets_against_plain_sets():
    rng = random.Random(4)

    def some():
        pairs = [(a, a + rng.randrange(5)) for a in (rng.randrange(60) for _ in range(rng.randrange(5)))]
        return charsets.ranges(*pairs), {x for a, b in pairs for x in range(a, b + 1)}

    def members(s):
        return {x for x in range(70) if x in s}

    for _ in range(300):
        (a, x), (b, y) = some(), some()
        assert members(charsets.union(a, b)) == x | y
        assert members(charsets.intersection(a, b)) == x & y
        assert members(charsets.difference(a, b)) == x - y
        assert members(charsets.complement(a)) == set(range(70)) - x
        assert charsets.complement(charsets.complement(a)) == a


def test_random_patterns_agree_with_another_engine(spark):
    """Patterns of what both engines share, in pieces put together at random."""
    rng = random.Random(6)
    pieces = ["a", "b", "ab", "[ab]", "[^a]", r"\w", r"\d", "(?:a|b)", "(?:ab|c)", "x?", "b*", "a+?", "c{1,2}", "(?=b)", "(?!c)", r"\b", ".", "(?i:A)"]
    rows = []
    for _ in range(300):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))
        text = "".join(rng.choice("abcABx1 ") for _ in range(12))
        found = re.search(pattern, text, re.ASCII)
        rows.append((pattern, translate(pattern).regex, text, found[0] if found else None))
    df = spark.createDataFrame(rows, "pattern string, regex string, text string, found string")
    got = df.withColumn("got", F.when(F.rlike("text", F.col("regex")), F.expr("regexp_extract(text, regex, 0)")))
    assert got.where("not (got <=> found)").collect() == []


# --- reasons as rows -----------------------------------------------------------------------------


def test_dropped_patterns(spark):
    rows = [
        (1, "a", "n", "d", "c", "low", [".ts"], [("(", "", "m"), ("ok", "", "m"), (None, "", "m"), ("ok", "", None)]),
        (2, "b", "n", "d", "c", "low", [".ts"], [("", "", "m"), ("x" * 501, "", "m"), (r"\p{Script=Nowhere}", "u", "m"), ("a", "q", "m")]),
        (3, "c", None, "d", "c", "low", [".ts"], [("*", None, "m")]),
        (4, "d", "n", "d", "c", "low", [".ts"], None),
    ]
    table = spark.createDataFrame(rows, schemas.RULES)
    got = {(r.rule_id, r.place): r.reason for r in rulebook.dropped_patterns(table).collect()}
    assert got == {
        ("a", 1): "a group without an end",
        ("a", 3): "no regex",
        ("a", 4): "no message",
        ("b", 1): "empty regex",
        ("b", 2): "longer than 500 characters",
        ("b", 4): "unusable flags",
        ("c", 1): "nothing to repeat",
    }
    admitted, rejected = rulebook.admit_rules(table)
    assert {r.rule_id: r.reason for r in rejected.collect()} == {"c": "missing text", "d": "no patterns"}
    assert [(r.rule_id, r.place, r.reason) for r in rulebook.refused_patterns(admitted).collect()] == [("b", 3, "refused by the engine")]
    assert [r.rule_id for r in rulebook.compile_rules(admitted)] == ["a"]
    longer, _ = rulebook.admit_rules(table, max_length=600)
    assert {r.rule_id: len(r.patterns) for r in longer.collect()} == {"a": 1, "b": 2}


# --- many rules in one read ----------------------------------------------------------------------


def many_rules():
    rules = []
    for k in range(300):
        patterns = [(rf"\bword{k}\b(?!x)", "i" if k % 2 else "", f"Found {{match}} {k}")]
        if k % 3 == 0:
            patterns.append((rf"(?:alpha|beta){k}", "", "second"))
        if k % 50 == 0:
            patterns.append((r"^\d+$", "", "digits only"))
            patterns.append((r"^(?:(a)|b)\1$", "", "no text, a group"))
        reach = [[".ts"], ["Dockerfile"], ["/src/a.js", ".tsx"], [".TS", "b.py"]][k % 4]
        rules.append(custom_rule(f"r{k}", "n", "d", "c", "low", reach, patterns))
    return rules


def test_many_rules_find_what_each_finds(spark, monkeypatch):
    rng = random.Random(8)

    def line():
        words = [f"{rng.choice(['word', 'WORD', 'alpha', 'beta'])}{rng.randrange(320)}{rng.choice(['', '', 'x'])}" for _ in range(rng.randrange(6))]
        return rng.choice([" ".join(words), "123", "b", "aa", "ab", "İword3 word3", ""])

    names = ["a.ts", "x/src/a.js", "src/a.js", "q.TSX", "Dockerfile", "z/dockerfile", "b.py", "c.py", "ab.py"]
    rows = [("p", f"{k}/{rng.choice(names)}", "\n".join(line() for _ in range(rng.randrange(40)))) for k in range(60)]
    rows += [("p", "n.ts", None), ("p", "same.ts", "word4 word4"), ("p", "same.ts", "word4 word4")]
    files = spark.createDataFrame(rows, "project_id string, path string, content string").repartition(4)
    book = Rulebook().with_custom(many_rules())
    custom = [r.rule_id for r in book.rules if r.rule_id.startswith("r") and r.rule_id[1:].isdigit()]

    def hits():
        return sorted(tuple(r) for r in detect.detect(files, None, book, custom).collect())

    as_table = hits()
    monkeypatch.setattr(detect, "PLANNED_RULES", 1000)
    planned = hits()
    assert as_table == planned and len(planned) > 500
    monkeypatch.setattr(detect, "PLANNED_RULES", 100)
    monkeypatch.setattr(ruletable, "AUTOMATON_TEXT", 900)
    assert hits() == planned


def test_two_thousand_rules_read_content_once(spark):
    rules = [custom_rule(f"r{k}", "n", "d", "c", "low", [".ts"], [(f"needle{k}\\b", "", "m")]) for k in range(2000)]
    book = Rulebook().with_custom(rules)
    files = spark.range(20).selectExpr("'p' AS project_id", "concat(id, '.ts') AS path", "concat('x needle', id * 100, ' y') AS content")
    found = detect.detect(files, None, book, [r.rule_id for r in rules])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(r.detail for r in found.collect()) == sorted(f"needle{k * 100}" for k in range(20))


def test_rules_by_path_equals_the_planned_predicates(spark):
    names = ["a.ts", "x/src/a.js", "src/a.js", "q.TSX", "Dockerfile", "z/dockerfile", "b.py", "c.py", "ab.py", "İ.ts", ""]
    files = spark.createDataFrame([("p", n, None) for n in names], "project_id string, path string, content string")
    book = Rulebook().with_custom(many_rules()[:8])
    planned = scan.rules_applied(files, book).select("path", F.explode("rules_applied").alias("rule_id"))
    joined = ruletable.rules_by_path(files, book.table(spark))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert sorted(map(tuple, joined.select("path", "rule_id").collect())) == sorted(map(tuple, planned.collect()))


def test_path_keys(spark):
    row = spark.range(1).select(paths.path_keys(F.lit("A/b.TS"), [3, 9]).alias("k")).first()
    assert row.k == ["bb.ts", "s.ts"] and paths.reach_key(".TS") == "s.ts" and paths.reach_key("B.ts") == "bb.ts"


def test_rules_by_path_pairs_in_blocks_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ruletable, "BLOCK", 3)
    files = spark.createDataFrame([("p", f"a{k}.ts") for k in range(20)] + [("p", "a1.ts")], "project_id string, path string")
    rules = [(f"r{k}", [".ts", f"A{k}.ts", None]) for k in range(10)] + [("r1", [".TS"]), (None, ["ts/"]), (None, [".ts"])]
    joined = ruletable.rules_by_path(files, spark.createDataFrame(rules, "rule_id string, applicable_to array<string>"))
    got = Counter(map(tuple, joined.collect()))
    ids = [f"r{k}" for k in range(10)] + [None]
    assert got == Counter(("p", f, r) for f in [f"a{k}.ts" for k in range(20)] + ["a1.ts"] for r in ids)
    # The pairs come last: nothing after them aggregates or shuffles.
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Aggregate")


def test_patterns_of_a_table_of_one_file_are_read_in_many_tasks(spark, tmp_path):
    rows = [(k, f"r{k}", "n", "d", "c", "low", [".ts"], [(f"({k}", "", "m"), (f"a{k}", "", "m")]) for k in range(64)]
    spark.createDataFrame(rows, schemas.RULES).coalesce(1).write.parquet(f"{tmp_path}/rules")
    dropped = rulebook.dropped_patterns(spark.read.parquet(f"{tmp_path}/rules"))
    assert sorted(r.load_order for r in dropped.collect()) == list(range(64))
    assert dropped.select(F.spark_partition_id()).distinct().count() > 1
