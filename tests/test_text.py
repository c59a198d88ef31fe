import random

import pytest
from pyspark.sql import functions as F

from scanloom.functions import text
from scanloom.operators.linestate import strip_by_line


def values(spark, rows, expr, column="s"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {column} string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col(column))).collect()]


INLINE = [
    ("const x = 1; // comment", "const x = 1; "),
    ("db.query(/* safe */ `SELECT ${id}`)", "db.query( `SELECT ${id}`)"),
    ("const u = 'http://a.example';", "const u = 'http://a.example';"),
    ('const u = "http://a.example";', 'const u = "http://a.example";'),
    ("a /* b */ c /* d */ e", "a  c  e"),
    ("// entire line", ""),
    ("const t = `a // b`;", "const t = `a // b`;"),
    (r"const s = 'it\'s // in'; // out", r"const s = 'it\'s // in'; "),
    ("a /*/ still */ b", "a  b"),
    ("a / b", "a / b"),
]


def test_inline_comments(spark):
    got = values(spark, [a for a, _ in INLINE], text.strip_inline_comments)
    assert got == [b for _, b in INLINE]


def test_comment_lines(spark):
    rows = ["// x", "/* x", "* @param", "const x = 1;", "  \t// x", chr(0xA0) + "* y", ""]
    assert values(spark, rows, text.is_comment_line) == [True, True, True, False, True, True, False]


def plain_strip(content):
    """Character by character, with the state a block comment carries over lines."""
    out, inside = [], False
    for line in content.split("\n"):
        kept, quote, i = "", None, 0
        while i < len(line):
            two = line[i : i + 2]
            if inside:
                if two == "*/":
                    inside, i = False, i + 2
                else:
                    i += 1
            elif quote:
                if line[i] == "\\" and i + 1 < len(line):
                    kept += two
                    i += 2
                    continue
                if line[i] == quote:
                    quote = None
                kept += line[i]
                i += 1
            elif two == "//":
                break
            elif two == "/*":
                inside, i = True, i + 2
            else:
                if line[i] in "'\"`":
                    quote = line[i]
                kept += line[i]
                i += 1
        out.append(kept)
    return "\n".join(out)


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(7)
    alphabet = ["/", "/", "*", "'", '"', "`", "\\", "\n", "\n", "a", "b", " ", "*/", "/*", "//"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(6000)]


def test_whole_text_against_state_machine(spark, random_texts):
    got = values(spark, random_texts, text.strip_comments)
    assert got == [plain_strip(t) for t in random_texts]


def test_line_strip_equals_whole_strip_without_blocks(spark, random_texts):
    rows = [t.replace("\n", "") for t in random_texts if "/*" not in t.replace("\n", "")]
    assert values(spark, rows, text.strip_line_comment) == [plain_strip(t) for t in rows]


def test_running_state_over_lines(spark, random_texts):
    rows = [
        (str(i), n, line)
        for i, t in enumerate(random_texts)
        for n, line in enumerate(t.split("\n"))
    ]
    df = spark.createDataFrame(rows, "path string, line int, raw string")
    got = {}
    for r in strip_by_line(df, ["path"]).orderBy("path", "line").collect():
        got.setdefault(int(r["path"]), []).append(r["stripped"])
    assert ["\n".join(got[i]) for i in range(len(random_texts))] == [
        plain_strip(t) for t in random_texts
    ]


def test_very_long_literal(spark):
    long = "x = '" + "a\\'" * 700_000 + "'; // gone\n/* " + "*" * 400_000 + " */ y"
    assert values(spark, [long], text.strip_comments) == [plain_strip(long)]


def test_templates(spark):
    df = spark.createDataFrame(
        [("a {match} b {match}", "$1"), ("none", "x"), ("{match}", "")], "t string, m string"
    )
    got = [r[0] for r in df.select(text.fill_template(F.col("t"), F.col("m"))).collect()]
    assert got == ["a $1 b {match}", "none", ""]
