"""JavaScript patterns that differ in Java, evaluated by Spark."""

import pytest
from pyspark.sql import functions as F

from scanloom.functions.jsregex import java_regex

CASES = [
    (r"<script>[\s\S]*?</script>", "", "a<script>x\n y</script>b", "<script>x\n y</script>"),
    (r"[^\S]+", "", "ab \u00a0c", " \u00a0"),
    (r"[\S ]+", "", "ab c\td", "ab c"),
    (r"[^\Sa]", "", "ba c", " "),
    (r"\p{Lu}+", "u", "xABCx p{Lu}", "ABC"),
    (r"\p{Lu}+", "", "xABCx p{Lu}", "p{Lu}"),
    (r"\P{L}+", "v", "ab12c", "12"),
    (r"(?<n>a)\k<n>", "", "xaax", "aa"),
    (r"(?<q_$1>[ab])-\k<q_$1>", "", "a-b a-a", "a-a"),
    (r"\k<n>", "", "k<n>", "k<n>"),
    (r"\ca", "", "x\x01y", "\x01"),
]


@pytest.mark.parametrize(("pattern", "flags", "text", "found"), CASES)
def test_match(spark, pattern, flags, text, found):
    regex = java_regex(pattern, flags)
    got = spark.range(1).select(F.regexp_extract(F.lit(text), regex, 0)).first()[0]
    assert got == found


@pytest.mark.parametrize("pattern", ["(", "*a", "[a", "[z-a]", "a{3,1}", "(?<n>a)\\k<m>", "(?<n>a)(?<n>b)", "a)"])
def test_rejected(pattern):
    assert java_regex(pattern) is None


def test_flags():
    assert java_regex("a", "v") and java_regex("a", "u")
    assert java_regex("a", "uv") is None and java_regex("a", "gg") is None and java_regex("a", "x") is None
