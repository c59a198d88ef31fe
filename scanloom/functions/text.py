"""Line and comment handling as native column expressions.

JavaScript's ``\\s`` and ``trim`` cover Unicode blanks and the byte-order mark, Java's do not, so
patterns spell the class out as ``WS``. Java 17's ``\\b`` is Unicode-aware where JavaScript's is
ASCII, so word edges are written as look-arounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_CHARS = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WS_CHARS}]"

_EDGE_BLANKS = f"^{WS}++|{WS}++$"
_COMMENT_START = f"^{WS}*+(?://|\\*|/\\*)"

# One piece of code that is not a comment: plain characters, a string literal that ends at its
# quote or at the end of the line, or a slash that opens no comment. Possessive throughout, so a
# literal of many megabytes is matched without recursion.
_CODE = (
    r"[^\"'`/]++"
    r"|\"(?:[^\"\\\n]++|\\[^\n])*+\"?"
    r"|'(?:[^'\\\n]++|\\[^\n])*+'?"
    r"|`(?:[^`\\\n]++|\\[^\n])*+`?"
    r"|/(?![/*])"
)
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/)?"
_PIECES = f"(?:{_CODE})++|//[^\\n]*+|{_BLOCK}"
_CODE_PREFIX = f"^(?:{_CODE})*+"
_CLOSED = r"/\*(?:[^*]++|\*(?!/))*+\*/"
_ENDS_OPEN = f"^(?:{_CODE}|{_CLOSED})*+/\\*(?:[^*]++|\\*(?!/))*+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(_col(c), _EDGE_BLANKS, "")


def ltrim_ws(c: Column) -> Column:
    return F.regexp_replace(_col(c), f"^{WS}++", "")


def split_lines(content: Column) -> Column:
    """Lines of a text, split on newline only; a trailing empty line is kept."""
    return F.split(_col(content), "\n", -1)


def is_comment_line(raw: Column) -> Column:
    """True when the first visible characters open or continue a comment."""
    return F.rlike(_col(raw), F.lit(_COMMENT_START))


def has_block_comment(content: Column) -> Column:
    """Necessary condition for any block comment; without it lines can be stripped one by one."""
    return F.contains(_col(content), F.lit("/*"))


def strip_comments(content: Column) -> Column:
    """A whole text without comments; newlines inside block comments stay, so line numbers do.

    The text is cut into runs of code and comments, and only the comments are rewritten.
    """
    pieces = F.regexp_extract_all(_col(content), F.lit(_PIECES), F.lit(0))

    def keep(piece: Column) -> Column:
        return (
            F.when(F.startswith(piece, F.lit("//")), F.lit(""))
            .when(F.startswith(piece, F.lit("/*")), F.regexp_replace(piece, r"[^\n]++", ""))
            .otherwise(piece)
        )

    return F.array_join(F.transform(pieces, keep), "")


def strip_line_comment(line: Column) -> Column:
    """One line without its ``//`` comment, for texts that hold no block comment at all."""
    line = _col(line)
    return F.when(
        F.contains(line, F.lit("//")), F.regexp_extract(line, _CODE_PREFIX, 0)
    ).otherwise(line)


def strip_inline_comments(line: Column) -> Column:
    """One line on its own: block comments and the line comment removed, no state carried."""
    return strip_comments(line)


def ends_in_block_comment(line: Column) -> Column:
    """Whether a line that starts outside a block comment ends inside one."""
    return F.rlike(_col(line), F.lit(_ENDS_OPEN))


def after_block_end(line: Column) -> Column:
    """What follows the first end of a block comment, null where there is none."""
    line = _col(line)
    at = F.instr(line, "*/")
    return F.when(at > 0, F.substring(line, at + 2, F.length(line)))


def fill_template(template: Column, match: Column) -> Column:
    """The template with its first ``{match}`` replaced by the literal text matched."""
    mark = "{match}"
    at = F.instr(template, mark)
    return F.when(
        at > 0,
        F.concat(
            F.substring(template, F.lit(1), at - 1),
            match,
            F.substring(template, at + len(mark), F.length(template)),
        ),
    ).otherwise(template)


def sql_text(s: str) -> str:
    """A string literal for an SQL expression, cut where Spark would look for a variable."""
    quoted = s.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + quoted.replace("${", "$' || '{") + "'"


def any_contains(c: Column | str, words: list[str] | tuple[str, ...]) -> Column:
    """True when the text holds at least one of the words, by byte search without decoding.

    For a named column the whole test is one expression text, which builds faster than one column
    object per word.
    """
    if isinstance(c, str):
        return F.expr(" OR ".join(f"contains({c}, {sql_text(w)})" for w in words))
    found = F.contains(c, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(c, F.lit(word))
    return found
