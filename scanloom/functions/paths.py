"""Path predicates and path arithmetic on string columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a scan looks at and what it leaves out.
SCANNED_SUFFIXES = (".ts", ".js", ".jsx", ".tsx")
SCANNED_NAMES = (".env", "Dockerfile", "package.json")
SKIPPED_DIRECTORIES = (
    "node_modules",
    "dist",
    "build",
    ".git",
    "coverage",
    "demo-examples",
    "src/core/rules",
    "tests/fixtures",
)

_SCANNED = (
    r"(?:^|/)(?:[^/]*(?:\.ts|\.js|\.jsx|\.tsx)|\.env|Dockerfile|package\.json)$"
)
_SKIPPED = "(?:^|/)(?:" + "|".join(d.replace(".", "\\.") for d in SKIPPED_DIRECTORIES) + ")/"
_DOT_DIRECTORY = r"(?:^|/)\.[^/]*/"
_DOT_FILE = r"(?:^|/)\.[^/]*$"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def in_scan_scope(path: Column) -> Column:
    """Paths, relative to the project root, that a scan reads.

    Names are matched with case. A dot directory or dot file is not found, except files named
    exactly ``.env``.
    """
    hidden = F.rlike(path, F.lit(_DOT_DIRECTORY)) | (
        F.rlike(path, F.lit(_DOT_FILE)) & (basename(path) != ".env")
    )
    return F.rlike(path, F.lit(_SCANNED)) & ~F.rlike(path, F.lit(_SKIPPED)) & ~hidden


def applies_to(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a rule's list of path patterns covers a path, ignoring case."""
    low = F.lower(path)
    tests = []
    for pattern in patterns:
        p = F.lit(pattern.lower())
        if pattern.startswith(".") or "/" in pattern:
            tests.append(F.endswith(low, p))
        else:
            tests.append(basename(low) == p)
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def applies_to_any(path: Column, patterns: Column) -> Column:
    """The same test where the patterns are an array column."""
    low = F.lower(path)

    def covers(p: Column) -> Column:
        by_suffix = F.startswith(p, F.lit(".")) | F.contains(p, F.lit("/"))
        return F.when(by_suffix, F.endswith(low, F.lower(p))).otherwise(
            basename(low) == F.lower(p)
        )

    return F.exists(patterns, covers)


def reach_key(pattern: str) -> str:
    """A rule's path pattern as a key: what a path ends in (s), or a whole file name (b), ignoring case."""
    ending = pattern.startswith(".") or "/" in pattern
    return ("s" if ending else "b") + pattern.lower()


def reach_key_column(pattern: Column) -> Column:
    """The same of a column of patterns."""
    ending = F.startswith(pattern, F.lit(".")) | F.contains(pattern, F.lit("/"))
    return F.concat(F.when(ending, "s").otherwise("b"), F.lower(pattern))


def path_keys(path: Column, lengths: Sequence[int]) -> Column:
    """The keys a path has: its file name, and its endings of some lengths."""
    low = F.lower(path)
    endings = [F.when(F.length(low) >= n, F.concat(F.lit("s"), F.right(low, F.lit(n)))) for n in lengths]
    return F.array_compact(F.array(F.concat(F.lit("b"), basename(low)), *endings))


def relative_to(path: Column, root: Column) -> Column:
    """The path below root; paths outside root are returned unchanged."""
    prefix = F.when(F.endswith(root, F.lit("/")), root).otherwise(F.concat(root, F.lit("/")))
    return F.when(
        F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))
    ).otherwise(path)


def resolve(base: Column, path: Column) -> Column:
    """An absolute, normalised path: absolute paths stand alone, others start at base."""
    joined = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", base, path))
    segments = F.filter(F.split(joined, "/", -1), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..",
            F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
        ).otherwise(F.array_append(acc, s)),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def is_within(base: Column, path: Column) -> Column:
    """True when the path, resolved against base, is base itself or lies below it."""
    root = resolve(F.lit("/"), base)
    target = resolve(base, path)
    prefix = F.when(root == "/", F.lit("/")).otherwise(F.concat(root, F.lit("/")))
    return (target == root) | F.startswith(target, prefix)
