"""Unified diffs of two texts, and texts from diffs.

Texts are cut at line ends only, a trailing empty line counts, so a text and its lines are the same
thing and a diff turned back is exact. The edit script is a shortest one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions import scalars

# Lines of context around a change; changes whose context would touch share a hunk.
CONTEXT = 3


def _middle(a: Sequence[int], b: Sequence[int]) -> tuple[int, int, int, int]:
    """Myers' middle snake: a run of equal lines that some shortest script goes through halfway."""
    n, m = len(a), len(b)
    delta = n - m
    odd = delta % 2
    forward, backward = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
            down = k == -d or (k != d and forward.get(k - 1, -1) < forward.get(k + 1, -1))
            x = forward.get(k + 1, 0) if down else forward.get(k - 1, 0) + 1
            start = x
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            forward[k] = x
            other = delta - k
            if odd and -(d - 1) <= other <= d - 1 and x + backward.get(other, -n) >= n:
                return start, start - k, x, x - k
        for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
            down = k == -d or (k != d and backward.get(k - 1, -1) < backward.get(k + 1, -1))
            x = backward.get(k + 1, 0) if down else backward.get(k - 1, 0) + 1
            start = x
            while x < n and x - k < m and a[n - 1 - x] == b[m - 1 - (x - k)]:
                x += 1
            backward[k] = x
            other = delta - k
            if not odd and -d <= other <= d and x + forward.get(other, -n) >= n:
                return n - x, m - (x - k), n - start, m - (start - k)
    raise AssertionError("two ways always meet")


def kept_lines(old: Sequence[str], new: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of equal lines, ascending on both sides, as many as there can be.

    Lines that the other side lacks are in no pair and are left out first; equal ends are paired at
    once. The rest is Myers' algorithm in linear space: the work is lines times differing lines.
    """
    numbers: dict[str, int] = {}
    a = [numbers.setdefault(x, len(numbers)) for x in old]
    b = [numbers.setdefault(x, len(numbers)) for x in new]
    both = set(a) & set(b)
    left = [k for k, x in enumerate(a) if x in both]
    right = [k for k, x in enumerate(b) if x in both]
    a, b = [a[k] for k in left], [b[k] for k in right]
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            pairs.append((n, m))
        if i < n and j < m:
            x, y, u, v = _middle(a[i:n], b[j:m])
            pairs += [(i + x + k, j + y + k) for k in range(u - x)]
            todo += [(i, i + x, j, j + y), (i + u, n, j + v, m)]
    return [(left[i], right[j]) for i, j in sorted(pairs)]


def _changes(old: Sequence[str], new: Sequence[str]) -> Iterator[tuple[int, int, int, int]]:
    """Stretches (of old lines, of new lines) that replace each other."""
    i = j = 0
    for x, y in [*kept_lines(old, new), (len(old), len(new))]:
        if i < x or j < y:
            yield i, x, j, y
        i, j = x + 1, y + 1


def hunks(old: Sequence[str], new: Sequence[str], context: int = CONTEXT) -> list[str]:
    """Lines of the hunks that turn one list of lines into another; none if they are equal."""
    groups: list[list[tuple[int, int, int, int]]] = []
    for change in _changes(old, new):
        if groups and change[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(change)
        else:
            groups.append([change])
    out = []
    for group in groups:
        front = min(context, group[0][0])
        back = min(context, len(old) - group[-1][1])
        a, b = group[0][0] - front, group[-1][1] + back
        c, d = group[0][2] - front, group[-1][3] + back
        # An empty side is numbered by the line before it.
        out.append(f"@@ -{a + (b > a)},{b - a} +{c + (d > c)},{d - c} @@")
        at = a
        for i, n, j, m in group:
            out += [" " + x for x in old[at:i]]
            out += ["-" + x for x in old[i:n]]
            out += ["+" + x for x in new[j:m]]
            at = n
        out += [" " + x for x in old[at:b]]
    return out


def applied(old: Sequence[str], patch: Sequence[str]) -> list[str] | None:
    """The new lines, or None if the patch does not fit the old ones.

    Lines before the first hunk, such as a header, count for nothing.
    """
    out: list[str] = []
    at = 0
    lines = iter(patch)
    line = next(lines, None)
    while line is not None and not line.startswith("@@"):
        line = next(lines, None)
    while line is not None:
        try:
            _, before, after, _ = line.split(" ", 3)
            start, n = (int(x) for x in before[1:].split(","))
            m = int(after[1:].split(",")[1])
        except ValueError:
            return None
        start -= n > 0
        if start < at or start > len(old):
            return None
        out += old[at:start]
        at = start
        line = next(lines, None)
        while n or m:
            kind, text = (line[:1], line[1:]) if line is not None else ("", "")
            if kind not in (" ", "-", "+") or (kind != "+" and (at >= len(old) or old[at] != text)):
                return None
            if kind != "+":
                at, n = at + 1, n - 1
            if kind != "-":
                out.append(text)
                m -= 1
            line = next(lines, None)
        if n < 0 or m < 0 or (line is not None and not line.startswith("@@")):
            return None
    return out + list(old[at:])


# Row by row, in small batches: a batch of ten thousand texts would be held as lines many times over.
@F.udf(returnType=T.ArrayType(T.StringType()), useArrow=False)
def text_hunks(old: str | None, new: str | None) -> list[str]:
    """Hunk lines of two texts; null is a text without lines, unlike the empty one."""
    return hunks([] if old is None else old.split("\n"), [] if new is None else new.split("\n"))


@F.udf(returnType=T.StringType(), useArrow=False)
def patched(old: str | None, patch: list[str] | None) -> str | None:
    """The text that a patch makes of an old one; null if it does not fit or leaves no lines."""
    lines = applied([] if old is None else old.split("\n"), [] if patch is None else patch)
    return "\n".join(lines) if lines else None


def diff_files(before: DataFrame, after: DataFrame, as_of: Column) -> DataFrame:
    """``project_id, path, line_no, text``: the patch of each file that differs between two tables of files
    (``project_id, path, content``, a path once in each).

    Files that are on one side only are diffs against ``/dev/null``; equal files have no lines.
    """
    sides = [
        side.select("project_id", "path", F.struct(F.col("content").alias("content")).alias(name))
        for side, name in ((before, "old"), (after, "new"))
    ]
    # A null file and an absent one are not the same, so contents travel in a struct.
    both = sides[0].join(sides[1], ["project_id", "path"], "full")
    changed = both.where(~F.col("old.content").eqNullSafe(F.col("new.content")))
    stamp = scalars.diff_stamp(as_of)

    def name(side: str, sign: str, prefix: str) -> Column:
        path = F.when(F.col(f"{side}.content").isNull(), F.lit("/dev/null"))
        path = path.otherwise(F.concat(F.lit(prefix), F.col("path")))
        return F.concat(F.lit(sign), path, F.lit("\t"), stamp)

    head = F.array(name("old", "--- ", "a/"), name("new", "+++ ", "b/"))
    return changed.select(
        "project_id",
        "path",
        F.posexplode(F.concat(head, text_hunks("old.content", "new.content"))).alias("line_no", "text"),
    )
