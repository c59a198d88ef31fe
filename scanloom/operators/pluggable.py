"""Rules written as Python functions, for checks that patterns cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import paths

Check = Callable[[str, str], Iterable[tuple[int | None, str | None, str]]]

_OUT = (
    "project_id string, path string, line int, severity string, message string, "
    "rule_id string, category string, rule_ordinal int, seq int, error string"
)


def python_rule(
    files: DataFrame,
    rule_id: str,
    severity: str,
    category: str,
    applicable_to: Sequence[str],
    check: Check,
    ordinal: int = 1_000,
) -> tuple[DataFrame, DataFrame]:
    """Findings and errors of a Python rule over the files it applies to.

    ``check(path, content)`` yields ``(line, severity, message)``; an empty severity takes the
    rule's. An exception on one file becomes one error row and the other files go on.
    """
    columns = [c.split()[0] for c in _OUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for project_id, path, content in batch.itertuples(index=False):
                try:
                    found = list(check(path, content))
                except Exception as e:  # noqa: BLE001
                    error = f"Rule {rule_id} failed: {e}"
                    rows.append((project_id, path, None, None, None, None, None, None, None, error))
                    continue
                for seq, (line, own, message) in enumerate(found):
                    facts = (own or severity, message, rule_id, category, ordinal, seq, None)
                    rows.append((project_id, path, line, *facts))
            frame = pd.DataFrame(rows, columns=columns)
            for name in ("line", "rule_ordinal", "seq"):
                frame[name] = frame[name].astype("Int32")
            yield frame

    out = (
        files.where(paths.applies_to(F.col("path"), applicable_to))
        .select("project_id", "path", "content")
        .mapInPandas(run, _OUT)
    )
    findings = out.where(F.col("error").isNull()).drop("error")
    errors = out.where(F.col("error").isNotNull()).select("project_id", "path", "error")
    return findings, errors


@dataclass(frozen=True)
class PythonRule:
    """A rule in code: ``check(path, content)`` yields ``(line, severity, message)``."""

    rule_id: str
    severity: str
    category: str
    applicable_to: tuple[str, ...]
    check: Check


_CHECKED = (
    "rule_ordinal int, rule_id string, category string, seq int, line int, severity string, "
    "message string, error string"
)


def _checker(rules: Sequence[PythonRule], first_ordinal: int):
    """A table function of (path, content): the findings and failures of all rules that apply."""
    # (ordinal, rule, endings, names), all in lower case as paths are compared.
    prepared = []
    for k, rule in enumerate(rules):
        keys = [paths.reach_key(p) for p in rule.applicable_to]
        endings = tuple(key[1:] for key in keys if key[0] == "s")
        prepared.append((first_ordinal + k, rule, endings, {key[1:] for key in keys if key[0] == "b"}))

    class Checker:
        def eval(self, path: str, content: str):
            low = (path or "").lower()
            name = low.rsplit("/", 1)[-1]
            for ordinal, rule, endings, names in prepared:
                if not (low.endswith(endings) or name in names):
                    continue
                head = (ordinal, rule.rule_id, rule.category)
                try:
                    # All of a rule's findings in a file, or none of them.
                    found = [
                        (None if line is None else int(line), own or rule.severity, str(message))
                        for line, own, message in rule.check(path, content)
                    ]
                except (Exception, SystemExit) as e:
                    yield *head, None, None, None, None, f"Rule {rule.rule_id} failed: {e}"
                    continue
                for seq, (line, severity, message) in enumerate(found):
                    yield *head, seq, line, severity, message, None

    return F.udtf(Checker, returnType=_CHECKED)


def python_rules(
    files: DataFrame,
    rules: Sequence[PythonRule],
    root: Column | None = None,
    first_ordinal: int = 1_000,
) -> DataFrame:
    """Findings and failures of any number of Python rules, in one pass over the files.

    The rules are one table function, joined laterally, so content is read once. A rule that raises on
    a file, or yields something that is no finding, becomes one row with ``error`` for that file and
    none of its findings there; the other rules and files go on. An empty severity takes the rule's.
    With ``root``, paths are given back relative to it. Rules without an id or a check are left out,
    and of rules that share an id the first stays.
    """
    valid: dict[str, PythonRule] = {}
    for rule in rules:
        if rule.rule_id and callable(rule.check):
            valid.setdefault(rule.rule_id, rule)
    check = _checker(list(valid.values()), first_ordinal)
    keys = {paths.reach_key(p) for rule in valid.values() for p in rule.applicable_to}
    lengths = sorted({len(k) - 1 for k in keys if k[0] == "s"})
    covered = F.arrays_overlap(
        paths.path_keys(F.col("path"), lengths), F.array(*[F.lit(k) for k in sorted(keys)]).cast("array<string>")
    )
    found = files.where(covered).lateralJoin(check(F.col("path").outer(), F.col("content").outer()))
    path = F.col("path") if root is None else paths.relative_to(F.col("path"), root)
    return found.select(
        "project_id",
        path.alias("path"),
        "line",
        "severity",
        "message",
        "rule_id",
        "category",
        "rule_ordinal",
        "seq",
        "error",
    )
