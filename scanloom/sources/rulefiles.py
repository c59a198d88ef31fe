"""Custom rules from YAML files. Rule files are small configuration, read where the job starts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom import schemas

try:
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

DEFAULT_NAME = "scan-rules.yml"


def _json_types_loader():
    """A YAML loader that knows the types of JSON only: no dates, no yes and no."""

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

    for tag, pattern, first in (
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("int", r"^[-+]?[0-9]+$", "-+0123456789"),
        ("float", r"^[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)(?:[eE][-+]?[0-9]+)?$", "-+.0123456789"),
    ):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))
    return Loader


def _text(value):
    return value if isinstance(value, str) else None


def _rule_row(order: int, rule) -> tuple:
    """One rule as a row; what has the wrong type becomes null and fails admission."""
    rule = rule if isinstance(rule, dict) else {}
    reach = rule.get("applicableTo")
    patterns = rule.get("patterns")
    return (
        order,
        *[_text(rule.get(k)) for k in ("id", "name", "description", "category", "severity")],
        [_text(a) for a in reach] if isinstance(reach, list) else None,
        [
            (_text(p.get("regex")), _flags(p.get("flags")), _text(p.get("message")))
            if isinstance(p, dict)
            else (None, None, None)
            for p in patterns
        ]
        if isinstance(patterns, list)
        else None,
    )


def _flags(value) -> str:
    return value if isinstance(value, str) else "" if not value else "?"


def _rules_in(text: str) -> list:
    """The rules of one file's text; none when it is no YAML or has no list of rules."""
    try:
        parsed = yaml.load(text, Loader=_json_types_loader())
    except (yaml.YAMLError, ValueError, RecursionError):
        return []
    rules = parsed.get("rules") if isinstance(parsed, dict) else None
    return rules if isinstance(rules, list) else []


def _rules_of(path: str) -> list:
    """The rules of one file; none when it cannot be read."""
    try:
        with open(path, encoding="utf-8") as f:
            return _rules_in(f.read())
    except (OSError, UnicodeDecodeError):
        return []


def parse_rule_files(files: DataFrame) -> DataFrame:
    """The rules of a table of YAML files, ``position, content``, as ``schemas.RULES``.

    For rule files that are many or lie in a store: each is read where its row is. ``position`` orders
    the files; ``load_order`` (a long) orders their rules, first by file. A null or broken file has none.
    """
    if yaml is None:
        raise ImportError("reading rule files needs the yaml module")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for position, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [_rule_row((position << 24) + k, r) for k, r in enumerate(_rules_in(content or ""))]
                if found:
                    yield pa.RecordBatch.from_pylist([_named(r) for r in found], schema=arrow)

    schema = schemas.RULES.replace("load_order int", "load_order long")
    text = pa.string()
    pattern = pa.struct([("regex", text), ("flags", text), ("message", text)])
    kinds = [pa.int64(), *[text] * 5, pa.list_(text), pa.list_(pattern)]
    names = ["load_order", "rule_id", "name", "description", "category", "severity", "applicable_to", "patterns"]
    arrow = pa.schema(list(zip(names, kinds, strict=True)))

    def _named(row: tuple) -> dict:
        out = dict(zip(names, row, strict=True))
        if out["patterns"] is not None:
            out["patterns"] = [dict(zip(("regex", "flags", "message"), p, strict=True)) for p in out["patterns"]]
        return out

    return files.select(F.col("position").cast("long"), "content").mapInArrow(rows, schema)


def load_rule_files(
    spark: SparkSession, default_file: str = DEFAULT_NAME, directory: str | None = None
) -> DataFrame:
    """Rules of the default file, then of every YAML file of a directory in name order."""
    if yaml is None:
        raise ImportError("reading rule files needs the yaml module")
    files = [default_file]
    if directory and os.path.isdir(directory):
        names = [n for n in sorted(os.listdir(directory)) if n.endswith((".yml", ".yaml"))]
        files += [os.path.join(directory, n) for n in names]
    rules = [r for path in files for r in _rules_of(path)]
    return spark.createDataFrame([_rule_row(i, r) for i, r in enumerate(rules)], schemas.RULES)
