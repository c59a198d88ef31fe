"""JavaScript patterns as columns and strings; ``jspattern`` reads and writes them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions.jspattern import translate


def java_regex(pattern: str, flags: str = "") -> str | None:
    """The pattern for Spark's regex functions, or None where it cannot be used."""
    return translate(pattern, flags).regex


def required_text(pattern: str, flags: str = "") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """A text that is part of every match, as (as it is, lower-cased); both empty if none is known."""
    found = needs(pattern, flags)
    return found if len(found[0]) + len(found[1]) == 1 else ((), ())


def needs(pattern: str, flags: str = "") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Texts of which every match holds one at least, in the same form."""
    found = translate(pattern, flags).needs
    return found.plain, found.folded


def lower_texts(plain: Sequence[str], folded: Sequence[str]) -> list[str]:
    """Needed texts as they are looked for in lower-cased content."""
    return sorted({t.lower() for t in (*plain, *folded)})


@F.pandas_udf(
    T.ArrayType(
        T.StructType(
            [
                T.StructField("regex", T.StringType()),
                T.StructField("reason", T.StringType()),
                T.StructField("texts", T.ArrayType(T.StringType())),
            ]
        )
    )
)
def translated_column(patterns: pd.Series, flags: pd.Series) -> pd.Series:
    """Arrays of patterns, each translated, with its needed texts, or with the reason why it is not."""

    def one(pattern: str, flag: str) -> dict:
        found = translate(pattern, flag)
        return {"regex": found.regex, "reason": found.reason, "texts": lower_texts(found.needs.plain, found.needs.folded)}

    return pd.Series(
        [
            None if p is None else [one(x, f) for x, f in zip(p, fs, strict=True)]
            for p, fs in zip(patterns, flags, strict=True)
        ]
    )


def translated(patterns: Column, flags: Column) -> Column:
    """The same as a column of its own: filters that read it are not run ahead of it, which would translate twice."""
    return translated_column.asNondeterministic()(patterns, flags)
