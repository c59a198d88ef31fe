"""Scanning documents for license notices, exactly and with few errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import arrays

#: Phrases that count as places of the base, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Short notices searched with errors: words, label, edits allowed.
NOTICES = (
    ("under the mit license", "mit", 1),
    ("permission is hereby granted free of charge to any person", "mit", 4),
    ("apache license version 2", "apache-2", 2),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("mozilla public license", "mpl", 2),
    ("redistribution and use in source and binary forms", "bsd", 3),
    ("creative commons attribution", "cc-by", 2),
)


class Notice:
    """A notice and its seeds: with e edits allowed, one of e + 1 pieces stands unchanged."""

    def __init__(self, text: str, label: str, edits: int) -> None:
        self.text, self.label, self.edits = text, label, edits
        cuts = [round(k * len(text) / (edits + 1)) for k in range(edits + 2)]
        self.seeds = [(cuts[k], text[cuts[k] : cuts[k + 1]].encode()) for k in range(edits + 1)]
        # Whole words only; the best match of a stretch is the one with the fewest edits.
        self.pattern = regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}(?![^ ])")

    def matches(self, text: str, first: int = 0, last: int | None = None) -> list[regex.Match]:
        """All matches, none overlapping: the best of the stretch, then those in front of it and behind it."""
        out, parts = [], [(first, len(text) if last is None else last)]
        while parts:
            a, b = parts.pop()
            if b - a >= len(self.text) - self.edits and (m := self.pattern.search(text, a, b)):
                out.append(m)
                parts += [(a, m.start()), (m.end(), b)]
        return sorted(out, key=regex.Match.start)


def _normal(part: arrays.Part, found: arrays.Spans) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one blank after each and a line end after each row, and where they start there."""
    sizes = found.ends - found.starts
    counts = found.counts
    # Each word takes its bytes and a blank; each row ends in one more byte.
    begin = np.cumsum(sizes + 1) - (sizes + 1) + found.row
    rows = np.concatenate(([0], np.cumsum(sizes + 1)))[found.first] + np.arange(len(counts) + 1)
    out = np.full(int(rows[-1]), 0x20, dtype=np.uint8)
    keep = arrays.ALNUM[part.data]
    at = np.flatnonzero(keep)
    word = np.repeat(np.arange(len(sizes)), sizes)
    out[at - found.starts[word] + begin[word]] = part.data[at]
    out[rows[1:] - 1] = 0x0A
    return out.tobytes(), begin, rows


def _fuzzy(normal: bytes, rows: np.ndarray, notices: list[Notice]) -> list[tuple[int, int, int, str, float]]:
    """Row, start, end, label and likeness of notices with errors in the normalised bytes."""
    out = []
    for notice in notices:
        windows = []
        slack = notice.edits
        for offset, seed in notice.seeds:
            at = normal.find(seed)
            while at >= 0:
                windows.append((at - offset - slack - 1, at - offset + len(notice.text) + 2 * slack + 1))
                at = normal.find(seed, at + 1)
        windows.sort()
        merged: list[list[int]] = []
        for a, b in windows:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            first = int(np.searchsorted(rows, max(a, 0), side="right")) - 1
            last = int(np.searchsorted(rows, min(b, len(normal)) - 1, side="right")) - 1
            for row in range(max(first, 0), min(last, len(rows) - 2) + 1):
                # A window ends at its row's ends, else at whole words, so that word edges show.
                lo, hi = max(a, int(rows[row])), min(b, int(rows[row + 1]) - 1)
                lo = max(normal.rfind(b" ", 0, lo + 1) + 1, int(rows[row]))
                end = normal.find(b" ", hi)
                hi = min(end if end >= 0 else len(normal), int(rows[row + 1]) - 1)
                text = normal[lo:hi].decode("latin-1")
                for m in notice.matches(text):
                    edits = sum(m.fuzzy_counts)
                    out.append((row, lo + m.start(), lo + m.end(), notice.label, 1 - edits / len(notice.text)))
    return out


_FOUND = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, spans array<struct<label:string,first:long,last:long,likeness:double>>"
)


def scan_licenses(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """License notices per row of ``docs`` (``doc_id, text``).

    Words are runs of letters, digits and non-ASCII, A-Z in lower case. ``n_base``: places where a base
    phrase's words stand consecutively; ``first_word, last_word``: the smallest and largest of their
    starts; ``base_labels``: their labels. ``spans``: notices found with errors, by words from, to;
    ``labels`` adds theirs to the base ones; ``score`` is 1 with a base place, else the best likeness of
    a span (1 - edits / length), else 0. Labels are distinct, sorted and comma-joined.

    Each notice is cut into one piece more than the edits it allows; one of them must stand unchanged,
    so exact search for the pieces finds all candidates, and bounded-error matching of the notice in
    the stretch around decides. A match has to begin and end at word edges. Edits count UTF-8 bytes.

    Null and empty texts have no words, no labels and score 0; rows with null or repeated ids have a
    row each. Texts of any length are searched whole; an empty table has no rows; other columns, whatever
    their names, play no part.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base, notices = tuple(base), tuple(notices)

    def rows(batches: Iterator[pa.RecordBatch]):
        hashes = arrays.SpanHash()
        compiled = [Notice(*n) for n in notices]
        phrases = []
        for phrase, label in base:
            data = np.frombuffer(phrase.encode(), dtype=np.uint8)
            found = arrays.spans(arrays.Part(0, data, np.array([0, len(data)])), arrays.ALNUM)
            phrases.append((hashes(data, found.starts, found.ends), label))
        for batch in batches:
            for part in arrays.parts(batch.column(1)):
                part.data = arrays.LOWER[part.data]
                found = arrays.spans(part, arrays.ALNUM)
                tokens = hashes(part.data, found.starts, found.ends)
                index = found.index()
                n = len(part)
                places = [[] for _ in range(n)]
                named = [set() for _ in range(n)]
                for phrase, label in phrases:
                    size = len(phrase)
                    if len(tokens) < size:
                        continue
                    count = len(tokens) - size + 1
                    same = (tokens[:count] == phrase[0]) & (found.row[:count] == found.row[size - 1 :])
                    at = np.flatnonzero(same)
                    for k in range(1, size):
                        at = at[tokens[at + k] == phrase[k]]
                    for k in at:
                        places[found.row[k]].append(int(index[k]))
                        named[found.row[k]].add(label)
                more = [set() for _ in range(n)]
                best = np.zeros(n)
                spans = [[] for _ in range(n)]
                normal, begin, starts = _normal(part, found)
                for row, a, b, label, likeness in _fuzzy(normal, starts, compiled):
                    first = int(np.searchsorted(begin, a, side="right")) - 1
                    last = int(np.searchsorted(begin, b - 1, side="right")) - 1
                    more[row].add(label)
                    best[row] = max(best[row], likeness)
                    spans[row].append(
                        {
                            "label": label,
                            "first": first - int(found.first[row]),
                            "last": last - int(found.first[row]),
                            "likeness": likeness,
                        }
                    )
                score = [1.0 if places[k] else float(best[k]) for k in range(n)]
                kind = pa.list_(
                    pa.struct(
                        [("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("likeness", pa.float64())]
                    )
                )
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(part.first, n),
                        "n_words": pa.array(found.counts, pa.int64()),
                        "n_base": pa.array([len(p) for p in places], pa.int64()),
                        "first_word": pa.array([min(p, default=None) for p in places], pa.int64()),
                        "last_word": pa.array([max(p, default=None) for p in places], pa.int64()),
                        "base_labels": pa.array([",".join(sorted(x)) for x in named], pa.string()),
                        "labels": pa.array([",".join(sorted(x | y)) for x, y in zip(named, more, strict=True)]),
                        "score": pa.array(score, pa.float64()),
                        "spans": pa.array(spans, kind),
                    }
                )

    return texts.mapInArrow(rows, _FOUND)
