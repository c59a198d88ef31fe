"""Counting the tokens of a unigram tokenizer without making them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import arrays, store

#: A vocabulary file of a public tokenizer; any other may be named.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Counts of words that a task remembers; when there are more, it starts anew.
REMEMBERED = 1 << 19

_BLANK = "▁"
_UNKNOWN_PENALTY = 10.0


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores, in the order of the file, and the unknown piece's number.

    The file lists pieces by rank; as unigram scores serve their log probabilities under Zipf's law,
    -log(rank + 1). Special pieces keep their place; bytes are the fallback of unknown characters.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = model.SentencePiece if hasattr(model, "SentencePiece") else sentencepiece_model_pb2.ModelProto.SentencePiece
    pieces = [(p.piece, -math.log(rank + 1.0)) for rank, p in enumerate(model.pieces)]
    unknown = next(k for k, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
    return pieces, unknown


class PieceCounter:
    """Counts the pieces of the best segmentation of a text under a unigram vocabulary.

    The rules are those of the unigram model of the tokenizers library with byte fallback: blanks become
    U+2581, one is put in front unless the text begins with one, and each begins a new part, which is
    segmented by itself. Of equal sums the one whose last piece is longest stays, since pieces are
    tried in order of their start and only a larger sum replaces an earlier one. A character that is
    no piece scores the smallest score less ten; neighbouring ones are one unknown, which falls back
    to its bytes where all of them are pieces.
    """

    def __init__(self, pieces: list[tuple[str, float]], unknown: int) -> None:
        self.automaton = ahocorasick.Automaton()
        for number, (piece, score) in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        known = self.known = {p for p, _ in pieces}
        self.unknown = pieces[unknown][0]
        self.plain = len(self.unknown) > 1
        self.single = {p for p in known if len(p) == 1}
        self.penalty = min((s for _, s in pieces), default=0.0) - _UNKNOWN_PENALTY
        self.fallback = {b for b in range(256) if f"<0x{b:02X}>" in known}
        # Characters of no piece at all end every piece, so what stands between is counted alone (where
        # unknown characters count by the byte, and not by the run).
        letters = set("".join(known))
        self.letters = letters
        self.counts: dict[str, int] = {}
        self.foreign = re.compile(f"([^{re.escape(''.join(sorted(letters)))}]+)") if letters else re.compile("(.+)", re.S)

    def _unknown(self, text: str) -> int:
        if text in self.known:
            return 1
        octets = text.encode("utf-8", "surrogatepass")
        return len(octets) if all(b in self.fallback for b in octets) else 1

    def _segment(self, text: str) -> int:
        """Pieces of the best path, each run of unknown characters as its fallback."""
        if self.plain and self.single.issuperset(text) and self.unknown not in text:
            return self._known(text)
        return self._mixed(text)

    def _known(self, text: str) -> int:
        """The same where every character is a piece: the best sum and its pieces up to each place."""
        n = len(text) + 1
        best, pieces = [-math.inf] * n, [0] * n
        best[0] = 0.0
        # Matches come by their end, the longest first, that is by start.
        for end, (size, score) in self.automaton.iter(text):
            end += 1
            total = best[end - size] + score
            if total > best[end]:
                best[end] = total
                pieces[end] = pieces[end - size] + 1
        return pieces[-1]

    def _mixed(self, text: str) -> int:
        n = len(text)
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        back = [0] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            matches[end].append(match)
        single = self.single
        for end in range(n):
            top, start = -math.inf, end
            for size, score in matches[end]:
                total = best[end + 1 - size] + score
                if total > top:
                    top, start = total, end + 1 - size
            if text[end] not in single:
                total = best[end] + self.penalty
                if total > top:
                    top, start = total, end
            best[end + 1] = top
            back[end + 1] = start
        count, end, open_end = 0, n, -1
        while end > 0:
            start = back[end]
            if end - start == 1 and text[start] not in single or text[start:end] == self.unknown:
                if open_end < 0:
                    open_end = end
            else:
                if open_end >= 0:
                    count += self._unknown(text[end:open_end])
                    open_end = -1
                count += 1
            end = start
        return count + (self._unknown(text[:open_end]) if open_end >= 0 else 0)

    def _part(self, text: str) -> int:
        """A part that begins with the blank mark, cut at characters of no piece."""
        if len(self.fallback) < 256 or self.letters.issuperset(text):
            return self._segment(text)
        count = 0
        for k, piece in enumerate(self.foreign.split(text)):
            if k % 2:
                count += self._unknown(piece)
            elif piece:
                count += self._remembered(piece)
        return count

    def _remembered(self, text: str) -> int:
        found = self.counts.get(text)
        if found is None:
            if len(self.counts) >= REMEMBERED:
                self.counts.clear()
            found = self.counts[text] = self._segment(text)
        return found

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = text.replace(_BLANK, " ").split(" ")
        if not parts[0]:
            del parts[0]
        total = 0
        get = self.counts.get
        for part in parts:
            found = get(_BLANK + part)
            if found is None:
                if len(self.counts) >= REMEMBERED:
                    self.counts.clear()
                found = self.counts[_BLANK + part] = self._part(_BLANK + part)
            total += found
        return total


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, n_words`` per row of ``docs`` (``doc_id, text``).

    The vocabulary's pieces are sent to the tasks (a file of bounded size); each task enumerates their
    matches in a word by Aho-Corasick and carries the best sum and its pieces over the word's places.
    A word's count is remembered. Null and empty texts have no tokens; rows with null or repeated ids
    have a row each; words are runs of non-blanks. Texts of any length are counted whole; an empty table
    has no rows; other columns, whatever their names, play no part.
    """
    model = store.sent(docs, read_vocabulary(vocabulary))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]):
        counter = PieceCounter(*store.received(model))
        for batch in batches:
            for part in arrays.parts(batch.column(1)):
                found = arrays.spans(part, arrays.NOT_BLANK)
                octets = part.data.tobytes()
                counts = np.array(
                    [
                        counter.count(octets[a:b].decode("utf-8", "replace"))
                        for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)
                    ],
                    dtype=np.int64,
                )
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(part.first, len(part)),
                        "n_tokens": pa.array(counts),
                        "n_words": pa.array(found.counts, pa.int64()),
                    }
                )

    return texts.mapInArrow(rows, "doc_id long, n_tokens long, n_words long")
