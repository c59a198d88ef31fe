"""Language, quality and licenses against versions that go word by word; bytes that are not UTF-8."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scanloom.llm import arrays, language, licenses, lines, pseudonyms, quality, vectors

from .plain import DOCS, alnum_words, edits


def grams(text):
    """Buckets of a text's n-grams, one by one."""
    chars = [c.lower() if len(c.lower()) == 1 else c for c in text]
    values, before = [], False
    for c in chars:
        if c.isalpha():
            values.append(ord(c))
        elif before:
            values.append(0x20)
        before = c.isalpha()
    out = []
    for size in (1, 2, 3):
        for k in range(len(values) - size + 1):
            code = size
            for v in values[k : k + size]:
                code = (code * 0x100000001B3 + v) % (1 << 64)
            mixed = int(arrays.mix(np.array([code], dtype=np.uint64))[0])
            out.append(mixed >> (64 - language.GRAM_BITS))
    return out, any(v != 0x20 for v in values)


def plain_languages(rows):
    learned = [r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    names = sorted({r[2] for r in learned})
    counts = {n: Counter(b for r in learned if r[2] == n for b in grams(r[1])[0]) for n in names}
    many = Counter(r[2] for r in learned)
    out = {}
    for i, text, *_ in rows:
        found, letters = grams(text or "")
        sums = []
        for n in names:
            total = sum(counts[n].values()) + 0.1 * (1 << language.GRAM_BITS)
            sums.append(math.log(many[n] / len(learned)) + sum(math.log((counts[n][b] + 0.1) / total) for b in found))
        if not letters or not names:
            out[i] = ("und", 0.0)
            continue
        best = max(range(len(names)), key=lambda k: (sums[k], -k))
        out[i] = (names[best], 1 / sum(math.exp(s - sums[best]) for s in sums))
    return out


@pytest.mark.parametrize("block", [1, 3, 64])
def test_language_against_plain(spark, block):
    rng = random.Random(2)
    pools = {f"l{k}": ["".join(rng.choice("abcdeéßжx'") for _ in range(rng.randint(1, 6))) for _ in range(12)] for k in range(7)}
    rows = []
    for i in range(120):
        lang = rng.choice(list(pools))
        text = " ".join(rng.choice(pools[rng.choice([lang, lang, "l0"])]) for _ in range(rng.randint(0, 9))) + rng.choice(["", "!", " 12 İ"])
        rows.append((i, text, lang if i % 9 else None, "s", 1))
    rows += [(500, None, "l1", "s", 1), (501, "12 !", "l2", "s", 1)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, DOCS), block_languages=block).collect()}
    want = plain_languages(rows)
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-4) for i in want)


def test_more_languages_than_a_block(spark):
    rows = [(10 * k + j, " ".join(chr(0x4E00 + 7 * k + d) for d in (0, 1, 2)), f"lang{k:03d}", "s", 1) for k in range(90) for j in range(4)]
    found = language.identify(spark.createDataFrame(rows, DOCS), block_languages=40).collect()
    right = {i: lang for i, _, lang, *_ in rows}
    learned = {right[r.doc_id] for r in found if not r.held_out}
    assert all(r.lang_pred == right[r.doc_id] for r in found if right[r.doc_id] in learned)
    assert len({r.lang_pred for r in found}) == len(learned) > 80


def plain_pooled(text, vectors):
    """The mean vector of a text's tokens, one by one, and the logarithm of their number."""
    hashes = arrays.SpanHash()

    def bucket(token):
        data = np.frombuffer(token, dtype=np.uint8)
        return int(hashes(data, np.array([0]), np.array([len(data)]))[0] >> np.uint64(64 - quality.BUCKET_BITS))

    found, before = [], None
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xFF]+|[^0-9A-Za-z\x80-\xFF\x20\x09-\x0D]+", (text or "").encode()):
        token = m[0]
        word = token[:1].isalnum() or token[0] >= 0x80
        low = token.lower()
        found.append(bucket(low))
        if word:
            if sum(a != b for a, b in zip(token, low, strict=True)) > 1 and not any(0x61 <= c <= 0x7A for c in token):
                found.append(quality._CAPITALS >> (64 - quality.BUCKET_BITS))
            if low == before:
                found.append(quality._REPEATED >> (64 - quality.BUCKET_BITS))
            before = low
    mean = np.mean([vectors[b] for b in found], axis=0) if found else np.zeros(quality.DIMENSIONS)
    return np.append(mean, math.log1p(len(found)))


def test_quality_against_plain(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Good", "bad", "BAD", "WORD!!", "é", "$$", "a", "a"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, ""]
    vectors = quality.index_vectors()
    got = quality.pooled(pa.array(texts), vectors)
    want = np.stack([plain_pooled(t, vectors) for t in texts])
    assert np.allclose(got, want, atol=1e-5)
    # The network, number by number.
    y = np.array([float(k % 2) for k in range(len(texts))])
    net = quality.fit(got, y, np.arange(len(texts)) % 5 == 0)
    for x, p in zip(got, net.probabilities(got), strict=True):
        z = [(a - c) / s for a, c, s in zip(x, net.centre, net.scale, strict=True)]
        hidden = [math.tanh(sum(a * w for a, w in zip(z, net.w1[:, k], strict=True)) + net.b1[k]) for k in range(net.w1.shape[1])]
        logit = sum(a * w for a, w in zip(hidden, net.w2, strict=True)) + net.b2
        assert p == pytest.approx(1 / (1 + math.exp(-logit / net.temperature)), abs=1e-9)


def test_fuzzy_licenses_against_plain(spark):
    rng = random.Random(4)
    letters = "abcdefghilmnoprstuy "
    rows = []
    for i in range(150):
        notice = rng.choice(licenses.NOTICES)[0]
        chars = list(notice)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(chars) + 1)
            chars[k : k + rng.choice([0, 1, 1])] = [rng.choice(letters)] * rng.choice([0, 1, 1])
        rows.append((i, f"some words {''.join(chars)} and more", "en", "s", 1))
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text, *_ in rows:
        words = alnum_words(text)
        labels = set()
        for notice, label, most in licenses.NOTICES:
            for a in range(len(words)):
                for b in range(a + 1, len(words) + 1):
                    piece = " ".join(words[a:b])
                    if abs(len(piece) - len(notice)) <= most and edits(piece, notice) <= most:
                        labels.add(label)
        for phrase, label in licenses.BASE:
            size = len(phrase.split())
            if any(words[k : k + size] == phrase.split() for k in range(len(words))):
                labels.add(label)
        assert got[i] == ",".join(sorted(labels)), text


def test_bytes_that_are_not_utf8(spark):
    df = spark.range(3).selectExpr(
        "id AS doc_id", "cast(concat(unhex('ff41'), cast(' mail ann@mail.example.com\nthe same old line again and again' as binary)) AS string) AS text",
        "'en' AS lang", "'s' AS source", "1L AS n_chars",
    )
    found = pseudonyms.pseudonymise(df, b"k").collect()
    assert all(r.n_found == 1 and "ann@mail" not in r.text for r in found)
    cut = lines.drop_repeated_lines(df, short=True).select("row.doc_id", "row.text", "n_removed").collect()
    assert sorted((r.doc_id, r.n_removed) for r in cut) == [(0, 0), (1, 2), (2, 2)]


@pytest.mark.parametrize("least", [0.7, 0.95])
def test_near_vectors_at_other_thresholds(spark, least):
    """Pairs just above the threshold are found, none below it."""
    rng = np.random.default_rng(int(least * 100))
    u, w = rng.normal(size=(2, 400, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    cos = least + 0.02 * rng.random((400, 1)) - 0.005
    v = cos * u + np.sqrt(1 - cos * cos) * w
    x = np.concatenate((u, v)) * rng.uniform(0.5, 3, (800, 1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= least).sum(axis=1) - 1
    df = spark.createDataFrame([(k, y.tolist()) for k, y in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, least).collect()}
    found = np.array([got[k] for k in range(800)])
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum() > 300
