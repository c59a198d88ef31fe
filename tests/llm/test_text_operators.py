"""Language, pseudonyms, quality, tokens and licenses, which look at one document at a time."""

import os
import random
import re

import numpy as np
import pytest

from scanloom.llm import language, licenses, pseudonyms, quality, tokens

from .plain import DOCS, HARD, alnum_words, blank_words, with_more_columns

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def hard(spark):
    return with_more_columns(spark.createDataFrame(HARD, DOCS)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- language ------------------------------------------------------------------------------------


@needs_tables
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_language_hard_rows(spark, hard, empty):
    rows = language.identify(hard).collect()
    assert len(rows) == len(HARD)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(hard.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_language_never_learns_from_held_out_rows(spark):
    # 2 by crc32 of the id as text: labelled otherwise, without effect.
    import zlib

    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "aaa bbb aab" if i % 2 else "xyz yzx zzy", ("p" if i % 2 else "q") if i not in held else "wrong", "s", 1) for i in range(200)]
    found = language.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.lang_pred for r in found} == {"p", "q"}
    assert {r.doc_id for r in found if r.held_out} == set(held)


# --- pseudonyms ----------------------------------------------------------------------------------


def test_feistel_is_a_permutation():
    f = pseudonyms.Feistel(b"k")
    for size in (1, 2, 3, 10, 97, 1000):
        out = [f.permute("x", size, v) for v in range(size)]
        assert sorted(out) == list(range(size))
        assert [f.permute("x", size, v, back=True) for v in out] == list(range(size))


VALUES = [
    "4111 1111 1111 1111", "4012888888881881", "10.2.3.4", "+1 (988) 555-2485", "2024-02-29", "31.12.1999",
    "12/25/2001", "ann.b-c@mail.example.com", "DE89 3704 0044 0532 0130 00", "078-05-1120",
]


def test_pseudonyms_keep_format_and_turn_back():
    text = "x " + " ; ".join(VALUES) + " y " + VALUES[1]
    names = pseudonyms.Pseudonyms(b"secret")
    other, found = names.replace(text)
    assert [text[a:b] for _, a, b in found] == [*VALUES, VALUES[1]]
    for value in VALUES:
        assert value not in other
    assert names.replace(other, back=True)[0] == text
    assert pseudonyms.Pseudonyms(b"other").replace(text)[0] != other
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[0-9]", "0", s))
    parts, new = text[2:].split(" ; "), other[2:].split(" ; ")
    for kind, a, b in zip(["card"] * 2 + ["address"] + ["phone"] + ["date"] * 3 + ["mail"], parts, new):
        if kind not in ("address", "mail"):
            assert shape(a) == shape(b)
    digits = re.sub("[^0-9]", "", new[0])
    assert pseudonyms.luhn_digit(digits[:-1]) == digits[-1]
    # Equal values stay equal.
    assert other.endswith(new[1])


def test_pseudonyms_leave_invalid_values():
    text = "4012888888881882 and 300.1.1.1 and 2023-02-30 and version 2.0. and ABC123"
    assert pseudonyms.Pseudonyms(b"s").replace(text) == (text, [])


def test_pseudonyms_shorter_readings():
    """A valid number goes even where digits or words beside it make the longest reading fail."""
    names = pseudonyms.Pseudonyms(b"s")
    card = "4111 1111 1111 1111"
    for text, value in {
        f"{card} 123": card,
        f"12 {card}": card,
        f"7 {card} 123": card,
        "4111111111111111 12/27": "4111111111111111",
        "1234 5678 9012 3456 4111111111111111": "4111111111111111",
        "ES91 2100 0418 4502 0005 1332 EUR": "ES91 2100 0418 4502 0005 1332",
        "AT611904300234573201 BIC": "AT611904300234573201",
        "AB12 DE89 3704 0044 0532 0130 00": "DE89 3704 0044 0532 0130 00",
    }.items():
        other, found = names.replace(text)
        assert [text[a:b] for _, a, b in found] == [value]
        assert value not in other and len(other) == len(text)


def test_pseudonyms_hard_rows(hard, empty):
    rows = pseudonyms.pseudonymise(hard, b"k").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((i or 0, t or "") for i, t, *_ in HARD)
    assert next(r for r in rows if r.doc_id == 1).text is None
    assert all(r.n_found == 0 and r.kinds == "" for r in rows)
    assert pseudonyms.pseudonymise(empty, b"k").count() == 0


# --- quality -------------------------------------------------------------------------------------


@needs_tables
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score(docs, labels).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert found.score.between(0, 1).all()
    assert (((found.score >= 0.7).astype(int)) == found.predicted).all()


def test_quality_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < p).astype(float)
    net = quality.fit(x[:3000], y[:3000], np.arange(3000) % 5 == 0)
    got = net.probabilities(x[3000:])
    for low in (0.0, 0.25, 0.5, 0.75):
        some = (got >= low) & (got < low + 0.25)
        assert abs(y[3000:][some].mean() - got[some].mean()) < 0.12


def test_quality_hard_rows(spark, hard, empty):
    kind = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (8, None, 0), (9, 7, 0), (999, 1, 0)], kind)
    for some in (labels, labels.limit(0)):
        rows = quality.score(hard, some).collect()
        assert len(rows) == len(HARD)
        assert all(0 <= r.score <= 1 for r in rows)
        by_text = {r.doc_id: r.score for r in rows}
        assert by_text[1] == by_text[2]
    assert quality.score(empty, labels).count() == 0
    assert quality.good_documents(hard, labels).columns == hard.columns


# --- tokens --------------------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="needs a vocabulary file")


@needs_vocabulary
def test_tokens_like_the_tokenizer():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unknown = tokens.read_vocabulary()
    full = Tokenizer(models.Unigram(pieces, unknown, byte_fallback=True))
    full.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = tokens.PieceCounter(pieces, unknown)
    rng = random.Random(3)
    letters = "ab thein \n▁<unk>é中😀\t0x的 s"
    texts = ["", " ", "  a", "<unk>", "a<unk>b", "<0x0A>", "internationalization of words", *[t for _, t, *_ in HARD if t]]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    for text in texts:
        assert counter.count(text) == len(full.encode(text, add_special_tokens=False).ids), text


def test_tokens_ties_and_unknown():
    # ab + c and a + bc score the same: the longest last piece stays; x is unknown without bytes.
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("bc", -2.0), ("ab", -2.0), ("c", -2.0), ("▁a", -5.0)]
    counter = tokens.PieceCounter(pieces, 0)
    assert counter.count("abc") == 3
    assert counter.count("axxa") == 4


@needs_vocabulary
def test_tokens_hard_rows(hard, empty):
    rows = tokens.count_tokens(hard).collect()
    counter = tokens.PieceCounter(*tokens.read_vocabulary())
    want = sorted((i or 0, counter.count(t or ""), len(blank_words(t))) for i, t, *_ in HARD)
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_words) for r in rows) == want
    assert tokens.count_tokens(empty).count() == 0


# --- licenses ------------------------------------------------------------------------------------


def base_places(text):
    words, out = alnum_words(text), []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        out += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    return len(words), sorted(out)


def test_licenses_against_plain(spark):
    rng = random.Random(5)
    parts = ["Under the MIT", "license", "Apache License, Version 2.0", "under", "the", "mit-license", "CC BY-NC 4.0", "cc by", "nc\n", "x"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS)
    for r in licenses.scan_licenses(df).collect():
        n, places = base_places(texts[r.doc_id])
        labels = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(labels))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(labels) <= set(filter(None, r.labels.split(",")))
        if places:
            assert r.score == 1


def test_licenses_with_errors(spark):
    texts = {
        1: "It is released undr the MIT license, as is.",
        2: "GNU Generall Public\nLicense",
        3: "under the hot license of poets",
        4: "Permission is hereby granted, free of charge, to any persn",
        5: "thunder the mit licenses",
    }
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], DOCS)
    rows = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert rows[1].labels == "mit" and rows[1].base_labels == "" and 0.8 < rows[1].score < 1
    assert [(s.first, s.last) for s in rows[1].spans] == [(3, 6)]
    assert rows[2].labels == "gpl"
    assert rows[3].labels == "" and rows[3].score == 0
    assert rows[4].labels == "mit"
    # Every match is a stretch of whole words within the edits allowed.
    from .plain import edits

    notices = {label: [n for n in licenses.NOTICES if n[1] == label] for _, label, _ in licenses.NOTICES}
    for k, r in rows.items():
        words = alnum_words(texts[k])
        for s in r.spans:
            stretch = " ".join(words[s.first : s.last + 1])
            assert any(edits(stretch, text) <= most for text, _, most in notices[s.label])


def test_licenses_one_after_another(spark):
    """A worse match in front of a better one, or behind it, has its span too."""
    texts = [
        "under the mit licence under the mit license",
        "under the mit license under the mit licence",
        "undr the mit license x under the mit license y under the mitt license",
    ]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS)
    spans = {r.doc_id: [(s.first, s.last) for s in r.spans] for r in licenses.scan_licenses(df).collect()}
    assert spans == {0: [(0, 3), (4, 7)], 1: [(0, 3), (4, 7)], 2: [(0, 3), (5, 8), (10, 13)]}


def test_licenses_hard_rows(hard, empty):
    rows = licenses.scan_licenses(hard).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == sorted((i or 0, len(alnum_words(t))) for i, t, *_ in HARD)
    assert all(r.score == 0 and r.labels == "" and r.first_word is None for r in rows)
    assert licenses.scan_licenses(empty).count() == 0


def test_quality_is_fitted_on_every_labelled_document(spark, monkeypatch):
    """More labelled documents than a sample once took; those held out and labels of other values are not among them."""
    docs = spark.range(24_000).selectExpr("id as doc_id", "concat('word', id % 7, ' text ', id) as text")
    labels = spark.range(24_000).selectExpr("id as doc_id", "cast(if(id % 9 = 8, 2, id % 2) as int) as quality")
    wanted = labels.where("quality < 2 and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    seen = {}

    def count(total, width):
        seen["rows"], seen["ones"] = total(lambda x, y, c: np.array([len(y), y.sum()], dtype=np.float64))
        return fit_sums(total, width)

    fit_sums = quality.fit_sums
    monkeypatch.setattr(quality, "fit_sums", count)
    monkeypatch.setattr(quality, "STEPS", 2)
    assert quality.score(docs, labels).count() == 24_000
    assert seen["rows"] == wanted.count() > 12_000 and seen["ones"] == wanted.where("quality = 1").count()
