"""Token files, Merkle trees and hard negatives against plain versions, round trips and hard rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanloom.llm import arrays, merkle, negatives, token_files

from .plain import DOCS, HARD, with_more_columns


@pytest.fixture(scope="module")
def hard(spark):
    return with_more_columns(spark.createDataFrame(HARD, DOCS)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def encoder():
    with open(token_files.VOCABULARY, encoding="utf-8") as f:
        return token_files.Encoder(f.read())


# --- token files ---------------------------------------------------------------------------------


def ids_of(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(encoder):
    assert encoder.wordwise
    rng = random.Random(1)
    texts = [
        "Don't x.'s 'S <|endoftext|>a <|ENDOFTEXT|> b<|startoftext|>",
        "é a≠b é.é €.x ÀÉ  　中文 x9.8y İSTANBUL ΣΑΣ. ß.ﬁ",
        "a'́s.'t we'LL''d",
        "\x00\x01x\x7fy \x85 \xa0z",
        "",
        "İ.x <| x<|y <|X|>",
        "x" * 5000 + " " + "ñ" * 3000,
    ]
    signs = list("ab'sS.,9<| ́éÉ̸=€中 \nT|>")
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for k in range(0, len(texts), 9):
        [part] = arrays.parts(pa.array(texts[k : k + 9]))
        ids, first = encoder(part)
        for text, a, b in zip(texts[k : k + 9], first[:-1], first[1:], strict=True):
            assert ids[a:b].tolist() == ids_of(encoder, text), text


def test_encoder_starts_anew(encoder, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 5)
    texts = [f"some words number{k} again" for k in range(40)]
    for text in texts:
        [part] = arrays.parts(pa.array([text]))
        assert encoder(part)[0].tolist() == ids_of(encoder, text)


def test_other_tokenizers_encode_whole_texts():
    with open("/opt/tokenizers/byte_bpe_50k.json", encoding="utf-8") as f:
        encoder = token_files.Encoder(f.read())
    assert not encoder.wordwise
    texts = ["two  blanks\nand a line", "", "x"]
    [part] = arrays.parts(pa.array(texts))
    ids, first = encoder(part)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [ids_of(encoder, t) for t in texts]


@pytest.mark.parametrize("alphabet", [1, 2, 30, 3000, 70_000])
def test_repair_round_trip(alphabet):
    rng = np.random.default_rng(alphabet)
    phrases = [rng.integers(0, alphabet, rng.integers(1, 30)) for _ in range(40)]
    docs = [np.concatenate([phrases[k] for k in rng.integers(0, 40, rng.integers(1, 60))]) for _ in range(60)]
    docs += [rng.integers(0, alphabet, 80_000), np.zeros(0, np.int64), np.zeros(999, np.int64)]
    ids = np.concatenate(docs).astype(np.uint32)
    grammar = token_files.repair(ids, np.cumsum([len(d) for d in docs]))
    block = token_files._packed(grammar) | {"ends": grammar.ends}
    back = token_files.unpacked(block)
    assert (back.ids() == ids).all()
    n = len(back.terminals)
    # Every rule is of two earlier symbols and is as long as both; every sequence ends in its document.
    assert (back.rules < n + np.arange(len(back.rules))[:, None]).all()
    assert (back.sizes[n:] == back.sizes[back.rules].sum(axis=1)).all()
    for k, doc in enumerate(docs):
        assert (back.document(k) == doc).all()
        a, b = sorted(rng.integers(0, len(doc) + 1, 2))
        assert (back.document(k, int(a), int(b)) == doc[a:b]).all()
    if alphabet <= 30:
        assert len(back.symbols) < len(ids)
        uses = np.bincount(np.concatenate((back.symbols, back.rules.ravel())), minlength=n + len(back.rules))
        assert uses[n:].min() >= 1


def test_repair_small_sequences():
    for docs in ([], [[]], [[5]], [[], [7, 7, 7], []], [[1, 2]] * 20):
        ids = np.array([x for d in docs for x in d], dtype=np.uint32)
        grammar = token_files.repair(ids, np.cumsum([len(d) for d in docs], dtype=np.int64))
        assert grammar.ids().tolist() == ids.tolist()
        assert [grammar.document(k).tolist() for k in range(len(docs))] == docs


def plain_digests(encoder, rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(encoder, text), 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_hard_rows(spark, hard, empty, encoder):
    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1],))

    # The rows that repeat an id are equal, so their order does not show.
    assert rows(token_files.token_digests(hard)) == plain_digests(encoder, [r[:2] for r in HARD])
    assert rows(token_files.token_digests(empty)) == []


def test_token_files_of_many_blocks(spark, encoder, tmp_path, monkeypatch):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta's", "№5", "<|endoftext|>"]
    texts = [(k * 7 % 997, " ".join(rng.choice(words) for _ in range(rng.randint(0, 300)))) for k in range(400)]
    texts += [(5000 + k, "word " * 150_000 if k == 1 else None) for k in range(3)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 2000)
    path = f"{tmp_path}/files"
    token_files.write_token_files(df, path)
    blocks = token_files.read_blocks(spark, path).collect()
    assert len(blocks) > 20
    read = token_files.read_documents(spark, path).orderBy("start").collect()
    assert [tuple(r)[:4] for r in read] == plain_digests(encoder, texts)
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in read)
    # A part of a document from a block by itself.
    block = next(b for b in blocks if 5001 in b.doc_ids)
    grammar = token_files.unpacked(block.asDict())
    k = block.doc_ids.index(5001)
    assert grammar.document(k, 100_000, 100_004).tolist() == ids_of(encoder, "word " * 4)
    assert len(block.symbols) < 2000


def test_invalid_bytes_are_read(spark):
    df = spark.range(1).selectExpr("id AS doc_id", "cast(unhex('61ff6220c3') AS string) AS text")
    assert [r.n_tokens > 1 for r in token_files.token_digests(df).collect()] == [True]


# --- Merkle trees --------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves, fanout):
    """The root, and of every leaf its siblings as (in front, behind), level by level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, j in enumerate(at):
            first = j - j % fanout
            run = level[first : first + fanout]
            paths[k].append(("".join(run[: j - first]), "".join(run[j - first + 1 :])))
        level = [h("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
        at = [j // fanout for j in at]
    return level[0], paths


def plain_manifest(rows, fanout):
    """{(group, order, leaf)} to its subroot, root and path."""
    groups = {}
    for g, o, leaf in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, above = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, above, strict=True):
        for (known, o, leaf), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            out.append((g, o if known else None, leaf, trees[g][0], root, path + up))
    return out


@pytest.mark.parametrize("fanout, levels", [(2, 2), (2, 8), (3, 2)])
def test_manifest(spark, monkeypatch, fanout, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(fanout)
    rows = [("one", 5, h("x"))]
    for g, n in [(None, 7), ("a", 2), ("B", 33), ("ü", 16), ("\U0001f600", 17), ("｡", 4)]:
        rows += [(g, rng.randrange(60), h(f"{g}{k}")) for k in range(n)]
    rows += [("B", None, h("n")), ("B", None, h("n")), ("B", 3, h("t")), ("B", 3, h("s"))]
    df = spark.createDataFrame(rows, "g string, o long, leaf string").repartition(5)
    got = merkle.manifest(df, F.col("g"), F.col("o"), F.col("leaf"), F.struct("g", "o"), fanout)
    got = got.withColumns({"fold": merkle.folded(F.col("leaf"), F.col("path")), "proof": merkle.path_digest(F.col("path"))})
    want = plain_manifest(rows, fanout)
    seen = got.collect()
    assert sorted(((r.carry.g, r.carry.o, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in seen), key=repr) == sorted(want, key=repr)
    assert all(r.fold == r.root for r in seen)
    proofs = {repr((w[0], w[1], w[2], w[5])): h("".join(a + b for a, b in w[5])) for w in want}
    assert all(r.proof == proofs[repr((r.carry.g, r.carry.o, r.leaf, [tuple(p) for p in r.path]))] for r in seen)


def test_manifest_shows_changes(spark):
    df = spark.range(300).withColumn("leaf", merkle.leaf_of(F.col("id"), F.lit(None)))
    rows = merkle.manifest(df, F.lit("all"), F.col("id"), F.col("leaf"), F.col("id"))
    other = merkle.folded(merkle.leaf_of(F.col("carry"), F.lit("changed")), F.col("path"))
    assert rows.where(other == F.col("root")).count() == 0
    assert rows.select("root").distinct().count() == 1
    first = rows.where("carry = 0").first()
    assert first.leaf == h("1:0-") and first.root != first.leaf


def test_leaves_of_hard_rows(spark, hard, empty):
    leaf = merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    rows = merkle.manifest(hard, F.col("lang"), F.col("doc_id"), leaf, F.col("doc_id")).collect()
    want = [(lang, i, h("".join(map(field, (i, source, lang, n, text))))) for i, text, lang, source, n in HARD]
    assert sorted(r.leaf for r in rows) == sorted(w[2] for w in want)
    plain = {(w[1] or 0, w[2], w[3], w[4]) for w in plain_manifest(want, 2)}
    assert {(r.carry or 0, r.leaf, r.subroot, r.root) for r in rows} == plain
    assert merkle.manifest(empty, F.col("lang"), F.col("doc_id"), leaf).count() == 0
    long = spark.createDataFrame([(1, "x" * 3_000_000)], "doc_id long, text string")
    [r] = merkle.manifest(long, F.lit(None).cast("string"), F.col("doc_id"), merkle.leaf_of(F.col("text"))).collect()
    assert r.leaf == r.subroot == r.root == h("3000000:" + "x" * 3_000_000) and r.path == []


# --- hard negatives ------------------------------------------------------------------------------


def plain_negatives(rows, every=10, scale=256, positives=5, most=10, low=30, high=90):
    good = {
        (i, label, tuple(math.floor(scale * x) for x in v))
        for i, v, label in rows
        if None not in (i, v, label) and None not in v and all(map(math.isfinite, v))
    }
    out = set()
    for a in good:
        if a[0] % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b) for b in good if b != a and len(b[2]) == len(a[2])
        )
        for p, i, _ in [s for s in scored if s[2][1] == a[1]][:positives]:
            found = [(n, j) for n, j, b in scored if b[1] != a[1] and low * -p <= 100 * -n <= high * -p][:most]
            out |= {(a[0], i, k, j, -p, -n) for k, (n, j) in enumerate(found, 1)}
    return out


def mined(df, **more):
    rows = [tuple(r) for r in negatives.mine_negatives(df, F.col("vec_id") % 10 == 0, **more).collect()]
    return set(rows), len(rows)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("n, labels, dims", [(400, 4, 16), (150, 40, 3), (60, 1, 8), (300, 2, 1)])
def test_negatives(spark, monkeypatch, n, labels, dims):
    monkeypatch.setattr(negatives, "BLOCK", 37)
    monkeypatch.setattr(negatives, "CELL", 11)
    monkeypatch.setattr(negatives, "GROUP", 2)
    rng = random.Random(n)
    rows = [(k, [rng.gauss(0.1, 0.3) for _ in range(dims)], rng.randrange(labels)) for k in range(n)]
    # Groups of copies, with ties, over several labels and among the anchors.
    rows += [(n + k, rows[3][1], rng.randrange(labels)) for k in range(90)]
    got, many = mined(vectors_of(spark, rows))
    want = plain_negatives(rows)
    assert got == want and many == len(want)


def test_negatives_hard_rows(spark):
    rng = random.Random(5)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [rng.random() for _ in range(4)], k % 3) for k in range(80)]
    rows += [(100, None, 1), (None, [1.0] * 4, 1), (110, [1.0, None, 1.0, 1.0], 1), (120, [nan] * 4, 1), (130, [inf, 1.0, 1.0, 1.0], 2)]
    rows += [(140, [1.0] * 4, None), (150, [], 1), (160, [], 1), (161, [], 2), (170, [0.5] * 5, 1), (171, [0.6] * 5, 1), (172, [0.3] * 5, 2)]
    rows += [rows[10], rows[10], (180, [0.0] * 4, 2), (190, [-0.0, 0.001, -0.001, 0.0], 2), (200, [-1.0] * 4, 0)]
    # One id with another vector, and components whose products need all 64 bits.
    rows += [(10, [0.9] * 4, 1), (210, [1e6] * 4, 1), (211, [1e6, 1e6, 1e6, 1e6 + 1], 1), (212, [8e5, 8e5, 8e5, 8e5 + 1], 2)]
    df = vectors_of(spark, rows)
    for name in ("id", "tag", "v", "u1", "slot", "score", "x", "chosen", "wins"):
        df = df.withColumn(name, F.lit("clash"))
    got, _ = mined(df)
    assert got == plain_negatives(rows)
    assert mined(df.limit(0)) == (set(), 0)
    # One row has neither positives nor negatives; other windows and numbers hold too.
    assert mined(vectors_of(spark, [(0, [1.0], 1)])) == (set(), 0)
    more = {"scale": 16, "positives": 2, "negatives": 3, "low": 10, "high": 150}
    got, _ = mined(vectors_of(spark, rows[:80]), **more)
    assert got == plain_negatives(rows[:80], scale=16, positives=2, most=3, low=10, high=150)


def test_text_labels(spark):
    df = vectors_of(spark, [(k, [1.0 + k, 2.0], k % 2) for k in range(12)])
    got, _ = mined(df.withColumn("label", F.when(F.col("label") == 1, "odd").otherwise("even")))
    assert got == mined(df)[0] != set()


def test_index_finds_all_pairs_above():
    rng = np.random.default_rng(9)
    v = rng.integers(-100, 100, (200, 30)).astype(float) * rng.random((200, 1)).round(1)
    v = np.floor(v)
    q = v[:20]
    exact = q @ v.T
    for least in (-np.inf, 0.0, 20_000.0, 60_000.0, 1e9):
        t = np.full(20, least)
        index = negatives.Index(v, q, least)
        a, i, score = index.pairs(t, lambda rows: np.ones((20, len(rows)), dtype=bool))
        assert set(zip(a.tolist(), i.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(exact >= least)), strict=True))
        assert (exact[a, i] == score).all()
    # High thresholds leave ranges of dimensions out of the index.
    assert negatives.Index(v, q, 60_000.0).cut.max() > 0
