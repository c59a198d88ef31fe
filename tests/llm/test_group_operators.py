"""Mixing, decontamination, vectors, similarity join, lines and components against plain versions."""

import hashlib
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import arrays, decontaminate, jaccard, lines, links, mixing, store, vectors
from scanloom.llm.components import components
from scanloom.llm.fm_index import FMIndex

from . import plain
from .plain import DOCS, HARD, with_more_columns


@pytest.fixture(scope="module")
def hard(spark):
    return with_more_columns(spark.createDataFrame(HARD, DOCS)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def copies(rng, words, most):
    """Texts of which many are copies of others with some words replaced, dropped or added."""
    base = [[rng.choice(words) for _ in range(rng.randint(3, 60))] for _ in range(12)]
    out = []
    for _ in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, most])):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1, 1])] = [rng.choice(words)] * rng.choice([0, 1, 1])
            w = w or ["x"]
        out.append(" ".join(w))
    return out


# --- components ----------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(k, k + 1) for k in range(100, 140)]
    links += [(200, k) for k in range(201, 260)] + [(300, 300)]
    groups = plain.Groups({x for link in links for x in link})
    for a, b in links:
        groups.join(a, b)
    df = spark.createDataFrame([*links, (None, 1), (2, None)], "a long, b long")
    got = {r.id: r.component for r in components(df).collect()}
    assert got == {x: groups.find(x) for x in groups.parent if groups.find(x) != x}
    assert components(df.limit(0)).count() == 0


# --- mixing --------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    stopped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        all_weights = sum(weight[s] for s in names if s not in stopped)
        share = {s: 3 * sizes[s] if s in stopped else rest * weight[s] / all_weights for s in names}
        above = {s for s in names if s not in stopped and share[s] > 3 * sizes[s]}
        if not above:
            return share
        stopped |= above


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = []
    for source, n, most in [("a", 300, 40), ("B", 20, 30), (None, 50, 9), ("ü", 3, 500), ("\U0001f600", 40, 60), ("z", 1, 7)]:
        rows += [(len(rows) + k, "w " * rng.randint(0, most), "en", source, 1) for k in range(n)]
    rows += [(5000 + k, "same size here", "en", "a", 1) for k in range(2500)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = plain_targets(sizes)
    for source, part in got.assign(source=got.source.astype(object).where(got.source.notna(), "null")).groupby("source"):
        key = None if source == "null" else source
        assert part["source_size"].iloc[0] == sizes[key]
        assert part["target"].iloc[0] == pytest.approx(want[key])
        near = 1 if key in ("a", "B", None, "\U0001f600") else part["size"].max() / 2 + 1
        assert abs(part["taken"].sum() - want[key]) <= near
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix(docs.repartition(5)).toPandas()
    order = ["doc_id", "taken"]
    assert got.sort_values(order)[order].values.tolist() == again.sort_values(order)[order].values.tolist()


def test_fill_is_as_near_as_any_subset():
    rng = random.Random(4)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 4)))
        counts = [rng.randint(1, 3) for _ in lengths]
        sums = {
            sum(a * b for a, b in zip(lengths, pick, strict=True))
            for pick in itertools.product(*[range(c + 1) for c in counts])
        }
        budget = rng.uniform(0, max(sums) * 1.1)
        taken = mixing.fill(np.array(lengths), np.array(counts), budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        # The even share comes first; what is left is filled as well as can be.
        start = np.floor(np.array(counts) * min(1, budget / max(sums))).astype(int)
        reach = {
            sum(a * b for a, b in zip(lengths, pick, strict=True))
            for pick in itertools.product(*[range(s, c + 1) for s, c in zip(start, counts, strict=True)])
        }
        got = int((taken * np.array(lengths)).sum())
        assert abs(got - budget) <= min(abs(s - budget) for s in reach) + 1


def test_mix_hard_rows(hard, empty, spark):
    rows = mixing.mix(hard).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in rows) == sorted((i or 0, len(plain.blank_words(t))) for i, t, *_ in HARD)
    assert all(0 <= r.times <= 3 for r in rows)
    assert mixing.mix(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, "en", "a", 1), (2, "", "en", None, 1)], DOCS)
    assert [(r.target, r.taken) for r in mixing.mix(nothing).collect()] == [(0.0, 0), (0.0, 0)]


# --- decontamination -----------------------------------------------------------------------------


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(3)
    for top in (1, 2, 9):
        text = np.concatenate(([0], rng.integers(0, top + 1, 400), [0]))
        index = FMIndex(text)
        for size in (1, 2, 3, 5):
            phrases = np.array([rng.integers(1, top + 2, size) for _ in range(30)])
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high, strict=True):
                want = [k for k in range(len(text) - size + 1) if (text[k : k + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def benchmark_case():
    rng = random.Random(6)
    words = ["the", "of", "Red", "blue", "sky", "x1"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([2, 14, 20, 40])))) for k in range(12)]
    items += [(50, "Lonely, word!"), (51, ""), (52, items[3][1]), (7, "another text of an id")]
    texts = {}
    for k in range(120):
        w = [rng.choice([*words, "other"]) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.5:
            at = rng.randrange(len(w) + 1)
            w[at:at] = plain.alnum_words(rng.choice(items)[1])[rng.randint(0, 3) :]
        texts[k] = rng.choice([" ", ", ", "\n"]).join(w)
    return items, texts


@pytest.mark.parametrize("block_words", [1 << 19, 30])
def test_benchmark_against_plain(spark, block_words):
    items, texts = benchmark_case()
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], DOCS)
    bench = spark.createDataFrame([*items, (None, "the of"), (9, None)], "item_id long, text string")
    found = decontaminate.find_benchmark(docs, bench, block_words=block_words)
    want = plain.contamination(texts, items)
    rows = decontaminate.contamination(found).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, names = want[r.doc_id]
        text = ",".join(sorted(map(str, names)))
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(names))
        assert r.items_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_benchmark_hard_rows(hard, empty, spark):
    bench = spark.createDataFrame([(1, "same old line"), (2, "one")], "item_id long, text string")
    rows = decontaminate.contamination(decontaminate.find_benchmark(hard, bench)).collect()
    assert len(rows) == len(HARD)
    assert sorted(r.doc_id for r in rows if r.contaminated) == [4, 5, 5, 9]
    assert next(r for r in rows if r.doc_id == 1).n_words == 0
    assert decontaminate.find_benchmark(empty, bench).count() == 0
    none = decontaminate.contamination(decontaminate.find_benchmark(hard, bench.limit(0))).collect()
    assert len(none) == len(HARD) and not any(r.contaminated for r in none)


# --- vectors -------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_links(rows, least=0.9):
    good = {}
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v], dtype=np.float64) if v is not None and len(v) else np.zeros(1)
        if np.isfinite(x).all() and (x != 0).any():
            good[i] = x / np.linalg.norm(x)
    groups, links = plain.Groups([i for i, _ in rows]), {i: 0 for i, _ in rows}
    for a, b in itertools.combinations(good, 2):
        if len(good[a]) == len(good[b]) and good[a] @ good[b] >= least:
            groups.join(a, b)
            links[a] += 1
            links[b] += 1
    return links, {i: groups.find(i) for i, _ in rows}


def test_vectors_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(400):
        a = rng.normal(size=32)
        a /= np.linalg.norm(a)
        other = rng.normal(size=32)
        other -= (other @ a) * a
        other /= np.linalg.norm(other)
        cosine = rng.uniform(0.9, 0.93)
        rows += [(len(rows), a), (len(rows) + 1, cosine * a + np.sqrt(1 - cosine**2) * other)]
    table = [(i, [float(c) for c in v], 0) for i, v in rows]
    links, _ = plain_links([(i, np.float32(v)) for i, v, _ in table])
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(table, VECTORS)).collect()}
    assert all(got[i] <= links[i] for i in links)
    assert sum(got.values()) >= 0.95 * sum(links.values())


def test_vectors_in_groups(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    rows = [(k, np.float32(centre + rng.normal(size=16) * 0.05)) for k in range(70)]
    rows += [(100 + k, np.float32(rng.normal(size=16))) for k in range(60)]
    rows += [(200 + k, rows[0][1]) for k in range(5)]
    table = [(i, [float(c) for c in v], 0) for i, v in rows]
    links, groups = plain_links(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(table, VECTORS)).collect()}
    assert got == {i: (links[i], groups[i], groups[i] == i) for i in links}


def test_vectors_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
        (8, [2.0, 0.0]), (9, [1e-38, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [0.0, 1.0]), (11, [0.0, 1.0]),
    ]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS).selectExpr("*", "1 id", "2 n", "3 h1")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vectors.near_vectors(df).collect())
    alone = [(i, 0, i, True) for i in (0, 1, 2, 3, 4, 5, 6, 10)]
    assert got == sorted([*alone, (7, 2, 7, True), (8, 2, 7, False), (9, 2, 7, False), (11, 1, 11, True), (11, 1, 11, True)])
    assert vectors.near_vectors(df.limit(0)).count() == 0


# --- similarity join -----------------------------------------------------------------------------


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_against_plain(spark, words, percent):
    rng = random.Random(words)
    texts = dict(enumerate(copies(rng, [f"w{k}" for k in range(40)], 4)))
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, words, percent).collect()}
    assert got == plain.jaccard_groups(texts, words, percent)


def test_jaccard_of_one_large_group(spark):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(60)]
    texts = {}
    for k in range(300):
        w = list(base)
        w[rng.randrange(60)] = f"c{k}"
        texts[k] = " ".join(w if k % 3 else base)
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, 3, 90).collect()}
    assert got == plain.jaccard_groups(texts, 3, 90)


def test_similar_is_exact():
    rng = np.random.default_rng(8)
    for _ in range(400):
        x = np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64))
        y = np.unique(np.concatenate((x[rng.random(len(x)) < 0.93], rng.integers(0, 60, 2).astype(np.uint64))))
        both = len(np.intersect1d(x, y))
        assert jaccard.similar(x, y, 80) == (100 * both >= 80 * (len(x) + len(y) - both))


def test_bitmaps_lose_no_similar_pair():
    rng = np.random.default_rng(5)
    dropped = 0
    for percent in (80, 90):
        for _ in range(300):
            size = int(rng.integers(1, 3000))
            x = rng.integers(0, 2**63, size).astype(np.uint64)
            y = np.concatenate((x[rng.random(size) < rng.uniform(0.6, 1)], rng.integers(0, 2**63, size // 20).astype(np.uint64)))
            sizes = np.array([len(x), len(y)])
            bits, first = jaccard.bitmaps(np.concatenate((x, y)), sizes, percent)
            one, two = (bits[a:b].view(np.uint64) for a, b in itertools.pairwise(first))
            passed = jaccard.may_be_similar(one, two, *map(int, sizes), percent)
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                assert passed
            dropped += not passed
    assert dropped > 200


def test_jaccard_hard_rows(hard, empty):
    rows = jaccard.jaccard_groups(hard, 3, 90).collect()
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows)
    sizes = [(i, len(plain.shingle_set(t, 3))) for i, t, *_ in HARD]
    assert got == sorted((i or 0, n, 4 if i == 5 else i or 0) for i, n in sizes)
    assert jaccard.jaccard_groups(empty).count() == 0


# --- lines ---------------------------------------------------------------------------------------


def test_edits_of_words():
    rng = random.Random(7)
    xs, ys = [], []
    for _ in range(400):
        a = [rng.randrange(20) for _ in range(rng.randint(5, 50))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.choice([0, 1])] = [rng.randrange(20)] * rng.choice([0, 1])
        xs.append(np.array(a, dtype=np.int32))
        ys.append(np.array(b or [1], dtype=np.int32))
    most = [max(len(x), len(y)) * 20 // 100 for x, y in zip(xs, ys, strict=True)]
    want = [plain.edits(x.tolist(), y.tolist()) <= m for x, y, m in zip(xs, ys, most, strict=True)]
    assert lines.within_edits(xs, ys, 80).tolist() == want
    assert [lines._bits_within(x, y, m) for x, y, m in zip(xs, ys, most, strict=True)] == want


def test_simhash_counts_bits():
    rng = np.random.default_rng(2)
    for n in (1, 2, 255, 256, 700):
        tokens = rng.integers(0, 2**63, n).astype(np.uint64)
        got = lines.simhash(np.concatenate((tokens, tokens[:1])), np.array([0, n, n + 1]))
        one = np.unpackbits(got[1])
        assert got.shape == (2, lines.SIMHASH_BITS // 8)
        if n == 1:
            assert (np.unpackbits(got[0]) == one).all()
        half = lines.simhash(np.concatenate((tokens, tokens)), np.array([0, 2 * n]))
        assert (half[0] == got[0]).all()


def cut(df, **more):
    rows = lines.drop_repeated_lines(df, **more).select("row.doc_id", "row.text", "n_lines", "n_removed").collect()
    return sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in rows), key=repr)


def test_lines_exact_and_near(spark):
    rng = random.Random(8)
    body = [f"word{rng.randrange(10**6)}" for _ in range(120)]
    near = list(body)
    near[60] = "changed"
    one, two = " ".join(body), " ".join(near)
    short = "too short"
    texts = {
        1: f"{short}\n{one}\nThis line stands here alone, truly.",
        2: f"{short}\n{two}\nAnother line that has a life of its own.",
        3: one.upper() + "!!!\n" + short,
        4: "this   line stands HERE alone -- truly",
        5: "",
    }
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], DOCS)
    got = {i: (t, n, gone) for i, t, n, gone in cut(df)}
    assert got[1] == (texts[1], 3, 0)
    assert got[2] == (f"{short}\nAnother line that has a life of its own.", 3, 1)
    assert got[3] == (short, 2, 1)
    assert got[4] == ("", 1, 1)
    assert got[5] == ("", 1, 0)


@pytest.mark.parametrize("n, k", [(10, 1), (20, 1), (20, 2), (30, 3), (50, 5), (60, 3), (60, 6)])
def test_lines_share_a_band(n, k):
    """Of brute-force near pairs, 0.9 or more are candidates; words are drawn from few, so many repeat."""
    rng = np.random.default_rng(n + k)
    pairs, many = [], 2000
    for _ in range(many):
        x = rng.integers(0, 200, n, dtype=np.int32)
        y = x.copy()
        y[rng.choice(n, k, replace=False)] = rng.integers(1000, 10**9, k, dtype=np.int32)
        pairs += [x, y]
    assert lines.within_edits(pairs[::2], pairs[1::2], 90).all()
    start = np.arange(0, (2 * many + 1) * n, n)
    got = lines.bands(np.concatenate(pairs).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), start)
    assert (got[::2] == got[1::2]).any(axis=1).mean() >= 0.9


def test_lines_near_recall(spark):
    """Lines of 10 to 60 words with as many words changed as 0.9 allows lose their later copy."""
    rng = random.Random(12)
    texts = {}
    for k in range(400):
        x = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(10, 60))]
        y = list(x)
        for at in rng.sample(range(len(x)), len(x) // 10):
            y[at] = f"changed{rng.randrange(10**6)}"
        texts[2 * k], texts[2 * k + 1] = " ".join(x), " ".join(y)
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], DOCS)
    gone = {i for i, _, _, n in cut(df) if n}
    assert all(i % 2 for i in gone) and len(gone) >= 360


def test_lines_are_fetched_in_one_pass(spark, monkeypatch):
    """Both rounds of comparisons read the words of their lines from one table, made in one pass."""
    passes, fetch = [], lines._wanted_lines
    monkeypatch.setattr(lines, "_wanted_lines", lambda *a: passes.append(a) or fetch(*a))
    body = [f"word{k}" for k in range(40)]
    texts = {k: " ".join(f"x{k}" if i == 7 * k % 40 else w for i, w in enumerate(body)) for k in range(6)}
    texts[6] = " ".join(body[:20] + [f"other{k}" for k in range(20)])
    df = spark.createDataFrame([(k, f"{t}\nline {k}", "en", "s", 1) for k, t in texts.items()], DOCS)
    got = {i: (n, gone) for i, _, n, gone in cut(df, short=True)}
    assert got == {0: (2, 0), **{k: (2, 1) for k in range(1, 6)}, 6: (2, 0)}
    assert len(passes) == 1


def test_kept_tables_leave_no_shuffle_files(spark):
    """Once a table is written its shuffle files go, without waiting for the driver's garbage."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in map(str, files.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}

    before = shuffled()
    table = store.kept(spark.range(1000).repartition(5, "id"))
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffled() - before and table.count() == 1000


def test_shared_entries_have_one_hub_a_key(spark):
    """Keys of few entries have their smallest id as hub, whatever order the entries come in."""
    rows = [(k % 50, (k * 7919) % 100003, 1) for k in range(400)]
    shared, _ = links.shared_entries(spark.createDataFrame(rows, "key long, id long, size int").repartition(4))
    got = shared.groupBy("key").agg(F.count("*").alias("n"), F.collect_set("hub_id").alias("hubs")).collect()
    least = {k: min(i for key, i, _ in rows if key == k) for k in range(50)}
    assert {r.key: r.n for r in got} == dict.fromkeys(range(50), 8)
    assert sum(least[r.key] in r.hubs for r in got) == 50 and sum(len(r.hubs) == 1 for r in got) >= 40


def test_lines_short_ones_and_scripts_without_blanks(spark):
    passage = "".join(chr(0x4E00 + 37 * k) for k in range(60))
    changed = passage[:30] + "々" + passage[31:]
    thai = "".join(chr(0x0E01 + k % 40) for k in range(50))
    texts = {
        1: f"Read more\n{passage}\n--\n\n{thai}",
        2: f"read MORE!\n{changed}\n--\n\n{thai[:20]}ฯ{thai[21:]}",
        3: "Read\n目次\n--",
        4: "目次\n\n章 Read more",
    }
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], DOCS)
    got = {i: (t, gone) for i, t, _, gone in cut(df, short=True)}
    assert got == {1: (texts[1], 0), 2: ("--\n", 3), 3: (texts[3], 0), 4: ("\n章 Read more", 1)}


def test_lines_words():
    texts = ["ab中文c é😀x", "", "ไทย", "カナ、a", "中", "ﾊﾝx 𠀀𠀁"]
    column = [t.encode() for t in texts]
    part = arrays.Part(0, np.frombuffer(b"".join(column), dtype=np.uint8), np.cumsum([0, *map(len, column)]))
    found = lines._words(part)
    got = [[] for _ in texts]
    for a, b, row in zip(found.starts, found.ends, found.row, strict=True):
        got[row].append(part.data[a:b].tobytes().decode())
    assert got == [["ab", "中", "文", "c", "é😀x"], [], list("ไทย"), list("カナ、a"), ["中"], ["ﾊ", "ﾝ", "x", "𠀀", "𠀁"]]


def test_lines_parities_bound_edits():
    rng = np.random.default_rng(6)
    words = [rng.integers(-(2**31), 2**31, n).astype(np.int32) for n in (9, 30, 300)]
    other = [np.append(np.delete(w, [1, 5]), np.int32(7)) for w in words]
    changed = np.bitwise_count(lines._parities(words) ^ lines._parities(other)).sum(axis=1)
    assert (changed <= 2 * 3).all() and (changed % 2 == 1).all()


def test_lines_against_plain(spark):
    """Exact repeats always go, all others only for a near line; one of each group stays."""
    rng = random.Random(11)
    pool = copies(rng, [f"word{k}" for k in range(300)], 3)
    texts = {k: "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for k in range(60)}
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], DOCS)
    left = {i: t.split("\n") if gone < n else [] for i, t, n, gone in cut(df)}
    words = {w: plain.alnum_words(w) for w in pool}
    stay = [w for i in left for w in left[i] if len(words[w]) >= 5]
    assert len(stay) == len({tuple(words[w]) for w in stay})
    for i, text in texts.items():
        for w in text.split("\n"):
            if len(words[w]) < 5:
                assert w in left[i]
            elif w not in left[i]:
                assert any(plain.edits(words[w], words[v]) * 10 <= max(len(words[w]), len(words[v])) for v in pool if v != w) or w in stay


def test_lines_hard_rows(hard, empty):
    got = cut(hard)
    assert len(got) == len(HARD)
    assert (0, HARD[6][1], 1, 0) in got
    assert (1, None, 0, 0) in got
    assert (9, "the same old line again and again", 5, 4) in got
    assert cut(empty) == []
