"""The stages of the pipeline one by one, the registered queries, and the SQL of two of them."""

import os

import pytest

import corpus_pipeline
from checks.compare import database, difference
from scanloom.llm import quality, queries

from . import plain
from .plain import DOCS, HARD, with_more_columns

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_with_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), database(SF), queries.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_queries_return_a_row_each(spark, documents, name):
    table = "embeddings" if name == "op5_near_vectors" else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.SQL) <= set(entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier"


def test_quality_stage(spark, documents):
    kept = texts(corpus_pipeline.good_quality(spark, documents, SF))
    scores = quality.score(documents, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(kept) == {r.doc_id for r in scores if r.predicted == 1}


def test_lines_stage(spark, documents):
    kept = texts(corpus_pipeline.without_repeated_lines(spark, documents, SF))
    before = texts(documents)
    seen = {}
    for i in sorted(before):
        for line in (before[i] or "").split("\n"):
            if len(words := tuple(plain.alnum_words(line))) >= 5:
                seen.setdefault(words, i)
    for i, text in kept.items():
        for line in text.split("\n"):
            if len(words := tuple(plain.alnum_words(line))) >= 5:
                assert seen[words] == i
        assert set(text.split("\n")) <= set(before[i].split("\n"))
    for r in corpus_pipeline.without_repeated_lines(spark, documents, SF).select("text", "n_chars").collect():
        assert r.n_chars == len(r.text)


def test_lines_stage_drops_copies_whole(spark):
    """Copies go with their blank lines and short titles; what no line was taken from stays."""
    copy = "A Title\n\nThe first of the paragraphs that stand here.\n--\n\nAnother one, which is the last of them."
    rows = {1: copy, 2: copy, 3: copy.upper(), 4: copy + "\nMore", 5: "\n--\n", 6: "", 7: None, 8: copy + "\n\n***"}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows.items()], DOCS)
    kept = texts(corpus_pipeline.without_repeated_lines(spark, docs, SF))
    assert kept == {1: copy, 4: "\n--\n\nMore", 5: rows[5], 6: "", 7: None}


def test_group_stage(spark, documents):
    kept = texts(corpus_pipeline.one_of_each_group(spark, documents, SF))
    groups = plain.jaccard_groups(texts(documents), 5, 80)
    assert set(kept) == {i for i, (_, smallest) in groups.items() if i == smallest}


def test_benchmark_stage(spark, documents):
    kept = texts(corpus_pipeline.without_benchmarks(spark, documents, SF))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = plain.contamination(texts(documents), items)
    assert set(kept) == {i for i, (n, hit, _) in found.items() if not (hit and 20 * hit >= n)}
    assert any(hit for _, hit, _ in found.values())


def test_mix_stage(spark, documents):
    rows = corpus_pipeline.mixed(spark, documents, SF).collect()
    taken = {r.doc_id: r.taken for r in queries.op1_mix_sources(spark, SF).collect()}
    assert {r.doc_id: r.mix_times * len(plain.blank_words(r.text)) for r in rows} == {
        r.doc_id: taken[r.doc_id] for r in rows
    }
    assert all(taken[i] == 0 for i in set(taken) - {r.doc_id for r in rows})


def test_run_is_the_stages(spark, documents):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} <= set(texts(documents))
    assert all(1 <= r.mix_times <= 3 for r in rows)


def test_stages_with_hard_rows(spark):
    hard = with_more_columns(spark.createDataFrame(HARD, DOCS))
    for docs in (hard, hard.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            extra = [c for c in out.columns if c not in docs.columns]
            assert out.columns[: len(docs.columns)] == docs.columns and (not extra or name == corpus_pipeline.STAGES[-1][0])
            rows = out.collect()
            assert all(r["row"] == "row" and r["score"] == "score" for r in rows)
    groups = corpus_pipeline.one_of_each_group(spark, hard, SF).collect()
    assert sorted(r.doc_id or 0 for r in groups) == [0, 0, 1, 2, 3, 4, 7, 8, 9]
