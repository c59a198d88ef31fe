"""Queries over tables that are folders of files."""

from checks.queries import REGISTRY


def _tables(spark, folder):
    rows = [(k, "wiki" if k % 2 else "books", f"el.innerHTML = x{k};\neval(y);") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_streams_read_a_table_of_many_files(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    found = REGISTRY["stream_scan"][0](spark, sf)
    assert {r.path for r in found.collect()} == {f"docs/{k}.ts" for k in range(40)}
    scores = {r.project_id: r.total for r in REGISTRY["stream_project_scores"][0](spark, sf).collect()}
    assert sorted(scores) == ["books", "wiki"]
    assert sum(scores.values()) == found.count()
