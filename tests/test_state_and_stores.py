"""Streams with state, history scan by scan, documents that appear at once, trees in any store."""

import os
import random

import pytest
from pyspark.sql import functions as F

from scanloom.operators import findings, history
from scanloom.plans import scan, storage
from scanloom.sources import documentsink, store, tree
from scanloom.streaming import tracked

from .test_sources import roots  # noqa: F401

FILES = "project_id string, path string, content string"


# --- streams -------------------------------------------------------------------------------------


def test_stream_takes_findings_back(spark, tmp_path):
    """Batches in any order, repeated names and late examples end as a whole scan does."""
    rng = random.Random(3)
    rows = [("p", "a/.env", "A=1"), ("p", "a/.env.example", None), ("p", "b/.env", "B=1"), ("q", ".env", "C=1"), ("q", "prod.env", "D=1")]
    rows += [("q", "x/.env", ""), ("q", "x/.env.example", None), ("r", "src/a.ts", "eval(x)\ncors()"), ("r", "src/b.ts", "ok"), ("s", "c.ts", "ok")]
    arriving, target = f"{tmp_path}/in", f"{tmp_path}/out"
    os.makedirs(arriving)
    order = rng.sample(rows, len(rows))
    batches = [order[:3], order[3:4], order[4:9], order[9:]]
    # Names come again; content comes once, as it is counted.
    batches.append([(p, path, None) for p, path, _ in rows])
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, FILES).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(FILES).parquet(arriving)
        for query in tracked.track_stream(stream, target):
            query.awaitTermination()
        sofar = [r for b in batches[: k + 1] for r in b]
        names = spark.createDataFrame([(p, path, None) for p, path, _ in sofar], FILES).distinct()
        files = spark.createDataFrame([r for r in sofar if r[2] is not None], FILES)
        want = scan.project_scores(files, names.select("project_id", "path"))
        got = tracked.stream_scores(spark, target)
        pick = ["project_id", "critical", "medium", "low", "total", "score", "passed"]
        seen = {r[2] is not None and r[0] for r in sofar} - {False}
        have = {r.project_id: tuple(r) for r in got.select(pick).collect() if r.project_id in seen}
        assert have == {r.project_id: tuple(r) for r in want.select(pick).collect()}
    open_now = {tuple(r) for r in tracked.missing_examples(spark, target).collect()}
    assert open_now == {("p", "b/.env"), ("q", ".env")}
    # A batch written again replaces its rows.
    again = spark.read.parquet(f"{target}/changes/batch=0")
    rows0 = again.collect()
    spark.createDataFrame(rows0, again.schema).write.mode("overwrite").parquet(f"{target}/changes/batch=0")
    assert {tuple(r) for r in tracked.missing_examples(spark, target).collect()} == open_now


# --- history -------------------------------------------------------------------------------------


def scans(spark, rows):
    columns = "project_id string, ts timestamp, score int, critical int, medium int, low int, files_scanned int"
    return spark.createDataFrame(rows, "project_id string, t long, score int").selectExpr(
        "project_id", "timestamp_seconds(t) AS ts", "score", "1 AS critical", "2 AS medium", "score AS low", "cast(null AS int) AS files_scanned"
    ).to(spark.createDataFrame([], columns).schema)


def test_history_by_scan(spark, tmp_path):
    rng = random.Random(5)
    path = f"{tmp_path}/h"
    batches = [[(f"p{rng.randrange(4)}", rng.randrange(1000), rng.randrange(100)) for _ in range(20)] for _ in range(5)]
    batches[2] = [("p0", k, k) for k in range(30)]
    assert history.read_newest(spark, f"{path}/state").count() == 0
    for version, k in enumerate([0, 3, 3, 1, 4, 2, 0]):
        rows = list({(p, t): (p, t, s) for p, t, s in batches[k]}.values())
        history.append_scan(scans(spark, rows), f"{path}/all", f"scan/{k}")
        history.update_newest(scans(spark, rows), f"{path}/state", f"scan/{k}", version)
        # An update that is repeated, or late, changes nothing.
        history.update_newest(scans(spark, [("p9", 1, 1)]), f"{path}/state", "other", version)
    everything = history.read_scans(spark, f"{path}/all")
    assert everything.count() == sum(len({(p, t) for p, t, _ in b}) for b in batches)
    assert {r[0] for r in everything.select("scan_id").distinct().collect()} == {f"scan/{k}" for k in range(5)}
    got = history.newest_rows(history.read_newest(spark, f"{path}/state"))
    want = history.newest_rows(history.newest_entries(everything))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.n for r in got.groupBy("project_id").agg(F.count("*").alias("n")).collect()} <= set(range(1, 11))


def test_merges_in_any_order(spark):
    parts = [
        history.newest_entries(history.history_entries(scans(spark, [("p", 7 * k + j, j) for j in range(7)])).withColumn("scan_id", F.lit(f"s{k}")))
        for k in range(3)
    ]
    a = history.merge_newest(history.merge_newest(parts[0], parts[1]), parts[2])
    b = history.merge_newest(history.merge_newest(parts[2], parts[2]), history.merge_newest(parts[1], parts[0]))
    assert a.collect() == b.collect() and len(a.first().entries) == 10


# --- orders and kept tables ----------------------------------------------------------------------


def test_report_sorts_in_the_order_of_readers(spark):
    names = ["b.ts", "B.ts", "a-1.ts", "a1.ts", "É.ts", "e.ts", "z.ts", "a/1.ts"]
    rows = [("p", n, 1, "low", "m", "r", "c", 1, k) for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "project_id string, path string, line int, severity string, message string, rule_id string, category string, rule_ordinal int, seq int")
    with storage.settled(spark):
        plain = [r.path for r in findings.report_positions(df).orderBy("by_file").collect()]
        order = findings.report_positions(df, collation="UNICODE")
        assert plain == sorted(names)
        assert [r.path for r in order.orderBy("by_file").collect()] == ["a-1.ts", "a/1.ts", "a1.ts", "b.ts", "B.ts", "e.ts", "É.ts", "z.ts"]
        assert order.columns == findings.report_positions(df).columns


def test_kept_tables_are_dropped(spark):
    with storage.settled(spark):
        df = storage.settle(spark.range(3).selectExpr("id * 7 AS seven"))
        assert df.count() == 3 and df.is_cached
    assert not df.is_cached


# --- documents -----------------------------------------------------------------------------------


def documents(spark, rows):
    return spark.createDataFrame(rows, "project_id string, section int, item int, text string").repartition(5)


def text_of(spark, path):
    out = {}
    for r in sorted(documentsink.read_parts(spark, path).collect(), key=lambda r: (str(r.project_id), r.part)):
        out[r.project_id] = out.get(r.project_id, "") + r.text
    return out


def test_documents_appear_at_once(spark, tmp_path):
    path = f"{tmp_path}/docs"
    assert text_of(spark, path) == {} and documentsink.current_run(path) is None
    first = [(p, s, i, f"{p}{s}.{i}é\n") for p in ("a/b", "c d", "") for s in range(3) for i in range(40)]
    documentsink.write_documents_at_once(documents(spark, first), path)
    want = {}
    for p, _, _, t in first:
        want[p] = want.get(p, "") + t
    assert text_of(spark, path) == want
    # A job of which one task fails leaves the documents as they were.
    run = documentsink.current_run(path)
    bad = documents(spark, [(f"n{k}", 0, 0, "new") for k in range(50)])
    bad = bad.withColumn("text", F.when(F.col("project_id") == "n33", F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        documentsink.write_documents_at_once(bad, path)
    assert documentsink.current_run(path) == run and text_of(spark, path) == want
    documentsink.write_documents_at_once(documents(spark, [("a/b", 0, 0, "new")]), f"file://{path}")
    assert text_of(spark, path) == {"a/b": "new"}


# --- stores --------------------------------------------------------------------------------------


def test_store_equals_tree(spark, roots):  # noqa: F811
    local = sorted(map(tuple, tree.list_tree(spark, roots).collect()))
    assert sorted(map(tuple, store.list_store(spark, roots, 3).collect())) == local
    uris = [f"file://{r}" for r in roots]
    by_uri = sorted((r.path, r.size, r.kind) for r in store.list_store(spark, uris).collect())
    assert by_uri == sorted((p, s, k) for _, _, p, s, k in local)
    listing = store.list_store(spark, roots)
    for limit, task_bytes in ((None, 1 << 20), (10 * 1024 * 1024, 1 << 30)):
        got = store.read_store(listing, limit, task_bytes).collect()
        want = tree.read_files(tree.list_tree(spark, roots), max_bytes=limit).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    missing = store.list_store(spark, [f"{roots[0]}/nowhere"])
    assert [(r.path, r.kind) for r in missing.collect()] == [("./", "unreadable")]
    assert [(r.status, r.error) for r in store.read_store(missing).collect()] == [("read_error", "The folder could not be listed")]


def test_files_are_dealt_by_bytes(spark):
    rng = random.Random(2)
    sizes = [rng.choice([10, 1000, 50_000, 3_000_000]) for _ in range(300)]
    df = spark.createDataFrame([("p", "/", f"{k:05d}", s, "file") for k, s in enumerate(sizes)], tree.LISTING)
    got = store.by_bytes(df.repartition(7), 1_000_000).collect()
    assert len(got) == 300
    ordered = sorted(got, key=lambda r: r.path)
    assert [r.task for r in ordered] == sorted(r.task for r in ordered)
    sums = {}
    for r in ordered:
        sums.setdefault(r.task, []).append(r.size + store.FILE_BYTES)
    # Without its last file no task has more than its share.
    assert all(sum(s[:-1]) <= 1_000_000 for s in sums.values())


def test_a_tree_is_written_in_one_step_a_folder(spark, tmp_path):
    rows = [("a=1/b=1", "x\ny"), ("a=1/b=2", None), ("a=1/b=1", "é"), ("c", "")]
    root = f"{tmp_path}/tree"
    assert store.write_store(spark.createDataFrame(rows, "folder string, text string"), root) == 3
    found = {r.path.rsplit("/", 1)[0]: r for r in store.list_store(spark, [root]).collect()}
    read = {f: open(f"{root}/{r.path}", encoding="utf-8").read() for f, r in found.items()}
    assert read == {"a=1/b=1": "x\ny\né\n", "a=1/b=2": "\n", "c": "\n"}


def test_store_read_writes_its_tree_without_renames(spark, tmp_path):
    """Partitions that Spark commits are moved one by one; they made most of the time."""
    from checks import mechanisms
    from checks.queries import REGISTRY

    assert "partitionBy" not in mechanisms.store_read.__code__.co_names
    rows = [(k, f"s{k}") for k in range(30)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    read = REGISTRY["store_read"][0](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, read)) == [(k, "ok", f"s{k}\neval(x)") for k in range(30)]
