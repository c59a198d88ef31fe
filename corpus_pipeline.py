"""From documents to a training mix: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import decontaminate, jaccard, lines, mixing, quality, store


def _named(docs: DataFrame) -> DataFrame:
    """All columns as one struct, so that no name clashes, beside what identifies a document."""
    return docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("version"),
    )


def _on(id_: str, version: str):
    return F.col("id").eqNullSafe(F.col(id_)) & (F.col("version") == F.col(version))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good.

    A null text is judged as an empty one; rows with null or repeated ids are judged one by one, by their
    whole text. All columns, whatever their names, go on as they are; an empty table stays empty.
    """
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere already; those cut down to no word go.

    ``n_chars``, if there is such a column of a numeric type, follows the text.
    """
    cut = lines.drop_repeated_lines(docs, short=True)
    cut = cut.where((F.col("n_removed") == 0) | F.col("row.text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    kinds = dict(docs.dtypes)
    row = F.col("row")
    if kinds.get("n_chars") in ("int", "bigint"):
        chars = F.when(F.col("n_removed") > 0, F.length("row.text")).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", chars.cast(kinds["n_chars"]))
    return cut.select(row.alias("row")).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose 5-word shingles are alike to 0.8 or more, the one with the smallest id.

    Rows without an id are in no group and stay. Of rows that repeat an id and text one stays.
    """
    groups = jaccard.jaccard_groups(docs, words=5, percent=80)
    stay = groups.where("doc_id is null or doc_id = component_id").select(
        F.col("doc_id").alias("stay_id"), F.col("version").alias("stay_version")
    )
    kept = _named(docs).join(stay, _on("stay_id", "stay_version"), "left_semi")
    alone = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    return kept.withColumn("alone", alone).dropDuplicates(["id", "version", "alone"]).select("row.*")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages.

    Null and empty texts hold none and stay. Rows without an id are judged by their text like all others; rows
    that repeat an id and text alike. Whole texts are searched; all columns go on as they are; an empty table stays empty.
    """
    found = decontaminate.find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = decontaminate.contamination(found).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version"))
    return _named(docs).join(bad, _on("bad_id", "bad_version"), "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``mix_times`` (how often) and ``mix_target`` (their source's
    words). Columns of these names are replaced. Rows that repeat an id and text are taken alike."""
    plan = store.kept(mixing.mix(docs).where("times > 0"))
    plan = plan.groupBy("doc_id", "version").agg(F.max("times").alias("mix_times"), F.max("target").alias("mix_target"))
    plan = plan.withColumnsRenamed({"doc_id": "plan_id", "version": "plan_version"})
    joined = _named(docs).join(plan, _on("plan_id", "plan_version"))
    row = F.col("row").withField("mix_times", F.col("mix_times")).withField("mix_target", F.col("mix_target"))
    return joined.select(row.alias("row")).select("row.*")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("mixing sources to target weights", mixed),
]

#: The classifier's first stage has no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
