"""A training corpus from raw documents: language, near duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared folder and reads it again as the next
stage's documents. All stages but the last return the columns of ``documents``, with ``n_chars`` following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm import jaccard, langid, packing, pii, suffixes
from sheetloom.llm.common import keep
from sheetloom.sources.splits import pin

ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.3


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that no language explains; a clear language stays whatever its label says."""
    net = langid.fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"), F.lit(True))
    named = langid.predict(docs.select(*COLUMNS), net)
    return _documents(named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)))


def _with_row(docs: DataFrame) -> DataFrame:
    """Documents with a number for every row, so that rows without an id or with a repeated one are documents like others.

    In a table read from files, which is what stages get, the number follows from how Spark cuts the files, and ``pin`` keeps that the same for all jobs of a
    stage. Other frames may come in another order in every job and are written first.
    """
    pin(docs.sparkSession)
    rows = docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id())
    return rows if docs.inputFiles() else keep(rows, "numbered")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word five-grams at a similarity of 0.8 or more one stays: that with the smallest id, rows without one last, then the first row."""
    rows = _with_row(docs)
    groups = jaccard.similar_components(rows.select(F.col("_row").alias("id"), "text"), 5, 4, 5).select("id", "component_id")
    linked = groups.where(F.col("id") != F.col("component_id"))
    members = linked.unionByName(linked.select(F.col("component_id").alias("id"), "component_id").distinct())
    members = keep(members.join(rows.select(F.col("_row").alias("id"), "doc_id"), "id"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id"))["id"].alias("_row"))
    gone = members.select(F.col("id").alias("_row")).join(first, "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more are cut; a document that is nothing but copies stays with an empty text."""
    return _documents(suffixes.without_copies(_with_row(docs), "_row"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, addresses and dates become pseudonyms under the key of the session."""
    return _documents(pii.pseudonymised(docs.select(*COLUMNS), pii.session_key(spark)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 8192 characters, none with two documents of one source or duplicate cluster."""
    return packing.packed_texts(docs)


STAGES = [
    ("language id", language),
    ("n-gram jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("pii", personal_data),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
