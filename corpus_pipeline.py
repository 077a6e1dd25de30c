"""From raw documents to packed training sequences, in five stages; each works on all its predecessor kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. Between stages the rows are written as Parquet to the folder
in spark.checkpoint.dir and read again, so a lost executor repeats at most one stage. All stages but the last return the
columns of ``documents``. The stages set the session's bytes per Arrow batch (see ``small_batches``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourselake.llm.common import shared_checkpoints, small_batches
from bourselake.llm.language_id import UNKNOWN, predict, train
from bourselake.llm.near_dedup import near_duplicates
from bourselake.llm.packing import best_fit
from bourselake.llm.quality import fit, resample
from bourselake.llm.queries import learnable
from bourselake.llm.substring_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Share of the likelihood that the best language must have.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no learned language: null, without a letter, or undecided between several."""
    small_batches(spark)
    named = predict(docs, train(learnable(docs)), keep=COLUMNS)
    return named.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that importance resampling leaves out."""
    small_batches(spark)
    ratio = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return resample(docs, ratio, keep=COLUMNS).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, the one with the smallest doc_id; rows without doc_id come last.

    Groups are of rows: a number of the whole row stands for the doc_id, and of equal rows one stays.
    """
    small_batches(spark)
    keyed = docs.withColumn("_row", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in COLUMNS]))
    groups = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    owners = keyed.select("_row", F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"), "_row").alias("at"))
    groups = groups.distinct().join(owners, "_row").groupBy("component_id").agg(F.min("at").alias("at"))
    kept = keyed.join(groups.select(F.col("at._row").alias("_row")), "_row", "left_semi")
    return kept.dropDuplicates(["_row"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated paragraphs out of all documents but the first; a document of which nothing is left goes."""
    small_batches(spark)
    cleaned = remove_repeats(docs, keep=COLUMNS)
    cleaned = cleaned.filter((F.size("removed") == 0) | (F.trim("cleaned") != ""))
    return cleaned.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document in training sequences; after the dedup stages equal texts are the only clusters left."""
    small_batches(spark)
    return best_fit(docs)


STAGES = [("language_id", language), ("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: SQL cannot express the language and quality models; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a written table between each two."""
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
