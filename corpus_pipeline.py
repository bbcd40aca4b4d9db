"""Corpus preparation in stages: each takes (spark, docs, sf_dir) and returns the documents that it keeps; the last packs them.

Null and empty texts pass through; extra columns of documents are kept up to packing. Rows that share a doc_id share
the decisions on it; rows with a null doc_id are never removed as copies or as contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom.llm.columns import unused
from pipeloom.llm.decontaminate import find_contamination
from pipeloom.llm.line_dedup import drop_repeated_lines
from pipeloom.llm.near_duplicates import near_duplicates
from pipeloom.llm.packing import pack
from pipeloom.llm.quality import score_quality, train_quality
from pipeloom.shared import load, staged

BROADCAST_IDS = 2_000_000
METADATA = ("n_chars",)
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS documents at once between the JVM and Python workers, in this session from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but those with a doc_id in gone."""
    gone = staged(gone.select("doc_id").distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:  # 8 bytes each; beyond it the join shuffles
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more by the factorisation machine."""
    _small_batches(spark)
    labels = load(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = train_quality(docs, labels, metadata=METADATA)
    [score] = unused(docs, "score")
    return score_quality(docs, model, metadata=METADATA, score_col=score).filter(F.col(score) >= 0.5).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those of which nothing is left go."""
    _small_batches(spark)
    left = drop_repeated_lines(docs).filter("n_removed = 0 or n_removed < n_lines")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*(f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates."""
    _small_batches(spark)
    return _without(docs, near_duplicates(docs, words=5, percent=80).filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    _small_batches(spark)
    return _without(docs, find_contamination(docs, load(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096."""
    _small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=4096, end=2)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
