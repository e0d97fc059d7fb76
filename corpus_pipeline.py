"""A corpus made ready for training: language, exact and near copies, benchmark items, mixture.

``STAGES`` lists the stages; each takes ``(spark, docs, sf_dir)`` and returns what stays of ``docs``, which is
written as Parquet and read again for the next one.  ``run`` applies them to the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.operators.staging import stored
from wattframe.llm.decontaminate import benchmark_matches
from wattframe.llm.exact import distinct_texts
from wattframe.llm.language import UNKNOWN, held_out, predict_language, train_language_model
from wattframe.llm.mixing import mixed
from wattframe.llm.ngram_join import similar_classes
from wattframe.llm.queries import source_targets, table

#: The least probability of the likeliest language; lower ones, and texts without a letter, are rejected.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model, trained on three quarters of them, knows."""
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang", held_out("doc_id", 4, 2).alias("held_out"))
    model = train_language_model(rows.where("NOT held_out"))
    found = predict_language(docs.select("text", F.struct("*").alias("doc")), model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return distinct_texts(docs)


def one_of_similar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word shingles connect the one with the least id (and text hash); documents without words stay."""
    found = stored(similar_classes(docs, n=5, percent=75), "pipeline-near")
    words = found.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("id", "tx")).alias("k")).select("k.*")
    stays = words.union(found.where("group IS NULL").select("id", "tx").distinct()).alias("s")
    rows = docs.select("*", F.xxhash64("text").alias("__tx")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.id")) & F.col("d.__tx").eqNullSafe(F.col("s.tx"))
    kept = rows.join(stays, same, "left_semi")
    return kept.dropDuplicates(["doc_id", "__tx"]).drop("__tx")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("doc"))
    found = benchmark_matches(rows, table(spark, sf_dir, "benchmark"), keep=("doc",))
    return found.where(F.size("matches") == 0).select("doc.*")


def in_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, with their ``slot`` and ``place``."""
    laid = mixed(docs, source_targets(docs), keep=tuple(docs.columns))
    ordered = laid.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return ordered.select("kept.*", "slot", "place")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equal_texts),
    ("ngram_jaccard_join", one_of_similar_texts),
    ("benchmark_decontamination", without_benchmark),
    ("mixing", in_mixture),
]

#: SQL cannot express the language model or the edit distances; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
