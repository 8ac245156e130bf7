"""Queries of the llm operators with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orequarry.llm import bpe, exact_dedup, jaccard_join, language_id, language_model, mixing, paragraph_dedup, quality, toxicity, vector_search

#: The vocabulary that op9 and the pipeline encode with.
VOCABULARY = "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir), words=4, percent=85)


def _labels(spark: SparkSession, sf_dir: str, label: str, folds: int, held_out: int) -> DataFrame:
    """doc_id and label of the rows that may be learnt from."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    return rows.where(language_id.fold(F.col("doc_id"), folds) != held_out)


def op2_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.quality_scores(_documents(spark, sf_dir), _labels(spark, sf_dir, "quality", 5, 0))
    return made.select("doc_id", (language_id.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op3_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.train(docs.where(language_id.fold(F.col("doc_id"), 5) != 0))
    made = language_id.predict(docs, model)
    return made.select("doc_id", (language_id.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op5_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = toxicity.toxicity_scores(_documents(spark, sf_dir), _labels(spark, sf_dir, "toxic", 3, 1))
    return made.select("doc_id", (language_id.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "evidence")


def op6_robust_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vector_search.nearest_vectors(vectors, vectors.where("vec_id % 20 = 0"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = language_id.fold(F.col("doc_id"), 7)
    made = language_model.lm_scores(_documents(spark, sf_dir), fold != 2)
    return made.withColumn("held_out", fold == 2)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(bpe.bpe_encode(_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY)))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.paragraph_duplicates(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_quality_bradley_terry, op3_language_backoff, op4_exact_dedup, op5_toxicity_neighbours,
        op6_robust_graph_search, op7_language_model, op8_source_mixing, op9_bpe, op10_paragraph_dedup,
    )
}
ORACLE_SQL = {"op4_exact_dedup": exact_dedup.SQL}
