"""A corpus pipeline: five stages, each on all documents that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orequarry.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from orequarry.llm.storage import materialize

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _text_hash() -> Column:
    return F.xxhash64(F.col("text"))


def _once(docs: DataFrame, *group: Column) -> DataFrame:
    """One row of each group: the longest text, then the smallest hash."""
    best = Window.partitionBy(*group).orderBy(F.char_length("text").desc_nulls_last(), _text_hash())
    return docs.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").select(*COLUMNS)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no text (null, empty, blank), or no letter in it.

    The others stay as they are, rows that repeat an id or a text too, each by its own text; rows without
    an id go; no rows give no rows. A model without languages (no labelled document) would reject all, so
    then only texts without a letter go.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    model = language_id.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language_id.predict(docs, model, text_hash=True).where(F.col("lang_pred") != language_id.UNKNOWN)
    chosen = found.select("doc_id", F.col("text_hash").alias("__hash")).distinct()
    return docs.withColumn("__hash", _text_hash()).join(chosen, ["doc_id", "__hash"], "left_semi").select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one row stays: the longest, then the smallest id.

    Null, empty and blank texts are equal. Rows that repeat an id are told apart by their texts, and of
    equal ones one stays; rows without an id go; no rows give no rows.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    kept = exact_dedup.exact_dedup(docs).where("kept").select("doc_id", F.unhex("text_sha256").alias("__digest")).distinct()
    digest = F.unhex(F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), exact_dedup.WHITE, ""), 256))
    rows = docs.withColumn("__digest", digest).join(kept, ["doc_id", "__digest"], "left_semi")
    return _once(rows, F.col("doc_id"), F.col("__digest"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at Jaccard 0.8 over five-word shingles the smallest id stays, in one row.

    Texts without words are linked with nothing and stay. Rows that repeat an id are told apart by their
    texts: of those in one group the longest stays, and of rows equal in id and text one; rows without an
    id go; no rows give no rows.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    linked = jaccard_join.jaccard_components(docs, words=5, percent=80)
    group = F.coalesce("group_class", "text_hash").alias("__group")  # no class: a text without words
    kept = linked.where("doc_id = component_id").select("doc_id", F.col("text_hash").alias("__hash"), group).distinct()
    rows = docs.withColumn("__hash", _text_hash()).join(kept, ["doc_id", "__hash"])
    return _once(rows, F.col("doc_id"), F.col("__group"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its share of the mix asks for: taken words, rounded to whole documents.

    A document that the mix takes in part counts once if at least half of it is taken; one that is
    taken twice comes twice. Documents without words (null, empty, blank), of which nothing can be taken,
    stay out, as do rows without an id. Rows that repeat an id come as often as the one of them that is
    taken most; no rows give no rows.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    mixed = mixing.mix_sources(docs).where("size > 0 AND 2 * taken >= size")
    times = F.when(2 * F.col("taken") >= 3 * F.col("size"), 2).otherwise(1)
    chosen = mixed.select("doc_id", times.alias("times")).groupBy("doc_id").agg(F.max("times").alias("times"))
    repeated = docs.select(*COLUMNS).join(chosen, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of the text decoded from them.

    One row for each row, in any order: repeated ids and texts and a null id are kept; null, empty and
    blank texts have no ids and decode to the empty text; no rows give no rows.
    """
    return bpe.bpe_digests(bpe.bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json")), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_known_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mixing", mix_to_weights),
    ("BPE encoding", encode),
]

#: The language model and the tokenizer have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
