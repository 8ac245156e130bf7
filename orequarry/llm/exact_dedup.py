"""Exact deduplication by a tree-merge of sorted digest runs, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orequarry.llm.storage import materialize

#: Deleted before texts are compared.
WHITE = r"[\x20\x09-\x0D]+"
_KEY = ["digest", "n_bytes", "second"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64) -> DataFrame:
    """One slim row per document: id, code points, SHA-256, two more fingerprints and its run."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(text, WHITE, "")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(text).cast("long").alias("points"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.octet_length(norm).cast("long").alias("n_bytes"),
        F.xxhash64(norm).alias("second"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).alias("run"),
    )


def merge_runs(level: DataFrame, divisor: int) -> DataFrame:
    """One round: `divisor` neighbouring runs become one; equal keys keep the best row and the summed count.

    min() over a struct has no hash form in Spark, so each side sorts its run by the key and merges.
    """
    return (
        level.withColumn("run", F.expr(f"run div {divisor}"))
        .groupBy("run", *_KEY)
        .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 8
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Texts are equal when identical without WHITE; a null text counts as empty, so all empty and blank
    texts form one group. The longest original (code points), then the smallest id, stays; a null id
    sorts first. Rows that repeat an id are counted each and share that id's decision. No rows give no
    rows; columns other than the two named are ignored. An equal SHA-256 is verified: members must also
    agree on the length in bytes and on a second, independent fingerprint.

    Each document belongs to one of `runs` runs. A run holds one row per digest, sorted, so a text with
    any number of copies is at most `runs` rows before the first exchange; the rounds then merge
    `fan_in` runs at a time. Each round is spread over the cluster by (run, digest). On the way back
    the winner goes to each run's row first, then to the documents of that run and digest, so a hot
    text is joined in `runs` pieces.
    """
    rows = materialize(digest_rows(docs, id_col, text_col, runs))
    best = F.min(F.struct((-F.col("points")).alias("rank"), F.col("doc_id").alias("id"))).alias("best")
    leaves = rows.groupBy("run", *_KEY).agg(best, F.count(F.lit(1)).alias("n"))
    root, left = leaves, runs
    while left > 1:
        root = merge_runs(root, fan_in)
        left = -(-left // fan_in)
    root = root.select(*_KEY, F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))
    per_run = leaves.select("run", *_KEY).join(root, _KEY)
    return rows.join(per_run, ["run", *_KEY]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH h AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
