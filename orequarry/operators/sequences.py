"""Pairwise global alignment: cost, traceback and a linear-space form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The gap cost and the cost of each mismatch.
GAP = 30
MISMATCH = {"AC": 110, "AG": 48, "AT": 94, "CG": 118, "CT": 48, "GT": 110}
_ALPHABET = "ACGT"


def _costs() -> np.ndarray:
    table = np.zeros((4, 4), np.int64)
    for pair, cost in MISMATCH.items():
        i, j = (_ALPHABET.index(c) for c in pair)
        table[i, j] = table[j, i] = cost
    return table


_COSTS = _costs()


def _codes(text: str) -> np.ndarray:
    return np.array([_ALPHABET.index(c) for c in text], np.int64)


def last_row(a: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Costs of aligning all of a with each prefix of b. A row's own left-to-right gaps are one running minimum."""
    steps = np.arange(len(b) + 1) * GAP
    row = steps.copy()
    if keep is not None:
        keep.append(row)
    for x in a:
        best = np.concatenate([[row[0] + GAP], np.minimum(row[1:] + GAP, row[:-1] + _COSTS[x, b])])
        row = np.minimum.accumulate(best - steps) + steps
        if keep is not None:
            keep.append(row)
    return row


def cost(a: str, b: str) -> int:
    return int(last_row(_codes(a), _codes(b))[-1])


def align(a: str, b: str) -> tuple[int, str, str]:
    """Cost and both strings with gaps, by divide and conquer: memory grows with one string only."""
    x, y = _codes(a), _codes(b)
    if len(x) <= 64 or len(y) <= 1:
        return _small(a, b)
    half = len(x) // 2
    split = int(np.argmin(last_row(x[:half], y) + last_row(x[half:][::-1], y[::-1])[::-1]))
    left, right = align(a[:half], b[:split]), align(a[half:], b[split:])
    return left[0] + right[0], left[1] + right[1], left[2] + right[2]


def _small(a: str, b: str) -> tuple[int, str, str]:
    x, y = _codes(a), _codes(b)
    rows: list[np.ndarray] = []
    last_row(x, y, rows)
    i, j, out_a, out_b = len(x), len(y), [], []
    while i or j:
        if i == 0 or (j and rows[i][j] == rows[i][j - 1] + GAP):  # a gap in the first string comes before others
            out_a.append("_")
            out_b.append(b[j - 1])
            j -= 1
        elif j == 0 or rows[i][j] == rows[i - 1][j] + GAP:
            out_a.append(a[i - 1])
            out_b.append("_")
            i -= 1
        else:
            out_a.append(a[i - 1])
            out_b.append(b[j - 1])
            i, j = i - 1, j - 1
    return int(rows[-1][-1]), "".join(out_a[::-1]), "".join(out_b[::-1])


def _cost_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else cost(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def _align_series(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([align(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["cost", "a", "b"])


def alignment_cost(a: Column, b: Column) -> Column:
    """Cost of aligning two strings; null where either is null."""
    return F.pandas_udf(_cost_series, "long")(a, b)


def alignment(a: Column, b: Column) -> Column:
    return F.pandas_udf(_align_series, "cost long, a string, b string")(a, b)


def aligned(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds cost, aligned_a and aligned_b; null strings count as empty."""
    made = pairs.withColumn("__al", alignment(F.col(a), F.col(b)))
    return made.select(*pairs.columns, F.col("__al.cost").alias("cost"), F.col("__al.a").alias("aligned_a"), F.col("__al.b").alias("aligned_b"))
