"""Quality by Bradley-Terry: scores from preference pairs, thresholded at a score quantile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orequarry.llm import textnum as T
from orequarry.llm.storage import materialize

FEATURES = (
    "log_words", "word_length", "distinct", "distinct_pairs", "top_word", "upper", "digit", "mark", "other_sign",
    "wide", "lines", "distinct_lines", "short_lines", "bar", "long_words", "one_letter", "marked_words",
)
#: predicted is 1 from this score on; the quantile threshold is mapped to it.
CUT = 0.3
_BYTE = np.zeros(256, np.int64)
_BYTE[65:91] = 1  # upper
_BYTE[48:58] = 2  # digit
_BYTE[[33, 44, 46, 58, 59, 63, 39, 34, 45]] = 3  # usual marks
_BYTE[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126, 40, 41]] = 4
_BYTE[128:] = 5
_BYTE[10] = 6
_BYTE[124] = 7


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, from the whole of it; null and blank texts have zeros but for log_words."""
    at, raw = T.text_bytes(column)
    words, offsets = T.word_hashes(column)
    pairs, pair_at = T.shingle_hashes(words, offsets, 2)
    out = np.zeros((len(at) - 1, len(FEATURES)))
    for i in range(len(at) - 1):
        text, own = raw[at[i] : at[i + 1]], words[offsets[i] : offsets[i + 1]]
        n, size = len(own), max(1, len(text))
        if n == 0:
            continue
        kinds = np.bincount(_BYTE[text], minlength=8) / size
        _, times = np.unique(own, return_counts=True)
        lines = text.tobytes().split(b"\n")
        white = T._WHITE[text]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).astype(np.int8)))
        lengths = edge[1::2] - edge[::2]
        last = text[edge[1::2] - 1]
        out[i] = (
            np.log1p(n), (size - white.sum()) / n, len(times) / n ** 0.9, len(np.unique(pairs[pair_at[i] : pair_at[i + 1]])) / n ** 0.97,
            times.max() / n, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], len(lines) / n, len(set(lines)) / len(lines),
            sum(len(x) < 40 for x in lines) / len(lines), kinds[7], (lengths > 15).mean(), (lengths == 1).mean(), (_BYTE[last] == 4).mean(),
        )
    return out


def _featurise(batches):
    for batch in batches:
        x = features(batch.column("text")).astype(np.float32)
        values = pa.array(x.ravel(), pa.float32())
        offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "x"])


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_featurise, "doc_id long, x array<float>")


class Ranker:
    """A Bradley-Terry model on features: P(a before b) = sigmoid(w . (x_a - x_b))."""

    def __init__(self, mean, scale, weights, threshold: float, slope: float):
        self.mean, self.scale, self.weights, self.threshold, self.slope = mean, scale, weights, threshold, slope

    @staticmethod
    def expand(z: np.ndarray) -> np.ndarray:
        z = np.clip(z, -6, 6)
        return np.hstack([z, z * z])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pairs: int = 120_000, steps: int = 12, ridge: float = 1e-3, seed: int = 7) -> Ranker:
        """x: labelled rows, y: 0 or 1. Without both labels every score is the share of ones."""
        mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            flat = 0.5 if not len(y) else float(y.mean())
            slope = 0.0
            threshold = np.log((flat + 1e-6) / (1 - flat + 1e-6))
            return cls(mean, scale, np.zeros(2 * len(FEATURES)), threshold, slope)
        phi = cls.expand((x - mean) / scale)
        draw = np.random.default_rng(seed)
        a, b = draw.choice(good, pairs), draw.choice(bad, pairs)
        d = phi[a] - phi[b]
        w = np.zeros(d.shape[1])
        for _ in range(steps):  # Newton on the logistic loss of the differences
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            grad = d.T @ (p - 1) / pairs + ridge * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
            w -= np.linalg.solve(hess, grad)
        raw = phi @ w
        # the quantile at the share of zeros, among rows weighted as they occur
        threshold = float(np.quantile(raw, (y == 0).mean()))
        slope = 1.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(slope * (raw - threshold), -30, 30)))
            grad = ((p - y) * (raw - threshold)).mean() + 1e-4 * slope
            slope -= grad / ((p * (1 - p) * (raw - threshold) ** 2).mean() + 1e-4)
            slope = float(np.clip(slope, 1e-3, 1e3))
        return cls(mean, scale, w, threshold, slope)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.expand((x - self.mean) / self.scale) @ self.weights
        if self.slope == 0.0:
            return np.full(len(x), 1 / (1 + np.exp(-self.threshold)))
        shift = np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.threshold) + shift, -500, 500)))


def train(rows: DataFrame, labels: DataFrame, sample: int = 20_000) -> Ranker:
    """rows: doc_id, x; labels: doc_id, label (0 or 1, null: none). At most `sample` labelled rows, by hash of the id."""
    chosen = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    got = rows.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "label").limit(sample).select("label", "x").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return Ranker.fit(x, got["label"].to_numpy().astype(int))


def score_rows(rows: DataFrame, model: Ranker) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> DataFrame:
    """doc_id, score (0 to 1), predicted: one row per row of docs; labels: doc_id, label of the rows to learn from.

    Null and blank texts get the score of a text without words. Repeated rows and a null id are scored
    as they are; other columns are ignored; no rows give no rows. Without labels of both kinds every
    score is the share of ones (0.5 without labels).
    """
    rows = materialize(feature_rows(docs, id_col, text_col))
    return score_rows(rows, train(rows, labels, sample)).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
