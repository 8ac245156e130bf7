"""Fits MLlib's multilayer perceptron: the same layers, loss and first weights, with blocks of rows multiplied at once in single precision.

The rows are written once as blocks of numbers; each pass over them adds loss and gradient up in two steps, so the driver gets
about the root of the number of partitions as rows. Sums of blocks are kept in double precision.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orequarry.operators.scratch import written

#: Rows multiplied at once, so that a layer's outputs stay in the cache.
STEP = 512


class Scale:
    """Matrix of the columns of a batch: missing values filled, less the mean, times the factor."""

    def __init__(self, fill: list[float], mean: list[float], std: list[float]):
        self.fill, self.mean, std = np.array(fill, float), np.array(mean, float), np.array(std, float)
        self.factor = np.divide(1, std, out=np.zeros(len(std)), where=std > 0)  # constant columns are 0, as in StandardScaler

    def __call__(self, batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
        x = np.empty((len(batch), len(columns)))
        for k, c in enumerate(columns):
            x[:, k] = batch.column(c).to_numpy(zero_copy_only=False)
        return ((np.where(np.isnan(x), self.fill, x) - self.mean) * self.factor).astype(np.float32)


def blocks(train: DataFrame, columns: list[str], label: str, scale: Scale) -> DataFrame:
    """x, y: blocks of rows, scaled numbers as float32 and classes as int32."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(label).null_count:
                raise ValueError("a row to learn from has no class")
            y = batch.column(label).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([scale(batch, columns).tobytes()]), pa.array([y.astype(np.int32).tobytes()])], ["x", "y"])

    rows = train.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("int").alias(label))
    return written(rows.mapInArrow(pack, "x binary, y binary"))


def _unpacked(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix (inputs by outputs) and offsets of each layer: views in MLlib's order."""
    out, at = [], 0
    for a, b in zip(layers[:-1], layers[1:], strict=True):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


class Network:
    """Sigmoid layers under a softmax, with room for the outputs of `step` rows, in the precision of the weights."""

    def __init__(self, weights: np.ndarray, layers: list[int], step: int = STEP):
        self.parts, kind = _unpacked(weights, layers), weights.dtype
        self.negative = [(-m, -b) for m, b in self.parts[:-1]]
        self.room = [np.empty((step, n), kind) for n in layers[1:]]
        self.spare = [np.empty((step, n), kind) for n in layers[1:]]
        self.gradient = np.empty(len(weights), kind)
        self.slopes = _unpacked(self.gradient, layers)
        self.at = np.arange(step)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """x, the outputs of the hidden layers, and the last layer's sums."""
        seen = [x]
        with np.errstate(over="ignore"):  # a sigmoid of 0
            for (matrix, offset), room in zip(self.negative, self.room, strict=False):
                z = np.matmul(seen[-1], matrix, out=room[: len(x)])
                z += offset
                np.exp(z, out=z)
                z += 1
                seen.append(np.reciprocal(z, out=z))
        z = np.matmul(seen[-1], self.parts[-1][0], out=self.room[-1][: len(x)])
        z += self.parts[-1][1]
        return [*seen, z]

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the cross-entropies of the rows, and its gradient (valid until the next call)."""
        *seen, z = self.forward(x)
        right = self.at[: len(y)], y
        z -= functools.reduce(np.maximum, z.T)[:, None]
        own = float(z[right].sum(dtype=np.float64))
        delta = np.exp(z, out=z)
        sums = functools.reduce(np.add, z.T)
        loss = float(np.log(sums).sum(dtype=np.float64)) - own
        delta /= sums[:, None]
        delta[right] -= 1
        for k in range(len(self.parts) - 1, -1, -1):
            np.matmul(seen[k].T, delta, out=self.slopes[k][0])
            delta.sum(0, out=self.slopes[k][1])
            if k:
                s = seen[k]
                delta = np.matmul(delta, self.parts[k][0].T, out=self.spare[k - 1][: len(x)])
                delta *= s
                np.subtract(1, s, out=s)
                delta *= s
        return loss, self.gradient


def _objective(rows: DataFrame, layers: list[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean loss and its gradient over the blocks, one job a call."""
    context = rows.sparkSession.sparkContext
    size, groups = sum((a + 1) * b for a, b in zip(layers[:-1], layers[1:], strict=True)), max(1, math.isqrt(rows.rdd.getNumPartitions()))
    kind = "part int, n long, loss double, gradient binary"

    def row(part: int, n: int, loss: float, gradient: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([loss], pa.float64()), pa.array([gradient.tobytes()])]
        return pa.RecordBatch.from_arrays(columns, ["part", "n", "loss", "gradient"])

    def call(weights: np.ndarray) -> tuple[float, np.ndarray]:
        sent = context.broadcast(weights)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            network, n, loss, gradient = Network(sent.value.astype(np.float32), layers), 0, 0.0, np.zeros(size)
            for batch in batches:
                for a, b in zip(batch.column("x"), batch.column("y"), strict=True):
                    x, y = np.frombuffer(a.as_buffer(), np.float32).reshape(-1, layers[0]), np.frombuffer(b.as_buffer(), np.int32)
                    for at in range(0, len(y), STEP):
                        more, slope = network.loss_and_gradient(x[at : at + STEP], y[at : at + STEP])
                        loss += more
                        gradient += slope
                    n += len(y)
            if n:
                yield row(TaskContext.get().partitionId(), n, loss, gradient)

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["part"])  # in one order, so that reruns agree
            if found:
                yield row(found[0]["part"], sum(r["n"] for r in found), sum(r["loss"] for r in found), sum(np.frombuffer(r["gradient"]) for r in found))

        summed = rows.mapInArrow(each, kind).repartition(groups, F.col("part") % groups).mapInArrow(together, kind)
        found = sorted(summed.collect(), key=lambda r: r.part)
        sent.destroy()
        n = sum(r.n for r in found)
        if not n:
            raise ValueError("no rows to learn from")
        return sum(r.loss for r in found) / n, sum(np.frombuffer(r.gradient) for r in found) / n

    return call


def _searched(f: Callable, x: np.ndarray, at: float, slope: np.ndarray, way: np.ndarray, step: float, tries: int = 10) -> tuple | None:
    """A point on the way that meets the strong Wolfe conditions, its loss and gradient; the best found after 2 * tries calls."""
    down, best = float(slope @ way), None
    low, low_loss, low_down, high = 0.0, at, down, None
    for _ in range(2 * tries):
        loss, gradient = f(x + step * way)
        now = float(gradient @ way)
        if math.isfinite(loss) and loss < at and (best is None or loss < best[1]):
            best = x + step * way, loss, gradient
        if not loss <= at + 1e-4 * step * down or loss >= low_loss and low > 0:
            high = step
        elif abs(now) <= -0.9 * down:
            return x + step * way, loss, gradient
        else:
            if now * ((high if high is not None else math.inf) - low) >= 0:
                high = low
            low, low_loss, low_down = step, loss, now
        if high is None:
            step *= 1.5
            continue
        span = high - low
        bend = 2 * (loss - low_loss - low_down * span) if step == high and math.isfinite(loss) else 0.0
        share = -low_down * span / bend if bend > 0 else 0.5
        step = low + span * min(max(share, 0.1), 0.9)
    return best


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """x after at most `rounds` steps of limited-memory BFGS; fewer where the gradient vanishes or no step is better."""
    loss, slope = f(x)
    kept: list[tuple[np.ndarray, np.ndarray, float]] = []
    for k in range(rounds):
        if np.linalg.norm(slope) <= max(tolerance * abs(loss), 1e-8):
            break
        way, alphas = -slope, []
        for s, y, r in reversed(kept):
            alphas.append(r * float(s @ way))
            way = way - alphas[-1] * y
        if kept:
            s, y, r = kept[-1]
            way = way / (r * float(y @ y))
        for (s, y, r), alpha in zip(kept, reversed(alphas), strict=True):
            way = way + (alpha - r * float(y @ way)) * s
        found = _searched(f, x, loss, slope, way, 1.0 if k else 1 / float(np.linalg.norm(way)))
        if found is None:
            break
        s, y = found[0] - x, found[2] - slope
        x, loss, slope = found
        if float(s @ y) > 1e-12:
            kept = [*kept, (s, y, 1 / float(s @ y))][-memory:]
    return x


def first_weights(spark: SparkSession, layers: list[int], seed: int) -> np.ndarray:
    """MLlib's own for the seed."""
    sizes = spark.sparkContext._gateway.new_array(spark._jvm.int, len(layers))
    for k, n in enumerate(layers):
        sizes[k] = n
    return np.array(spark._jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(sizes, True).model(seed).weights().toArray())


def fit(train: DataFrame, columns: list[str], label: str, scale: Scale, layers: list[int], rounds: int, seed: int) -> MultilayerPerceptronClassificationModel:
    """The fitted model of MLlib, for its transform() and files."""
    spark = train.sparkSession
    weights = lbfgs(_objective(blocks(train, columns, label, scale), layers), first_weights(spark, layers, seed), rounds)
    java = spark._jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(f"perceptron_{seed}", _py2java(spark.sparkContext, DenseVector(weights)))
    return MultilayerPerceptronClassificationModel(java)._set(labelCol=label, layers=layers)


def classified(rows: DataFrame, columns: list[str], label: str, scale: Scale, model: MultilayerPerceptronClassificationModel) -> DataFrame:
    """label, prediction: as by the model's transform(), by blocks."""
    weights, layers = np.array(model.weights.toArray()), list(model.getLayers())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(weights.astype(np.float32), layers)
        for batch in batches:
            x = scale(batch, columns)
            best = [network.forward(x[at : at + STEP])[-1].argmax(1) for at in range(0, len(x), STEP)]
            yield pa.RecordBatch.from_arrays([batch.column(label), pa.array(np.concatenate([*best, np.zeros(0)]).astype(float))], [label, "prediction"])

    given = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], label)
    return given.mapInArrow(answer, f"{label} {rows.schema[label].dataType.simpleString()}, prediction double")
