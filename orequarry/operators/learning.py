"""Models on feature tables: boosted trees, grid search, feature elimination, selectors and a small network."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orequarry.operators import perceptron


def with_missing_flags(table: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Doubles with NaN for null and a 0/1 column for each, since trees here have no branch for missing values."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in columns}
    numbers = {c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns}
    return table.withColumns(flags).withColumns(numbers), [*columns, *flags]


def _stages(columns: list[str]) -> list:
    filled = [f"{c}_filled" for c in columns]
    return [Imputer(inputCols=columns, outputCols=filled, strategy="mean"), VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep")]


def boosted_regression(train: DataFrame, columns: list[str], label: str, trees: int = 50, depth: int = 5, rate: float = 0.1, subsample: float = 1.0, features: str = "all", seed: int = 7) -> PipelineModel:
    model = GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=features, seed=seed)
    return Pipeline(stages=[*_stages(columns), model]).fit(train)


#: Parameters of the tuned model, as far as these trees have them.
TUNED = {"trees": 500, "depth": 5, "rate": 0.1, "subsample": 0.8, "features": "0.8"}


def boosted_selector(train: DataFrame, columns: list[str], label: str, trees: int = 50, depth: int = 5, seed: int = 7) -> PipelineModel:
    """Which of two models is closer: a boosted classifier; its probability column is the soft form."""
    model = GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_stages(columns), model]).fit(train)


def grid_search(train: DataFrame, columns: list[str], label: str, grid: dict[str, list], folds: int = 3, metric: str = "r2", trees: int = 10) -> DataFrame:
    """One row for each point of the grid with its mean metric over the folds; best first."""
    model = GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, seed=7)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(model, name), values)
    points = builder.build()
    ready = Pipeline(stages=_stages(columns)).fit(train).transform(train).select("features", label).cache()
    found = CrossValidator(estimator=model, estimatorParamMaps=points, evaluator=RegressionEvaluator(labelCol=label, metricName=metric), numFolds=folds, seed=7).fit(ready)
    ready.unpersist()
    rows = [(", ".join(f"{p.name}={v}" for p, v in point.items()), float(m)) for point, m in zip(points, found.avgMetrics, strict=True)]
    return train.sparkSession.createDataFrame(rows, "params string, metric double").orderBy(F.desc("metric"))


def eliminate_features(train: DataFrame, columns: list[str], label: str, least: int, trees: int = 5, seed: int = 7) -> DataFrame:
    """n_features, rmse, dropped: the least important feature goes, one at a time, down to `least`; judged on a held-out fifth."""
    spark, left, rows = train.sparkSession, list(columns), []
    ready = Pipeline(stages=_stages(columns)).fit(train).transform(train).select("features", label)
    fit_on, test_on = (x.cache() for x in ready.randomSplit([0.8, 0.2], seed))
    while len(left) >= least:
        slicer = VectorSlicer(inputCol="features", outputCol="chosen", indices=[columns.index(c) for c in left])
        model = GBTRegressor(featuresCol="chosen", labelCol=label, maxIter=trees, seed=seed).fit(slicer.transform(fit_on))
        rmse = RegressionEvaluator(labelCol=label, metricName="rmse").evaluate(model.transform(slicer.transform(test_on)))
        worst = min(range(len(left)), key=lambda i: (model.featureImportances[i], i))
        rows.append((len(left), float(rmse), left[worst]))
        left.pop(worst)
        if not left:
            break
    fit_on.unpersist()
    test_on.unpersist()
    return spark.createDataFrame(rows, "n_features int, rmse double, dropped string")


def mask_columns(table: DataFrame, keep: list[bool], column: str = "features", out: str = "masked") -> DataFrame:
    """The vector reduced to the positions of a support mask."""
    return VectorSlicer(inputCol=column, outputCol=out, indices=[i for i, k in enumerate(keep) if k]).transform(table)


def network(train: DataFrame, columns: list[str], label: str, hidden: tuple[int, ...] = (128, 128), rounds: int = 100, seed: int = 7) -> PipelineModel:
    """A two-class network with the given hidden layers on standardised features."""
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    ready = Pipeline(stages=[*_stages(columns), scale]).fit(train)
    model = perceptron.fit(train, columns, label, _scale(ready, columns), [len(columns), *hidden, 2], rounds, seed)
    return PipelineModel(stages=[*ready.stages, model._set(featuresCol="scaled")])


def _scale(fitted: PipelineModel, columns: list[str]) -> perceptron.Scale:
    """What the first stages of network() do to the columns."""
    fill = fitted.stages[0].surrogateDF.first()
    return perceptron.Scale([fill[c] for c in columns], list(fitted.stages[2].mean), list(fitted.stages[2].std))


def classified(network: PipelineModel, rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """label, prediction by a model of network(): as by its transform(), which multiplies row by row."""
    return perceptron.classified(rows, columns, label, _scale(network, columns), network.stages[-1])


def accuracy(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return scored.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def probabilities(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p1", vector_to_array("probability")[1])
