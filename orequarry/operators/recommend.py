"""Item-based collaborative filtering, blends with a model, and error reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orequarry.operators import copairs
from orequarry.operators.similarity import both_ways


@dataclass(frozen=True)
class Ladder:
    """Parameters of a prediction: which neighbours count, how many, and what stands in for them."""

    above: float = 0.0  # similarities above this (with nonzero_only: those that are not 0)
    nonzero_only: bool = True
    top: int = 5
    most_similar: bool = True  # False takes the least similar, as one old variant does
    least_neighbours: int = 5
    min_numerator: float | None = None  # the weighted sum must exceed this
    fallback: str = "user"  # or "item"
    default: float = 3.75
    exclude_self: bool = True


def neighbours(asked: DataFrame, ratings: DataFrame, sims: DataFrame, ladder: Ladder) -> DataFrame:
    """user, item, other, sim, stars, place, n: the user's rated items that are similar to the asked one."""
    history = asked.join(ratings.select("user", F.col("item").alias("other"), "stars"), "user")
    found = history.join(both_ways(sims), ["item", "other"])
    found = found.where(F.col("sim") != 0) if ladder.nonzero_only and ladder.above == 0 else found.where(F.col("sim") > ladder.above)
    if ladder.exclude_self:
        found = found.where("item <> other")
    pair = Window.partitionBy("user", "item")
    order = F.desc("sim") if ladder.most_similar else F.asc("sim")
    return found.withColumn("place", F.row_number().over(pair.orderBy(order, "other"))).withColumn("n", F.count(F.lit(1)).over(pair))


def predict(asked: DataFrame, ratings: DataFrame, sims: DataFrame, ladder: Ladder) -> DataFrame:
    """user, item, prediction, n (neighbours), top (their similarities, padded with -1).

    A user without ratings gets the default; an item without ratings the user's mean; too few neighbours or a
    weighted sum that is not large enough the fallback mean; else the weighted mean of the best.
    """
    user_mean = ratings.groupBy("user").agg(F.avg("stars").alias("user_mean"))
    item_mean = ratings.groupBy("item").agg(F.avg("stars").alias("item_mean"))
    near = neighbours(asked, ratings, sims, ladder).where(F.col("place") <= ladder.top)
    sums = near.groupBy("user", "item").agg(
        F.max("n").alias("n"), F.sum(F.col("sim") * F.col("stars")).alias("up"), F.sum(F.abs("sim")).alias("down"), F.sort_array(F.collect_list("sim"), asc=False).alias("sims")
    )
    joined = asked.join(sums, ["user", "item"], "left").join(user_mean, "user", "left").join(item_mean, "item", "left")
    return joined.select("user", "item", *_outcome(ladder))


def predict_rated(rated: DataFrame, ladder: Ladder, rule: str = "plain", least_common: int = 3) -> DataFrame:
    """user, item, stars, user_mean, prediction, n, top, strong for the asked rows of rated(user, item, stars, asked), learned from the others.

    The same predictions as `predict` by similarities of `similarity.pearson`, but neither these nor the rows of neighbours
    are written or shuffled. strong: rated items more similar than 0.9, as `strong_neighbours` counts them.
    """
    made = copairs.answers(rated, least_common, rule, ladder)
    return made.select("user", "item", "stars", "user_mean", *_outcome(ladder), "strong")


def _outcome(ladder: Ladder) -> list[Column]:
    """prediction, n, top of rows with n, up, down, sims, user_mean and item_mean."""
    usable = (F.coalesce("n", F.lit(0)) >= ladder.least_neighbours) & (F.col("down") > 0)
    if ladder.min_numerator is not None:
        usable = usable & (F.col("up") > ladder.min_numerator)
    stand_in = F.col("user_mean") if ladder.fallback == "user" else F.coalesce("item_mean", "user_mean")
    value = (
        F.when(F.col("user_mean").isNull(), F.lit(ladder.default))
        .when(F.col("item_mean").isNull(), F.col("user_mean"))
        .when(usable, F.col("up") / F.col("down"))
        .otherwise(stand_in)
    )
    filled = F.concat(F.coalesce("sims", F.array().cast("array<double>")), F.array_repeat(F.lit(-1.0), ladder.top - F.coalesce(F.size("sims"), F.lit(0))))
    return [value.alias("prediction"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), filled.alias("top")]


def blend(item: Column, model: Column, n: Column, k: Column) -> Column:
    """tanh(n / k) of the item prediction, the rest of the model's."""
    w = F.tanh(n / k)
    return w * item + (1 - w) * model


def blend_sweep(scored: DataFrame, ks: list[int]) -> DataFrame:
    """k, rmse for each k over scored(item_prediction, model_prediction, n, stars): one pass, one column per k."""
    d = lambda k: F.col("stars") - blend(F.col("item_prediction"), F.col("model_prediction"), F.col("n"), F.lit(float(k)))
    wide = scored.agg(*[F.sqrt(F.avg(d(k) * d(k))).alias(str(k)) for k in ks])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("rmse")) for k in ks])).alias("x")).select("x.k", "x.rmse")


def strong_neighbours(asked: DataFrame, ratings: DataFrame, sims: DataFrame, above: float = 0.9) -> DataFrame:
    """user, item, strong: how long the head of the neighbours, most similar first, stays above `above`; pairs without any are left out."""
    near = neighbours(asked, ratings, sims, Ladder(above=above, nonzero_only=False))
    return near.groupBy("user", "item").agg(F.max("place").cast("long").alias("strong"))


def alpha_hybrid(scored: DataFrame, least: int = 5) -> DataFrame:
    """alpha = (strong - least) / (10 + strong - least) of the item prediction where more than `least` neighbours are strong; else the model's."""
    extra = F.coalesce(F.col("strong"), F.lit(0)) - least
    alpha = F.when(extra > 0, extra / (extra + 10)).otherwise(0.0)
    return scored.withColumn("prediction", alpha * F.col("item_prediction") + (1 - alpha) * F.col("model_prediction"))


def switching(scored: DataFrame, use_model: Column) -> DataFrame:
    return scored.withColumn("prediction", F.when(use_model == 1, F.col("model_prediction")).otherwise(F.col("item_prediction")))


def error_report(scored: DataFrame) -> DataFrame:
    """Absolute errors in five buckets, RMSE, and moments of predictions and answers; scored: prediction, stars."""
    e = F.round(F.abs(F.col("prediction") - F.col("stars")), 9)  # an error of 1 is in the second bucket whatever its last bit
    bucket = [F.count_if((e >= low) & (e < low + 1)).alias(f"from_{low}") for low in range(4)]
    return scored.agg(
        *bucket, F.count_if(e >= 4).alias("from_4"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("prediction").alias("mean_prediction"),
        F.stddev_pop("prediction").alias("std_prediction"), F.avg("stars").alias("mean_stars"), F.stddev_pop("stars").alias("std_stars"),
    )


def closer_model(scored: DataFrame) -> DataFrame:
    """Adds `model_wins`: 1 where the model's error is smaller than the item-based one's."""
    error = lambda c: F.abs(F.col(c) - F.col("stars"))
    return scored.withColumn("model_wins", (error("model_prediction") < error("item_prediction")).cast("int"))
