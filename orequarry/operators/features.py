"""Feature encoders for businesses, users and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orequarry.functions.scalars import age_years, is_object, listed, repaired_literal
from orequarry.sources.schemas import USER_COUNTS


def flat_attributes(table: DataFrame, key: str, attributes: str, keep_nested_bool: bool = True) -> DataFrame:
    """key, name, value: entries of the attribute map; a value that is a dict literal gives its own entries.

    keep_nested_bool False drops nested true and false, as one old variant does.
    """
    rows = table.select(key, F.explode(attributes).alias("name", "value")).where(F.col("value").isNotNull())
    fixed = repaired_literal(F.col("value"))
    nested = rows.where(is_object(fixed)).select(key, "name", F.explode(F.from_json(fixed, "map<string,string>")).alias("inner", "value"))
    if not keep_nested_bool:
        nested = nested.where(~F.col("value").isin("true", "false"))
    plain = rows.where(~F.coalesce(is_object(fixed), F.lit(False)))
    return plain.union(nested.select(key, F.concat_ws(".", "name", "inner").alias("name"), "value"))


def ordinals(flat: DataFrame) -> DataFrame:
    """name, value, code: the place of each value among the sorted values of its attribute, from 0."""
    order = Window.partitionBy("name").orderBy("value")
    return flat.select("name", "value").distinct().withColumn("code", (F.dense_rank().over(order) - 1).cast("int"))


def encode_attributes(flat: DataFrame, key: str, codes: DataFrame, names: list[str]) -> DataFrame:
    """key and one column for each name: the value's code, -1 for a value not in codes, null where it is absent."""
    coded = flat.join(codes, ["name", "value"], "left").withColumn("code", F.coalesce("code", F.lit(-1)))
    return coded.groupBy(key).pivot("name", names).agg(F.min("code"))


def top_terms(table: DataFrame, key: str, terms: Column, n: int = 3) -> DataFrame:
    """key and term_1..n: codes of its terms of the highest frequency, ties to the larger code; code: alphabetical place."""
    exploded = table.select(key, F.explode(terms).alias("term")).distinct()
    counted = exploded.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    places = counted.select("term", "freq", (F.dense_rank().over(Window.orderBy("term")) - 1).alias("code"))  # one row a distinct term
    ranked = exploded.join(places, "term").groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("freq", "code")), asc=False), 1, n).alias("best"))
    return ranked.select(key, *[F.try_element_at("best", F.lit(i + 1))["code"].alias(f"term_{i + 1}") for i in range(n)])


def user_features(users: DataFrame, as_of: str, with_text: bool = True) -> DataFrame:
    """user_id, its numbers, and from texts: account age in years, number of friends, number of elite years."""
    numbers = [F.col(c).cast("double").alias(c) for c in (*USER_COUNTS, "average_stars")]
    texts = [age_years(F.col("yelping_since"), as_of).alias("age"), listed(F.col("friends")).alias("n_friends"), listed(F.col("elite")).alias("n_elite")]
    return users.select("user_id", *numbers, *(texts if with_text else []))


def business_features(businesses: DataFrame, codes: DataFrame, names: list[str], with_place: bool = True) -> DataFrame:
    """business_id, five numbers, attribute codes (with places: city, state and postal code too) and top categories."""
    numbers = businesses.select("business_id", *[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude", "stars", "review_count", "is_open")])
    flat = business_entries(businesses, with_place)
    out = numbers.join(encode_attributes(flat, "business_id", codes, names), "business_id", "left")
    if with_place:
        out = out.join(top_terms(businesses, "business_id", F.split("categories", ", ")), "business_id", "left")
    return out


def business_entries(businesses: DataFrame, with_place: bool = True) -> DataFrame:
    flat = flat_attributes(businesses, "business_id", "attributes")
    if with_place:
        places = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("city", "state", "postal_code")])).alias("p")
        flat = flat.union(businesses.select("business_id", places).select("business_id", "p.name", "p.value").where("value IS NOT NULL"))
    return flat


def rating_features(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """ratings with the features of both sides, nulls where a side is unknown; always of the same width."""
    return ratings.join(users, "user", "left").join(items, "item", "left")
