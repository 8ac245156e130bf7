"""Schemas of the inputs; readers never infer."""

from pyspark.sql import types as T

REVIEW = T.StructType([T.StructField(n, T.StringType()) for n in ("review_id", "user_id", "business_id")] + [T.StructField("stars", T.DoubleType()), T.StructField("date", T.StringType())])
BUSINESS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("business_id", "name", "neighborhood", "address", "city", "state", "postal_code")]
    + [T.StructField(n, T.DoubleType()) for n in ("latitude", "longitude", "stars")]
    + [T.StructField(n, T.LongType()) for n in ("review_count", "is_open")]
    + [T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("categories", T.StringType()), T.StructField("hours", T.MapType(T.StringType(), T.StringType()))]
)
#: Counts of the user record, in the order of its features.
USER_COUNTS = (
    "review_count", "useful", "funny", "cool", "fans", "compliment_hot", "compliment_more", "compliment_profile", "compliment_cute",
    "compliment_list", "compliment_note", "compliment_plain", "compliment_cool", "compliment_funny", "compliment_writer", "compliment_photos",
)
USER = T.StructType(
    [T.StructField("user_id", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in USER_COUNTS]
    + [T.StructField("average_stars", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("yelping_since", "friends", "elite")]
)
RATING = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("business_id", T.StringType()), T.StructField("stars", T.DoubleType())])
BASKET = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("business_id", T.StringType())])
