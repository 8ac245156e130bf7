"""Stream sketches in batch form: membership filter, distinct estimate and reservoir sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orequarry.functions.scalars import linear_hash, md5_number, trailing_zeros
from orequarry.operators.similarity import PRIME, hash_parameters

#: Bits of the membership filter.
BITS = 69_997


def numbered(events: DataFrame, key: str, order: list[str], batch: int) -> DataFrame:
    """seq (from 0), batch_id, x: the stream in order, cut into batches; x is the key's number.

    The order is dense over all events, so places are counted in two steps: inside days, then over days.
    """
    day = F.to_date(order[0])
    rows = events.select(*order, F.col(key).cast("string").alias("key"), day.alias("__day"))
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__day").count().select("__day", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("__day").orderBy(*order)) - 1
    seq = F.col("__place") + F.col("__offset")
    made = rows.withColumn("__place", place).join(offsets, "__day")
    return made.select(seq.alias("seq"), F.floor(seq / batch).alias("batch_id"), "key", F.pmod(md5_number(F.col("key")), F.lit(PRIME)).alias("x"))


def bits(stream: DataFrame, n_hashes: int, size: int = BITS) -> DataFrame:
    """One row for each element and hash: the bit it sets."""
    each = [linear_hash(F.col("x"), a, b, PRIME, size) for a, b in hash_parameters(n_hashes)]
    return stream.select("*", F.explode(F.array(*each)).alias("bit"))


def bloom_rates(stream: DataFrame, n_hashes: int = 16, size: int = BITS, whole_batch: bool = False) -> DataFrame:
    """batch_id, fp, unseen, rate, strict_rate of testing each element before inserting it.

    An element looks known when each of its bits was set by an earlier element (whole_batch: an earlier batch).
    fp: unseen elements that look known. rate = fp / (fp + unseen) as in the usual report, strict_rate = fp / unseen.
    """
    time = F.col("batch_id") if whole_batch else F.col("seq")
    spread = bits(stream.withColumn("t", time), n_hashes, size)
    first = spread.groupBy("bit").agg(F.min("t").alias("first"))
    looks = spread.join(first, "bit").groupBy("seq", "batch_id", "x", "t").agg(F.min((F.col("first") < F.col("t")).cast("int")).alias("known"))
    born = stream.withColumn("t", time).groupBy("x").agg(F.min("t").alias("born"))
    judged = looks.join(born, "x").withColumn("unseen", F.col("born") >= F.col("t"))
    counts = judged.groupBy("batch_id").agg(F.count_if(F.col("unseen") & (F.col("known") == 1)).alias("fp"), F.count_if("unseen").alias("unseen"))
    rate = lambda down: F.when(down > 0, F.col("fp") / down).otherwise(0.0)
    return counts.withColumn("rate", rate(F.col("fp") + F.col("unseen"))).withColumn("strict_rate", rate(F.col("unseen")))


def distinct_estimates(stream: DataFrame, n_hashes: int = 10, group: int = 1, how: str = "median") -> DataFrame:
    """batch_id, truth, estimate: 2 to the most trailing zeros for each hash; means of groups, then their upper median (or one mean)."""
    params = hash_parameters(n_hashes)
    tails = [F.max(trailing_zeros(linear_hash(F.col("x"), a, b, PRIME, 1 << 20))).alias(f"z{i}") for i, (a, b) in enumerate(params)]
    per = stream.groupBy("batch_id").agg(F.count_distinct("x").alias("truth"), *tails)
    powers = [F.pow(F.lit(2.0), F.col(f"z{i}")) for i in range(n_hashes)]
    mean = lambda xs: sum(xs[1:], xs[0]) / len(xs)
    groups = [mean(powers[i : i + group]) for i in range(0, n_hashes, group)]
    made = F.element_at(F.array_sort(F.array(*groups)), len(groups) // 2 + 1) if how == "median" else mean(groups)
    return per.select("batch_id", "truth", made.alias("estimate"))


def reservoir(stream: DataFrame, k: int = 100, seed: int = 553) -> DataFrame:
    """place, seq, key: a uniform sample of k, the smallest keyed hashes; samples of parts merge into that of the whole."""
    draw = md5_number(F.concat_ws(":", F.lit(str(seed)), F.col("seq").cast("string")))
    kept = stream.withColumn("draw", draw).orderBy("draw", "seq").limit(k)
    return kept.select((F.row_number().over(Window.orderBy("draw", "seq")) - 1).alias("place"), "seq", "key")
