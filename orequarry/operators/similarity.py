"""Set similarity: MinHash, banding, exact Jaccard; and Pearson similarity of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orequarry.operators import copairs, setpairs

#: Modulus of the MinHash functions; with a, b and x below it the arithmetic stays in 64 bits.
PRIME = 2147483647


def hash_parameters(n: int, seed: int = 48271) -> list[tuple[int, int]]:
    """(a, b) of n functions from one multiplicative sequence, the same at every run."""
    x, out = 12345, []
    for _ in range(n):
        a = x = x * seed % PRIME
        b = x = x * seed % PRIME
        out.append((a, b))
    return out


def minhash_signatures(sets: DataFrame, n: int, universe: int) -> DataFrame:
    """id, signature: n minima of ((a x + b) mod p) mod universe over the set's numbers. sets: id, member (long)."""
    x = F.pmod(F.col("member"), F.lit(PRIME))
    minima = [F.min(F.pmod(F.pmod(F.lit(a) * x + F.lit(b), F.lit(PRIME)), F.lit(universe))) for a, b in hash_parameters(n)]
    return sets.groupBy("id").agg(F.array(*minima).alias("signature"))


def bands(signatures: DataFrame, rows: int, with_number: bool = True) -> DataFrame:
    """id, band, key: runs of `rows` signature values; without numbers, equal runs of different bands meet too."""
    n = F.size("signature") / rows
    keys = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.slice("signature", i * rows + 1, rows))
    made = signatures.select("id", F.posexplode(keys).alias("band", "key"))
    return made if with_number else made.withColumn("key", F.array_sort("key")).withColumn("band", F.lit(0))


def candidate_pairs(banded: DataFrame) -> DataFrame:
    """a < b that share a band key."""
    other = banded.select(F.col("id").alias("b"), "band", "key")
    return banded.withColumnRenamed("id", "a").join(other, ["band", "key"]).where("a < b").select("a", "b").distinct()


def overlap(sets: DataFrame) -> DataFrame:
    """a < b, shared: members in common of all pairs that have any."""
    other = sets.select(F.col("id").alias("b"), "member")
    pairs = sets.withColumnRenamed("id", "a").join(other, "member").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def overlap_at_least(sets: DataFrame, least: int) -> DataFrame:
    """a < b, shared: pairs with at least `least` members in common.

    Members are ordered by how many sets hold them, rarest first. Two such sets share a member among the first
    size - least + 1 of either, so only those are join keys; common members bring no pairs together.
    """
    held = sets.groupBy("member").agg(F.count(F.lit(1)).alias("held"))
    ordered = F.array_sort(F.collect_list(F.struct("held", "member")))
    rows = sets.join(held, "member").groupBy("id").agg(ordered.alias("m")).where(F.size("m") >= least)
    rows = rows.select("id", F.transform("m", lambda x: x["member"]).alias("m"))
    keyed = rows.select("id", "m", F.explode(F.slice("m", F.lit(1), F.size("m") - (least - 1))).alias("key"))
    other = keyed.select(F.col("id").alias("b"), F.col("m").alias("mb"), "key")
    met = keyed.select(F.col("id").alias("a"), F.col("m").alias("ma"), "key").join(other, "key").where("a < b")
    shared = F.size(F.array_intersect("ma", "mb"))
    return met.select("a", "b", shared.cast("long").alias("shared")).where(F.col("shared") >= least).distinct()


def jaccard(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, similarity from shared counts and set sizes."""
    sizes = sets.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = shared.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("similarity"))


def exact_pairs(sets: DataFrame, least: float) -> DataFrame:
    """All pairs with Jaccard of at least `least` that share a member, counted by blocks of sets."""
    return setpairs.similar(sets, least)


def lsh_pairs(sets: DataFrame, least: float, n: int, rows: int, universe: int) -> DataFrame:
    """Pairs that collide in a band and pass the exact test; a candidate brings its two sets as arrays."""
    found = candidate_pairs(bands(minhash_signatures(sets, n, universe), rows))
    whole = sets.groupBy("id").agg(F.collect_set("member").alias("m"))
    left, right = (whole.select(F.col("id").alias(x), F.col("m").alias(f"m{x}")) for x in "ab")
    shared = F.size(F.array_intersect("ma", "mb"))
    similarity = shared / (F.size("ma") + F.size("mb") - shared)
    return found.join(left, "a").join(right, "b").select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)


def precision_recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """n_found, n_true, n_hit, precision (1 if nothing is found, as then nothing is false), recall (NaN if nothing is true) of a pair set."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    share = lambda of, none: F.when(F.col(of) > 0, F.try_divide(F.col("n_hit"), F.col(of))).otherwise(F.lit(none))
    hit = found.select(*keys).join(truth.select(*keys), keys, "left_semi")
    row = count(found, "n_found").join(count(truth, "n_true")).join(count(hit, "n_hit"))  # three single rows
    return row.select("*", share("n_found", 1.0).alias("precision"), share("n_true", float("nan")).alias("recall"))


# --- Pearson similarity of items


def pearson(ratings: DataFrame, least_common: int = 3, rule: str = "plain", without_user: bool = False) -> DataFrame:
    """a < b, n, sim with the means of all ratings; of those without a user too, if without_user.

    Rules: `plain`; `amplified` (negative x 0.1, positive x 1.1); `floor` (no overlap beyond one user: 0, under ten
    users: 0.05, else amplified); `strict` (at most twenty users or negative: 0, else x 1.1).
    """
    return copairs.similarities(ratings, least_common, rule, without_user)


def co_rated_correlation(ratings: DataFrame, least_common: int = 3) -> DataFrame:
    """a < b, n, sim centred by the means over common users: the usual correlation, NaN where one side is constant."""
    return copairs.similarities(ratings, least_common, None).where(F.col("n") >= least_common)


def both_ways(sims: DataFrame) -> DataFrame:
    """item, other, sim for both directions of each pair."""
    return sims.select(F.col("a").alias("item"), F.col("b").alias("other"), "sim").union(sims.select("b", "a", "sim"))
