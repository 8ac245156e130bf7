"""Relational queries: scans, joins, aggregations, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orequarry.operators import relational as R
from orequarry.plans.base import RATINGS_SQL, Book, ratings, read

BOOK = Book()


@BOOK.add("SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def topk_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(read(spark, sf_dir, "orders"), "o_custkey", 10, "n_orders")


@BOOK.add("""SELECT l_suppkey, n FROM (SELECT l_suppkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS r
FROM lineitem GROUP BY 1) WHERE r <= 10""")
def topk_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second way to a top-k; the plan is the same bounded heap."""
    return R.top_k(read(spark, sf_dir, "lineitem"), "l_suppkey", 10)


@BOOK.add("""SELECT count(*) AS n_review, count(*) FILTER (year(l_shipdate) = 1996) AS n_review_1996,
count(DISTINCT o_custkey) AS n_user, count(DISTINCT l_suppkey) AS n_business FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts in one pass over the facts."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_review"),
        F.count_if(F.year("l_shipdate") == 1996).alias("n_review_1996"),
        F.count_distinct("o_custkey").alias("n_user"),
        F.count_distinct("l_suppkey").alias("n_business"),
    )


def _supplier_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, nations = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("key"), F.col("n_name").alias("city"))


@BOOK.add("""SELECT n_name AS city, round(avg(l_quantity), 4) AS mean, count(*) AS n FROM lineitem
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def nation_mean_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), "l_quantity")
    means = R.mean_by_group_outer(lines, _supplier_nation(spark, sf_dir), "key", "city", "l_quantity", keep_unmatched=False)
    return means.withColumn("mean", F.round("mean", 4)).orderBy(F.desc("mean"), "city")


@BOOK.add("""WITH g AS (SELECT s_suppkey AS key, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0),
f AS (SELECT l_suppkey AS key, l_quantity FROM lineitem WHERE l_suppkey % 5 <> 0)
SELECT city, round(avg(l_quantity), 4) AS mean, count(l_quantity) AS n FROM g FULL JOIN f USING (key) GROUP BY 1""")
def nation_mean_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides have keys that the other lacks; unmatched facts get a null group."""
    facts = read(spark, sf_dir, "lineitem").where("l_suppkey % 5 <> 0").select(F.col("l_suppkey").alias("key"), "l_quantity")
    groups = _supplier_nation(spark, sf_dir).where("key % 3 <> 0")
    return R.mean_by_group_outer(facts, groups, "key", "city", "l_quantity", keep_unmatched=True).withColumn("mean", F.round("mean", 4))


@BOOK.add("SELECT CAST(ascii(substr(p_name, 1, 1)) % 20 AS INTEGER) AS bucket, count(*) AS rows FROM part GROUP BY 1")
def bucket_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").withColumn("bucket", R.first_letter_bucket(F.col("p_name"), 20))
    return parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))


@BOOK.add("SELECT 16::BIGINT AS n_partitions, count(*) AS rows, 0::BIGINT AS uneven FROM part")
def partition_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin dealing: the number of partitions, all rows, and whether their sizes differ by more than a few."""
    profile = R.partition_profile(read(spark, sf_dir, "part").repartition(16))
    spread = F.max("rows") - F.min("rows")
    return profile.agg(F.count(F.lit(1)).alias("n_partitions"), F.sum("rows").alias("rows"), F.when(spread > 16, 1).otherwise(0).cast("long").alias("uneven"))


@BOOK.add("SELECT c_name, dense_rank() OVER (ORDER BY c_name) - 1 AS index FROM customer")
def dict_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dictionary(read(spark, sf_dir, "customer"), "c_name")


@BOOK.add("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def dict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names encoded by a dictionary over two tables, and decoded again."""
    customers = read(spark, sf_dir, "customer")
    index = R.dictionary(customers.select(F.col("c_name").alias("name")).union(read(spark, sf_dir, "supplier").select("s_name")), "name")
    some = customers.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.col("c_name").alias("name"))
    coded = R.encode(some, "name", index, "code").select("c_custkey", "code")
    return R.decode(coded, "code", index).select("c_custkey", F.col("name").alias("c_name"))


def _moments_sql(key: str) -> str:
    return f"""WITH {RATINGS_SQL} SELECT "{key}", count(*) AS n, round(avg(stars), 6) AS mean, round(var_pop(stars) + 1e-9, 6) AS var, round(stddev_pop(stars) + 1e-9, 6) AS std
FROM ratings GROUP BY 1"""


def _moments(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    made = R.moments(ratings(spark, sf_dir), key, "stars")
    return made.select(key, "n", F.round("mean", 6).alias("mean"), F.round(F.col("var") + 1e-9, 6).alias("var"), F.round(F.col("std") + 1e-9, 6).alias("std"))


@BOOK.add(_moments_sql("user"))
def user_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(spark, sf_dir, "user")


@BOOK.add(_moments_sql("item"))
def item_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(spark, sf_dir, "item")


@BOOK.add(f"WITH {RATINGS_SQL} SELECT round(avg(stars), 6) AS mean, count(*) AS n FROM ratings")
def global_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).agg(F.round(F.avg("stars"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@BOOK.add(f"""WITH {RATINGS_SQL} SELECT "user", item, round(stars - avg(stars) OVER (PARTITION BY item), 5) AS centred FROM ratings""")
def mean_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.centred(ratings(spark, sf_dir), "item", "stars").select("user", "item", F.round("centred", 5).alias("centred"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("user"), "c_acctbal")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("item"), "s_acctbal")


_PARTIAL_SQL = f"""WITH {RATINGS_SQL}, u AS (SELECT c_custkey AS "user", c_acctbal FROM customer WHERE c_custkey % 7 <> 0),
i AS (SELECT s_suppkey AS item, s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0)"""


@BOOK.add(f'{_PARTIAL_SQL} SELECT "user", item, c_acctbal, s_acctbal FROM ratings LEFT JOIN u USING ("user") LEFT JOIN i USING (item)')
def feature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = R.lookup(ratings(spark, sf_dir), "user", _users(spark, sf_dir))
    return R.lookup(base, "item", _items(spark, sf_dir)).select("user", "item", "c_acctbal", "s_acctbal")


@BOOK.add(f"""{_PARTIAL_SQL} SELECT "user", item, CASE WHEN s_acctbal IS NOT NULL THEN c_acctbal END AS c_acctbal,
CASE WHEN c_acctbal IS NOT NULL THEN s_acctbal END AS s_acctbal FROM ratings LEFT JOIN u USING ("user") LEFT JOIN i USING (item)""")
def feature_lookup_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = R.guarded_lookup(ratings(spark, sf_dir), ("user", _users(spark, sf_dir)), ("item", _items(spark, sf_dir)))
    return made.select("user", "item", "c_acctbal", "s_acctbal")


@BOOK.add(f'{_PARTIAL_SQL} SELECT "user", item, c_acctbal, s_acctbal FROM ratings JOIN u USING ("user") JOIN i USING (item)')
def feature_lookup_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = R.lookup(ratings(spark, sf_dir), "user", _users(spark, sf_dir), strict=True)
    return R.lookup(base, "item", _items(spark, sf_dir), strict=True).select("user", "item", "c_acctbal", "s_acctbal")


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keys of the train and test side: orders before and from 1997, of some customers."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderdate")
    return orders.where("year(o_orderdate) < 1997 AND key % 3 <> 0"), orders.where("year(o_orderdate) >= 1997 AND key % 4 <> 0")


_TWO_SQL = """train AS (SELECT o_custkey AS key, o_orderkey FROM orders WHERE year(o_orderdate) < 1997 AND o_custkey % 3 <> 0),
test AS (SELECT o_custkey AS key, o_orderkey FROM orders WHERE year(o_orderdate) >= 1997 AND o_custkey % 4 <> 0)"""


@BOOK.add(f"WITH {_TWO_SQL} SELECT c_custkey AS key, c_name FROM customer WHERE c_custkey IN (SELECT key FROM train UNION SELECT key FROM test)")
def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _two(spark, sf_dir)
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return R.in_either(customers, "key", train, test)


@BOOK.add(f"WITH {_TWO_SQL} SELECT c_custkey AS key, c_name FROM customer WHERE c_custkey IN (SELECT key FROM train INTERSECT SELECT key FROM test)")
def semi_filter_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return R.in_both(customers, "key", *_two(spark, sf_dir))


@BOOK.add(f"WITH {_TWO_SQL} SELECT DISTINCT key FROM test WHERE key NOT IN (SELECT key FROM train)")
def cold_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _two(spark, sf_dir)
    return R.cold(test, "key", train)


@BOOK.add(f"""WITH {_TWO_SQL}, a AS (SELECT DISTINCT key FROM train), b AS (SELECT DISTINCT key FROM test)
SELECT 'union' AS op, count(*) AS n FROM (SELECT key FROM a UNION SELECT key FROM b) UNION ALL
SELECT 'intersect', count(*) FROM (SELECT key FROM a INTERSECT SELECT key FROM b) UNION ALL
SELECT 'only_train', count(*) FROM (SELECT key FROM a EXCEPT SELECT key FROM b) UNION ALL
SELECT 'only_test', count(*) FROM (SELECT key FROM b EXCEPT SELECT key FROM a) UNION ALL
SELECT 'stacked', (SELECT count(*) FROM train) + (SELECT count(*) FROM test)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _two(spark, sf_dir)
    a, b = train.select("key").distinct(), test.select("key").distinct()
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "only_train": a.subtract(b), "only_test": b.subtract(a), "stacked": train.unionByName(test)}
    counts = [table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n") for op, table in made.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.union(more)
    return out


@BOOK.add("""SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT event_type) AS n_kinds,
count(*) AS n FROM events GROUP BY 1""")
def grouped_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set, a list and a map of each group."""
    events = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    grouped = events.groupBy("user_id").agg(
        F.array_sort(F.collect_set("event_type")).alias("s"), F.collect_list(F.struct("event_type", "c")).alias("l")
    ).withColumn("m", F.map_from_entries("l"))
    return grouped.select(
        "user_id", F.array_join("s", ",").alias("kinds"), F.size("m").cast("long").alias("n_kinds"),
        F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
    )


@BOOK.add("""WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part)
SELECT term, count(*) AS n, count(DISTINCT p_partkey) AS n_parts FROM t GROUP BY 1""")
def fold_union_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all rows' term sets, with frequencies."""
    terms = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_partkey").alias("n_parts"))


@BOOK.add("SELECT l_returnflag, l_linestatus, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2")
def keep_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each key, chosen by the smallest order."""
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.min("l_orderkey").alias("first_order"))


@BOOK.add("""WITH d AS (SELECT o_orderkey, lag(o_totalprice) OVER w AS before, o_totalprice FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, round(o_totalprice - before, 4) AS change FROM d WHERE before IS NOT NULL""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row i with row i-1: positions become keys."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    placed = read(spark, sf_dir, "orders").withColumn("place", F.row_number().over(order)).select("o_custkey", "place", "o_orderkey", "o_totalprice")
    before = placed.select("o_custkey", (F.col("place") + 1).alias("place"), F.col("o_totalprice").alias("before"))
    return placed.join(before, ["o_custkey", "place"]).select("o_orderkey", F.round(F.col("o_totalprice") - F.col("before"), 4).alias("change"))


@BOOK.add("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_quantity >= 45 AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag <> 'A'")
def pushed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates and columns reach the scan."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.where((F.col("l_quantity") >= 45) & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") != "A")).select("l_orderkey", "l_linenumber", "l_suppkey")


QUERIES, ORACLE_SQL = BOOK.queries, BOOK.sql
