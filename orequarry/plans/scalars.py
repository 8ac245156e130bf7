"""Scalar function families on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orequarry.functions import scalars as S
from orequarry.plans.base import Book, hashed, hashed_sql, read
from orequarry.sources.readers import short_year

BOOK = Book()


@BOOK.add("""SELECT c_custkey, string_split(c_name, '#')[1] AS head, split_part(c_name, '#', -1) AS tail,
CAST(CAST(string_split(c_name, '#')[2] AS BIGINT) AS VARCHAR) AS plain_number, trim('"' || c_name || '"', '"') AS unquoted,
replace(replace(c_name, 'C', 'K'), '#', '_') AS replaced, starts_with(c_name, 'Cust') AS prefixed, regexp_matches(c_mktsegment, '^[A-Za-z]+$') AS alphabetic,
regexp_matches(string_split(c_name, '#')[2], '^[0-9]+$') AS digits, CAST(ascii(substr(c_mktsegment, 1, 1)) AS INTEGER) AS code, reverse(c_mktsegment) AS backwards,
concat_ws('_', c_mktsegment, c_nationkey) AS composite FROM customer""")
def scalar_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, name = read(spark, sf_dir, "customer"), F.col("c_name")
    number = F.split(name, "#")[1]
    return t.select(
        "c_custkey", F.split(name, "#")[0].alias("head"), F.substring_index(name, "#", -1).alias("tail"), S.without_zeros(number).alias("plain_number"),
        F.btrim(F.concat(F.lit('"'), name, F.lit('"')), F.lit('"')).alias("unquoted"),
        F.replace(F.replace(name, F.lit("C"), F.lit("K")), F.lit("#"), F.lit("_")).alias("replaced"), F.startswith(name, F.lit("Cust")).alias("prefixed"),
        F.col("c_mktsegment").rlike("^[A-Za-z]+$").alias("alphabetic"), number.rlike("^[0-9]+$").alias("digits"), F.ascii(F.substring("c_mktsegment", 1, 1)).alias("code"),
        F.reverse("c_mktsegment").alias("backwards"), F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("composite"),
    )


@BOOK.add("""WITH c AS (SELECT c_custkey, c_mktsegment AS m, c_name AS n FROM customer)
SELECT c_custkey, CAST(regexp_replace(n || c_custkey, '[^0-9]', '', 'g') AS BIGINT) AS digits,
CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(m) + 1), lambda i: CAST(ascii(substr(m, i, 1)) AS BIGINT))), lambda h, b: (h * 256 + b) % 69997) AS BIGINT) AS big,
abs(CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(m) + 1), lambda i: CAST(ascii(substr(m, i, 1)) AS BIGINT))),
  lambda h, b: (h * 31 + b + 2147483648 + 4294967296 * 64) % 4294967296 - 2147483648) AS BIGINT)) % 119267 AS jvm,
'''' || c_custkey || ''', ''' || m || '''' AS listed, 'b' AS right_wins, c_custkey AS inverted FROM c""")
def scalar_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    return read(spark, sf_dir, "customer").select(
        "c_custkey", S.digits_key(F.concat("c_name", key)).cast("long").alias("digits"), S.bytes_modulo(m, 69997).alias("big"), F.pmod(F.abs(S.java_hash(m)), F.lit(119267)).alias("jvm"),
        S.list_text(F.array(key, m)).alias("listed"), S.right_wins(F.create_map(m, F.lit("a")), F.create_map(m, F.lit("b")))[m].alias("right_wins"),
        S.inverted(F.create_map(m, F.col("c_custkey")))[F.col("c_custkey")].eqNullSafe(m).cast("long").__mul__(F.col("c_custkey")).alias("inverted"),
    )


@BOOK.add("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, strftime(o_orderdate, '%-m/%-d/') || right(CAST(year(o_orderdate) AS VARCHAR), 2) AS short_day,
round(date_diff('day', CAST(o_orderdate AS DATE), DATE '2018-01-01') / 365.0, 6) AS age, year(o_orderdate) = 1997 AS in_1997 FROM orders""")
def scalar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(day).alias("y"), short_year(F.date_format(day, "M/d/yyyy")).alias("short_day"),
        F.round(S.age_years(day, "2018-01-01"), 6).alias("age"), (F.year(F.to_date(F.date_format(day, "yyyy-MM-dd"), "yyyy-MM-dd")) == 1997).alias("in_1997"),
    )


@BOOK.add("""SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS square, round(sqrt(l_quantity), 6) AS root, abs(l_discount - 0.05) < 0.021 AS near,
round(tanh(l_quantity / 25.0), 6) AS blend, (48271 * l_partkey + 11) % 2147483647 % 1000 AS hashed, round(l_extendedprice / 1000, 1) AS rounded,
CAST(least(l_quantity, 30) AS DOUBLE) AS low, CAST(greatest(l_quantity, 30) AS DOUBLE) AS high, CAST(pow(2, l_linenumber) AS BIGINT) AS power, l_partkey // 7 AS whole FROM lineitem""")
def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (q * q).alias("square"), F.round(F.sqrt(q), 6).alias("root"), (F.abs(F.col("l_discount") - 0.05) < 0.021).alias("near"),
        F.round(F.tanh(q / 25.0), 6).alias("blend"), S.linear_hash(F.col("l_partkey"), 48271, 11, 2147483647, 1000).alias("hashed"), F.round(F.col("l_extendedprice") / 1000, 1).alias("rounded"),
        F.least(q, F.lit(30.0)).alias("low"), F.greatest(q, F.lit(30.0)).alias("high"), F.pow(F.lit(2), F.col("l_linenumber")).cast("long").alias("power"), F.expr("l_partkey div 7").alias("whole"),
    )


@BOOK.add("""SELECT p_partkey, CASE WHEN p_partkey = 0 THEN 0 ELSE length(bin(p_partkey)) - length(rtrim(bin(p_partkey), '0')) END AS zeros,
('0x' || substr(md5(p_name), 1, 8))::BIGINT AS hashed, (('0x' || substr(md5(p_name), 1, 8))::BIGINT) % 119267 AS slot FROM part""")
def scalar_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = S.md5_number(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", S.trailing_zeros(F.col("p_partkey")).cast("long").alias("zeros"), h.alias("hashed"), F.pmod(h, F.lit(119267)).alias("slot"))


@BOOK.add("""WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), u AS (SELECT p_partkey, w, list_sort(list_distinct(w)) AS s FROM t)
SELECT p_partkey, array_to_string(s, ' ') AS sorted_words, len(s) * (len(s) - 1) // 2 AS n_pairs, array_to_string(w[1:2], ' ') AS head,
coalesce(list_position(w, 'red'), 0) - 1 AS red_at, list_has_all(s, ['red']) AS has_red, CAST(len(list_intersect(s, ['red', 'blue', 'green'])) AS INTEGER) AS n_basic,
CAST(len(list_distinct(list_concat(s, ['red', 'blue']))) AS INTEGER) AS n_union, s[len(s) // 2 + 1] AS middle, CAST(len(list_concat(w, s)) AS INTEGER) AS n_both FROM u""")
def scalar_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w")).withColumn("s", F.array_sort(F.array_distinct("w")))
    words = lambda *x: F.array(*[F.lit(v) for v in x])
    return t.select(
        "p_partkey", F.array_join("s", " ").alias("sorted_words"), F.size(S.pairs(F.col("s"))).cast("long").alias("n_pairs"), F.array_join(F.slice("w", 1, 2), " ").alias("head"),
        S.position(F.col("w"), F.lit("red")).cast("int").alias("red_at"), S.is_subset(words("red"), F.col("s")).alias("has_red"), F.size(F.array_intersect("s", words("red", "blue", "green"))).alias("n_basic"),
        F.size(F.array_union("s", words("red", "blue"))).alias("n_union"), S.upper_median(F.col("s")).alias("middle"), F.size(F.concat("w", "s")).alias("n_both"),
    )


@BOOK.add("""WITH e AS (SELECT vec_id, embedding AS x FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda v: CAST(v AS DOUBLE) * v))), 5) AS norm, round(list_sum(list_transform(x[1:8], lambda v: CAST(v AS DOUBLE) * 2)), 5) AS doubled_head,
round(sqrt(list_sum(list_transform(x, lambda v: ((CAST(v AS DOUBLE) - 0.5) / 2.0) * ((CAST(v AS DOUBLE) - 0.5) / 2.0)))), 5) AS distance FROM e""")
def scalar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(F.sqrt(total(F.transform(x, lambda v: v * v))), 5).alias("norm"), F.round(total(F.transform(F.slice(x, 1, 8), lambda v: v * 2)), 5).alias("doubled_head"),
        F.round(S.scaled_distance(x, F.transform(x, lambda v: F.lit(0.5)), F.transform(x, lambda v: F.lit(2.0))), 5).alias("distance"),
    )


@BOOK.add("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, ',' ORDER BY n DESC, event_type) AS ordered, coalesce(max(n) FILTER (event_type = 'click'), 0) AS clicks,
CAST(sum(n) * 2 AS BIGINT) AS twice FROM c GROUP BY 1""")
def scalar_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select(
        "user_id", F.array_join(S.by_value(F.col("m")), ",").alias("ordered"), F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).cast("long").alias("clicks"),
        F.aggregate(F.map_values(S.add_maps(F.col("m"), S.right_wins(F.col("m"), F.col("m")))), F.lit(0).cast("long"), lambda a, v: a + v).alias("twice"),
    )


@BOOK.add("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRUE AS valid, TRUE AS object, event_id % 2 = 0 AS flag FROM events""")
def scalar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON and a dict literal that needs repair first."""
    literal = F.concat(F.lit("{'flag': "), F.when(F.col("event_id") % 2 == 0, "True").otherwise("False"), F.lit("}"))
    fixed = F.from_json(S.repaired_literal(literal), "map<string,string>")
    props = F.from_json("props", "map<string,string>")
    return read(spark, sf_dir, "events").select(
        "event_id", F.try_element_at(props, F.lit("k")).cast("long").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"),
        S.is_object(F.col("props")).alias("object"), (F.element_at(fixed, "flag") == "true").alias("flag"),
    )


@BOOK.add("""SELECT s_suppkey, s_acctbal IS NOT NULL AS present, CASE WHEN s_acctbal < 0 THEN s_acctbal * 0.1 ELSE s_acctbal * 1.1 END AS amplified,
CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 3 = 1 THEN 0 ELSE 2 END AS n_listed, least(s_suppkey, s_nationkey) AS a, greatest(s_suppkey, s_nationkey) AS b,
CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE s_acctbal END AS no_nan FROM supplier""")
def scalar_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bal, key = F.col("s_acctbal"), F.col("s_suppkey")
    text = F.when(key % 3 == 0, F.lit("")).when(key % 3 == 1, F.lit("None")).otherwise(F.lit("2015,2016"))
    pair = S.canonical(key, F.col("s_nationkey").cast("long"))
    with_nan = F.when(key % 4 == 0, F.lit(float("nan"))).otherwise(bal)
    return read(spark, sf_dir, "supplier").select(
        "s_suppkey", bal.isNotNull().alias("present"), S.amplified(bal).alias("amplified"), S.listed(text).alias("n_listed"),
        pair["a"].alias("a"), pair["b"].alias("b"), F.nanvl(with_nan, F.lit(0.0)).alias("no_nan"),
    )


@BOOK.add(f"""SELECT event_id, {hashed_sql('event_id', 553)} % 10 AS draw, {hashed_sql('event_id', 553)} < 429496729 AS tenth FROM events""")
def scalar_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded draws by key, the same at every run and in every engine."""
    h = hashed("event_id", 553)
    return read(spark, sf_dir, "events").select("event_id", F.pmod(h, F.lit(10)).alias("draw"), (h < 429496729).alias("tenth"))


@BOOK.add("""SELECT n_nationkey, substr(n_name, 1, 3) || n_name || substr(n_name, 4) AS once,
length(n_name) * 4 AS twice_length FROM nation""")
def string_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda n: S.doubled(F.col("n_name"), F.array(*[F.lit(2)] * n))
    return read(spark, sf_dir, "nation").select("n_nationkey", made(1).alias("once"), F.length(made(2)).cast("long").alias("twice_length"))


QUERIES, ORACLE_SQL = BOOK.queries, BOOK.sql
