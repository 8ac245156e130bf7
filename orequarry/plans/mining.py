"""Itemset, similarity and recommendation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orequarry.functions import scalars as S
from orequarry.operators import itemsets as I
from orequarry.operators import recommend as C
from orequarry.operators import similarity as M
from orequarry.operators.scratch import cut_lineage, written
from orequarry.plans.base import BASKET_ROWS_SQL, SETS_SQL, SMALL_RATINGS_SQL, Book, baskets, hashed, hashed_sql, read, small_ratings, supplier_sets

BOOK = Book()


def _support(n_baskets: int) -> int:
    return max(2, n_baskets // 50)


_SUPPORT_SQL = "(SELECT greatest(2, count(*) // 50) FROM (SELECT DISTINCT l_orderkey FROM lineitem))"


@BOOK.add(f"WITH {BASKET_ROWS_SQL} SELECT basket, string_agg(item, ',' ORDER BY item) AS items FROM basket_rows GROUP BY 1")
def baskets_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets(spark, sf_dir).select("basket", F.array_join("items", ",").alias("items"))


@BOOK.add(f"WITH {BASKET_ROWS_SQL} SELECT item, string_agg(CAST(basket AS VARCHAR), ',' ORDER BY CAST(basket AS VARCHAR)) AS baskets FROM basket_rows GROUP BY 1")
def baskets_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second case: the other column is the basket."""
    rows = baskets(spark, sf_dir).select(F.explode("items").alias("item"), F.col("basket").cast("string").alias("b"))
    return I.baskets(rows, "item", "b").select(F.col("basket").alias("item"), F.array_join("items", ",").alias("baskets"))


@BOOK.add("""WITH r AS (SELECT DISTINCT strftime(o_orderdate, '%-m/%-d/') || right(CAST(year(o_orderdate) AS VARCHAR), 2) || '-' || o_custkey AS basket, l_suppkey AS item
FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT basket, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items FROM r GROUP BY 1 HAVING count(*) > 5""")
def baskets_day_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.concat_ws("-", F.date_format("o_orderdate", "M/d/yy"), F.col("o_custkey").cast("string"))
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(day.alias("day"), "l_suppkey")
    return I.baskets(rows, "day", "l_suppkey", larger_than=5).select("basket", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@BOOK.add(f"""WITH {BASKET_ROWS_SQL} SELECT (length(a.item) * 31 + {hashed_sql('a.item')} % 1000 + {hashed_sql('b.item')} % 1000) % 100 AS bucket, count(*) AS pairs
FROM basket_rows a JOIN basket_rows b ON a.basket = b.basket AND a.item < b.item GROUP BY 1""")
def pcy_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("pair")[0], F.col("pair")[1]
    bucket = F.length(a) * 31 + hashed(a) % 1000 + hashed(b) % 1000
    return I.pair_buckets(baskets(spark, sf_dir), 100, bucket)


_KEYED_PAIRS_SQL = "SELECT a.item AS one, b.item AS two, CAST(regexp_replace(a.item || b.item, '[^0-9]', '', 'g') AS HUGEINT) % 100 AS bucket FROM basket_rows a JOIN basket_rows b ON a.basket = b.basket AND a.item < b.item"


@BOOK.add(f"""WITH {BASKET_ROWS_SQL}, p AS ({_KEYED_PAIRS_SQL}), full_buckets AS (SELECT bucket FROM p GROUP BY 1 HAVING count(*) >= {_SUPPORT_SQL}),
often AS (SELECT item FROM basket_rows GROUP BY 1 HAVING count(*) >= {_SUPPORT_SQL})
SELECT DISTINCT one || ',' || two AS items FROM p WHERE bucket IN (SELECT bucket FROM full_buckets) AND one IN (SELECT item FROM often) AND two IN (SELECT item FROM often)""")
def pcy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cut_lineage(baskets(spark, sf_dir))
    made = I.bucket_candidates(table, _support(table.count()), 100, S.digits_key(F.concat(F.col("pair")[0], F.col("pair")[1])))
    return made.select(F.array_join("items", ",").alias("items"))


def _level_sql(k: int) -> str:
    joins = "".join(f" JOIN basket_rows t{i} ON t{i}.basket = t1.basket AND t{i - 1}.item < t{i}.item" for i in range(2, k + 1))
    items = " || ',' || ".join(f"t{i}.item" for i in range(1, k + 1))
    return f"SELECT {items} AS items, count(*) AS freq FROM basket_rows t1{joins} GROUP BY 1 HAVING count(*) >= {_SUPPORT_SQL}"


def _levels(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    table = cut_lineage(baskets(spark, sf_dir))
    made = I.level_wise(table, _support(table.count()), k).where(F.size("items") == k)
    return made.select(F.array_join("items", ",").alias("items"), "freq")


@BOOK.add(f"WITH {BASKET_ROWS_SQL} {_level_sql(1)}")
def freq_items_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, 1)


@BOOK.add(f"WITH {BASKET_ROWS_SQL} {_level_sql(2)}")
def freq_items_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, 2)


@BOOK.add(f"WITH {BASKET_ROWS_SQL} {_level_sql(3)}")
def freq_items_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, 3)


_UP_TO_3 = f"WITH {BASKET_ROWS_SQL} {_level_sql(1)} UNION ALL {_level_sql(2)} UNION ALL {_level_sql(3)}"


@BOOK.add(_UP_TO_3)
def fpgrowth_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cut_lineage(baskets(spark, sf_dir))
    n = table.count()
    return I.fp_growth(table, _support(n), n).where(F.size("items") <= 3).select(F.array_join("items", ",").alias("items"), "freq")


@BOOK.add(_UP_TO_3)
def two_pass_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cut_lineage(baskets(spark, sf_dir).repartition(4))
    return I.two_pass(table, _support(table.count())).select(F.array_join("items", ",").alias("items"), "freq")


@BOOK.add(f"""WITH {BASKET_ROWS_SQL}, f AS (SELECT item FROM basket_rows GROUP BY 1 HAVING count(*) >= {_SUPPORT_SQL})
SELECT a.item || ',' || b.item AS items FROM f a JOIN f b ON a.item < b.item""")
def apriori_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cut_lineage(baskets(spark, sf_dir))
    return I.candidates(I.frequent_singles(table, _support(table.count()))).select(F.array_join("items", ",").alias("items"))


# --- similarity

_N, _ROWS, _UNIVERSE = 50, 2, 100_003


def _signature_sql() -> str:
    params = M.hash_parameters(_N)
    mins = ", ".join(f"min((({a} * (member % {M.PRIME}) + {b}) % {M.PRIME}) % {_UNIVERSE})" for a, b in params)
    return f"sigs AS (SELECT id, [{mins}] AS signature FROM sets GROUP BY 1)"


@BOOK.add(f"WITH {SETS_SQL}, {_signature_sql()} SELECT id, array_to_string(signature, ',') AS signature FROM sigs")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = M.minhash_signatures(supplier_sets(spark, sf_dir), _N, _UNIVERSE)
    return made.select("id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


_BANDS_SQL = f"""bands AS (SELECT id, i AS band, signature[i * {_ROWS} + 1] AS k1, signature[i * {_ROWS} + 2] AS k2
FROM sigs, (SELECT unnest(range({_N // _ROWS})) AS i))"""
_CANDIDATES_SQL = "SELECT DISTINCT x.id AS a, y.id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.k1 = y.k1 AND x.k2 = y.k2 AND x.id < y.id"


@BOOK.add(f"WITH {SETS_SQL}, {_signature_sql()}, {_BANDS_SQL} {_CANDIDATES_SQL}")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.candidate_pairs(M.bands(M.minhash_signatures(supplier_sets(spark, sf_dir), _N, _UNIVERSE), _ROWS))


@BOOK.add(f"""WITH {SETS_SQL}, {_signature_sql()}, {_BANDS_SQL}, sorted AS (SELECT id, least(k1, k2) AS k1, greatest(k1, k2) AS k2 FROM bands)
SELECT count(*) AS n FROM (SELECT DISTINCT x.id, y.id FROM sorted x JOIN sorted y ON x.k1 = y.k1 AND x.k2 = y.k2 AND x.id < y.id)""")
def lsh_candidates_unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant whose keys lack the band number and are sorted: more candidates."""
    banded = M.bands(M.minhash_signatures(supplier_sets(spark, sf_dir), _N, _UNIVERSE), _ROWS, with_number=False)
    return M.candidate_pairs(banded).agg(F.count(F.lit(1)).alias("n"))


def _exact_sql(least: float) -> str:
    return f"""shared AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sets x JOIN sets y ON x.member = y.member AND x.id < y.id GROUP BY 1, 2),
sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY 1),
exact AS (SELECT a, b, c / (p.n + q.n - c) AS similarity FROM shared JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE c / (p.n + q.n - c) >= {least})"""


@BOOK.add(f"WITH {SETS_SQL}, {_exact_sql(0.4)} SELECT a, b, round(similarity, 6) AS similarity FROM exact")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.exact_pairs(supplier_sets(spark, sf_dir), 0.4).withColumn("similarity", F.round("similarity", 6))


@BOOK.add(f"""WITH {SETS_SQL}, {_signature_sql()}, {_BANDS_SQL}, c AS ({_CANDIDATES_SQL}), {_exact_sql(0.5)}
SELECT a, b, round(similarity, 6) AS similarity FROM exact JOIN c USING (a, b)""")
def lsh_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lsh_pairs(supplier_sets(spark, sf_dir), 0.5, _N, _ROWS, _UNIVERSE).withColumn("similarity", F.round("similarity", 6))


@BOOK.add(f"""WITH {SETS_SQL}, {_signature_sql()}, {_BANDS_SQL}, c AS ({_CANDIDATES_SQL}), {_exact_sql(0.4)}, hit AS (SELECT a, b FROM exact JOIN c USING (a, b))
SELECT (SELECT count(*) FROM hit) AS n_found, (SELECT count(*) FROM exact) AS n_true, (SELECT count(*) FROM hit) AS n_hit, 1.0::DOUBLE AS precision,
round((SELECT count(*) FROM hit) / (SELECT count(*) FROM exact), 6) AS recall""")
def lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = written(supplier_sets(spark, sf_dir))
    exact = written(M.exact_pairs(sets, 0.4))
    candidates = M.candidate_pairs(M.bands(M.minhash_signatures(sets, _N, _UNIVERSE), _ROWS))
    found = written(candidates.join(exact.select("a", "b"), ["a", "b"], "left_semi"))  # the exact test, without a row of two sets for each candidate
    made = M.precision_recall(found, exact, ["a", "b"])
    return made.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


# --- recommendation

_SUMS_SQL = """means AS (SELECT item, avg(stars) AS mean FROM train GROUP BY 1),
own AS (SELECT "user", item, stars, stars - mean AS d FROM train JOIN means USING (item)),
sums AS (SELECT x.item AS a, y.item AS b, count(*) AS n, sum(x.d * y.d) AS up, sqrt(sum(x.d * x.d)) * sqrt(sum(y.d * y.d)) AS down, corr(x.stars, y.stars) AS corr
FROM own x JOIN own y ON x."user" = y."user" AND x.item < y.item GROUP BY 1, 2),
raws AS (SELECT a, b, n, corr, CASE WHEN down > 0 THEN up / down ELSE 0 END AS raw FROM sums)"""
_RULES = {
    "plain": "CASE WHEN n < 3 THEN 0 ELSE raw END",
    "amplified": "CASE WHEN n < 3 THEN 0 WHEN raw < 0 THEN raw * 0.1 ELSE raw * 1.1 END",
    "floor": "CASE WHEN n <= 1 THEN 0 WHEN n < 10 THEN 0.05 WHEN raw < 0 THEN raw * 0.1 ELSE raw * 1.1 END",
    "strict": "CASE WHEN n <= 20 OR raw < 0 THEN 0 ELSE raw * 1.1 END",
}
_ALL_SQL = f"{SMALL_RATINGS_SQL}, train AS (SELECT * FROM ratings)"


def _pearson_query(rule: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = M.pearson(small_ratings(spark, sf_dir), rule=rule, without_user=True)
        return made.select("a", "b", "n", F.round("sim", 6).alias("sim"))

    query.__name__ = f"item_pearson_{rule}"
    return BOOK.add(f"WITH {_ALL_SQL}, {_SUMS_SQL} SELECT a, b, n, round({_RULES[rule]}, 6) AS sim FROM raws")(query)


for _rule in _RULES:
    _pearson_query(_rule)


@BOOK.add(f"WITH {_ALL_SQL}, {_SUMS_SQL} SELECT a, b, n, round(corr, 6) AS sim FROM raws WHERE n >= 3")
def item_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.co_rated_correlation(small_ratings(spark, sf_dir)).select("a", "b", "n", F.round("sim", 6).alias("sim"))


_SPLIT_SQL = f"""{SMALL_RATINGS_SQL}, h AS (SELECT *, {hashed_sql('"user"', 7)} * 31 + {hashed_sql('item', 9)} AS h FROM ratings),
train AS (SELECT "user", item, stars FROM h WHERE h % 10 <> 0), asked AS (SELECT "user", item, stars FROM h WHERE h % 10 = 0)"""


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings and whether they are asked, by a keyed hash of the pair; the others are learned from."""
    h = hashed("user", 7) * 31 + hashed("item", 9)
    return small_ratings(spark, sf_dir).withColumn("asked", h % 10 == 0)


def _cf_sql(rule: str, ladder: C.Ladder) -> str:
    keep = "sim <> 0" if ladder.nonzero_only and ladder.above == 0 else f"sim > {ladder.above}"
    order = "sim DESC" if ladder.most_similar else "sim"
    gate = "" if ladder.min_numerator is None else f" AND up > {ladder.min_numerator}"
    stand_in = "um" if ladder.fallback == "user" else "coalesce(im, um)"
    return f"""{_SUMS_SQL}, sims AS (SELECT a, b, {_RULES[rule]} AS sim FROM raws),
both_ways AS (SELECT a AS item, b AS other, sim FROM sims UNION ALL SELECT b, a, sim FROM sims),
near AS (SELECT q."user", q.item, s.other, s.sim, t.stars, row_number() OVER (PARTITION BY q."user", q.item ORDER BY {order}, s.other) AS place,
  count(*) OVER (PARTITION BY q."user", q.item) AS n FROM asked q JOIN train t ON t."user" = q."user" JOIN both_ways s ON s.item = q.item AND s.other = t.item WHERE {keep}),
tops AS (SELECT "user", item, max(n) AS n, sum(sim * stars) AS up, sum(abs(sim)) AS down, max(sim) AS best FROM near WHERE place <= {ladder.top} GROUP BY 1, 2),
um AS (SELECT "user", avg(stars) AS um FROM train GROUP BY 1), im AS (SELECT item, avg(stars) AS im FROM train GROUP BY 1),
predicted AS (SELECT "user", item, asked.stars, coalesce(n, 0) AS n, coalesce(best, -1) AS best, um, CASE WHEN um IS NULL THEN {ladder.default} WHEN im IS NULL THEN um
  WHEN coalesce(n, 0) >= {ladder.least_neighbours} AND down > 0{gate} THEN up / down ELSE {stand_in} END AS prediction
  FROM asked LEFT JOIN tops USING ("user", item) LEFT JOIN um USING ("user") LEFT JOIN im USING (item))"""


#: The prediction variants: similarity rule and ladder.
CF_VARIANTS = {
    "cf_least_similar": ("plain", C.Ladder(most_similar=False)),
    "cf_least_similar_gated": ("plain", C.Ladder(most_similar=False, min_numerator=25.0)),
    "cf_with_count": ("plain", C.Ladder(above=0.5)),
    "cf_top_five": ("plain", C.Ladder()),
    "cf_padded": ("plain", C.Ladder(above=0.1)),
    "cf_top_three": ("plain", C.Ladder(above=0.8, top=3, least_neighbours=3)),
    "cf_amplified_item_mean": ("amplified", C.Ladder(min_numerator=10.0, fallback="item")),
    "cf_top_two": ("floor", C.Ladder(top=2, least_neighbours=1, default=3.7512)),
    "cf_strict": ("strict", C.Ladder(above=0.05, top=10, least_neighbours=1)),
}


def _predictions(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rule, ladder = CF_VARIANTS[name]
    return C.predict_rated(_rated(spark, sf_dir), ladder, rule)


def _cf_query(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = _predictions(spark, sf_dir, name)
        return made.select("user", "item", F.round(F.col("prediction") + 1e-9, 5).alias("prediction"), "n", F.round(F.col("top")[0] + 1e-9, 5).alias("best"))

    query.__name__ = name
    rule, ladder = CF_VARIANTS[name]
    BOOK.add(f'WITH {_SPLIT_SQL}, {_cf_sql(rule, ladder)} SELECT "user", item, round(prediction + 1e-9, 5) AS prediction, n, round(best + 1e-9, 5) AS best FROM predicted')(query)


for _name in CF_VARIANTS:
    _cf_query(_name)

_HYBRID_SQL = f"""WITH {_SPLIT_SQL}, {_cf_sql("plain", CF_VARIANTS["cf_padded"][1])},
scored AS (SELECT "user", item, stars, n, prediction AS item_prediction, coalesce(um, 3.75) AS model_prediction FROM predicted)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, stars, n, item_prediction, model_prediction, strong; the model is the user's mean."""
    made = _predictions(spark, sf_dir, "cf_padded").withColumnRenamed("prediction", "item_prediction")
    return made.withColumn("model_prediction", F.coalesce("user_mean", F.lit(3.75)))


_KS = list(range(1, 500, 10))


@BOOK.add(f"{_HYBRID_SQL}, ks AS (SELECT unnest(range(1, 500, 10)) AS k) SELECT CAST(k AS INTEGER) AS k, round(sqrt(avg(pow(stars - (tanh(n / k) * item_prediction + (1 - tanh(n / k)) * model_prediction), 2))), 6) AS rmse FROM scored, ks GROUP BY k")
def blend_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.blend_sweep(_scored(spark, sf_dir), _KS).withColumn("rmse", F.round("rmse", 6))


@BOOK.add(f"""{_HYBRID_SQL} SELECT "user", item, round(tanh(n / 25000.0) * item_prediction + (1 - tanh(n / 25000.0)) * model_prediction + 1e-9, 5) AS prediction FROM scored""")
def blend_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.blend(F.col("item_prediction"), F.col("model_prediction"), F.col("n"), F.lit(25000.0))
    return _scored(spark, sf_dir).select("user", "item", F.round(made + 1e-9, 5).alias("prediction"))


_WIDE = list(range(10_000, 30_000, 1_000))


@BOOK.add(f"{_HYBRID_SQL}, ks AS (SELECT unnest(range(10000, 30000, 1000)) AS k) SELECT CAST(k AS INTEGER) AS k, round(sqrt(avg(pow(stars - (tanh(n / k) * item_prediction + (1 - tanh(n / k)) * model_prediction), 2))), 6) AS rmse FROM scored, ks GROUP BY k")
def blend_sweep_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.blend_sweep(_scored(spark, sf_dir), _WIDE).withColumn("rmse", F.round("rmse", 6))


@BOOK.add(f"""{_HYBRID_SQL}, strong AS (SELECT q."user", q.item, count(*) AS strong FROM asked q JOIN train t ON t."user" = q."user"
  JOIN both_ways s ON s.item = q.item AND s.other = t.item WHERE s.sim > 0.9 AND s.other <> q.item GROUP BY 1, 2),
a AS (SELECT scored.*, coalesce(strong, 0) AS strong FROM scored LEFT JOIN strong USING ("user", item))
SELECT "user", item, strong, round(CASE WHEN strong > 5 THEN ((strong - 5) * item_prediction + 10 * model_prediction) / (strong + 5) ELSE model_prediction END + 1e-9, 5) AS prediction FROM a""")
def alpha_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.alpha_hybrid(_scored(spark, sf_dir))
    return made.select("user", "item", "strong", F.round(F.col("prediction") + 1e-9, 5).alias("prediction"))


@BOOK.add(f"""{_HYBRID_SQL} SELECT "user", item, round(CASE WHEN n < 3 THEN model_prediction ELSE item_prediction END + 1e-9, 5) AS prediction FROM scored""")
def switching_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.switching(_scored(spark, sf_dir), (F.col("n") < 3).cast("int"))
    return made.select("user", "item", F.round(F.col("prediction") + 1e-9, 5).alias("prediction"))


@BOOK.add(f"""{_HYBRID_SQL}, e AS (SELECT round(abs(item_prediction - stars), 9) AS e, item_prediction AS p, stars FROM scored)
SELECT count(*) FILTER (e < 1) AS from_0, count(*) FILTER (e >= 1 AND e < 2) AS from_1, count(*) FILTER (e >= 2 AND e < 3) AS from_2, count(*) FILTER (e >= 3 AND e < 4) AS from_3,
count(*) FILTER (e >= 4) AS from_4, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(p), 6) AS mean_prediction, round(stddev_pop(p), 6) AS std_prediction,
round(avg(stars), 6) AS mean_stars, round(stddev_pop(stars), 6) AS std_stars FROM e""")
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.error_report(_scored(spark, sf_dir).withColumnRenamed("item_prediction", "prediction"))
    return made.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes])


@BOOK.add(f"""{_HYBRID_SQL} SELECT CAST(abs(model_prediction - stars) < abs(item_prediction - stars) AS INTEGER) AS model_wins, count(*) AS n FROM scored GROUP BY 1""")
def closer_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.closer_model(_scored(spark, sf_dir)).groupBy("model_wins").agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE_SQL = BOOK.queries, BOOK.sql
