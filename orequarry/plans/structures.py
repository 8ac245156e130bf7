"""Graph, sketch, clustering, sequence, feature and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orequarry.functions import scalars as X
from orequarry.operators import clustering as K
from orequarry.operators import features as E
from orequarry.operators import graph as G
from orequarry.operators import learning as L
from orequarry.operators import recommend as C
from orequarry.operators import sequences as Q
from orequarry.operators import sketches as S
from orequarry.operators.scratch import cut_lineage, written
from orequarry.operators.similarity import PRIME, hash_parameters
from orequarry.plans.base import RATINGS_SQL, SETS_SQL, Book, hashed, ratings, read, supplier_sets
from orequarry.sources.readers import slices
from orequarry.streaming import sketches as T

BOOK = Book()

# --- graph

_SHARED = 34
_PAIRS_SQL = f"""{SETS_SQL}, pairs AS (SELECT x.id AS src, y.id AS dst FROM sets x JOIN sets y ON x.member = y.member AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= {_SHARED}),
edges AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs), vertices AS (SELECT DISTINCT src AS id FROM edges)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(G.cooccurrence(supplier_sets(spark, sf_dir), _SHARED))


@BOOK.add(f"WITH {_PAIRS_SQL} SELECT src, dst FROM edges")
def cooccurrence_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@BOOK.add(f"WITH {_PAIRS_SQL} SELECT src AS id, count(*) AS degree FROM edges GROUP BY 1")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_edges(spark, sf_dir))


_COMPONENTS_SQL = f"""WITH RECURSIVE {_PAIRS_SQL}, reach AS (SELECT id, id AS other FROM vertices UNION SELECT reach.id, edges.dst FROM reach JOIN edges ON edges.src = reach.other),
comps AS (SELECT id, min(other) AS component FROM reach GROUP BY 1)"""


@BOOK.add(f"{_COMPONENTS_SQL} SELECT id, component FROM comps")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(_edges(spark, sf_dir))


@BOOK.add(f"""{_COMPONENTS_SQL}, e AS (SELECT a.component AS cs, b.component AS cd FROM edges JOIN comps a ON a.id = src JOIN comps b ON b.id = dst),
per AS (SELECT cs, count(*) AS d, count(*) FILTER (cs = cd) AS inside FROM e GROUP BY 1)
SELECT round(sum(inside) / sum(d) - sum(d * d) / (sum(d) * sum(d)), 6)::DOUBLE AS modularity FROM per""")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return G.modularity(edges, G.components(edges)).select(F.round("modularity", 6).alias("modularity"))


def _propagation_sql() -> str:
    rounds = ["l0 AS (SELECT id, id AS label FROM vertices)"]
    for i in range(5):
        rounds.append(
            f"v{i} AS (SELECT e.dst AS id, l.label, count(*) AS n FROM edges e JOIN l{i} l ON l.id = e.src GROUP BY 1, 2), "
            f"l{i + 1} AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM v{i}) WHERE r = 1)"
        )
    return f"WITH {_PAIRS_SQL}, {', '.join(rounds)} SELECT id, label FROM l5"


@BOOK.add(_propagation_sql())
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.label_propagation(_edges(spark, sf_dir))


@BOOK.add(f"{_COMPONENTS_SQL} SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM comps GROUP BY component")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.communities(G.components(_edges(spark, sf_dir)), "component")
    return found.select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@BOOK.add(f"""WITH RECURSIVE {_PAIRS_SQL}, walk AS (SELECT id AS root, id, 0 AS level FROM vertices
UNION SELECT walk.root, edges.dst, walk.level + 1 FROM walk JOIN edges ON edges.src = walk.id WHERE walk.level < 30)
SELECT root, id, CAST(min(level) AS INTEGER) AS level FROM walk GROUP BY 1, 2""")
def shortest_path_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shortest_paths(_edges(spark, sf_dir)).select("root", "id", "level")


@BOOK.add()
def edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strongest_first(G.edge_betweenness(_edges(spark, sf_dir))).withColumn("value", F.round("value", 5))


#: The toy graph: seven vertices, nine edges.
TOY = [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("d", "e"), ("d", "f"), ("d", "g"), ("e", "f"), ("f", "g")]


def toy_edges(spark: SparkSession) -> DataFrame:
    return G.both_directions(spark.createDataFrame(TOY, "src string, dst string"))


@BOOK.add("""SELECT * FROM (VALUES ('a','b',5.0::DOUBLE), ('a','c',1.0), ('b','c',5.0), ('b','d',12.0), ('d','e',4.5), ('d','f',4.0), ('d','g',4.5), ('e','f',1.5), ('f','g',1.5)) AS t(src, dst, value)""")
def toy_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edge_betweenness(toy_edges(spark)).withColumn("value", F.round("value", 6))


@BOOK.add("SELECT * FROM (VALUES ('a','a'), ('b','a'), ('c','a'), ('d','d'), ('e','d'), ('f','d'), ('g','d')) AS t(id, component)")
def toy_girvan_newman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.girvan_newman(toy_edges(spark))[0]


@BOOK.add("SELECT * FROM (VALUES ('Alice', 'friend', 'Bob'), ('Bob', 'follow', 'Charlie'), ('Charlie', 'follow', 'Bob')) AS t(who, relationship, whom)")
def toy_property_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices and edges with properties, joined to triples."""
    people = spark.createDataFrame([("1", "Alice", 34), ("2", "Bob", 36), ("3", "Charlie", 30)], "id string, name string, age int")
    links = spark.createDataFrame([("1", "2", "friend"), ("2", "3", "follow"), ("3", "2", "follow")], "src string, dst string, relationship string")
    named = lambda end, name: people.select(F.col("id").alias(end), F.col("name").alias(name))
    return links.join(named("src", "who"), "src").join(named("dst", "whom"), "dst").select("who", "relationship", "whom")


@BOOK.add()
def girvan_newman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.girvan_newman(_edges(spark, sf_dir))[0]


# --- sketches

_BATCH = 300
_STREAM_SQL = f"""stream AS (SELECT seq, seq // {_BATCH} AS batch_id, CAST(user_id AS VARCHAR) AS key, ('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % {PRIME} AS x
FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, user_id FROM events))"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.numbered(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], _BATCH)


def _bloom_sql(n_hashes: int, size: int, time: str) -> str:
    each = ", ".join(f"(({a} * x + {b}) % {PRIME}) % {size}" for a, b in hash_parameters(n_hashes))
    return f"""WITH {_STREAM_SQL}, bits AS (SELECT *, {time} AS t, unnest([{each}]) AS bit FROM stream),
marked AS (SELECT *, min(t) OVER (PARTITION BY bit) < t AS hit, min(t) OVER (PARTITION BY x) >= t AS unseen FROM bits),
each AS (SELECT seq, batch_id, bool_and(hit) AS known, bool_and(unseen) AS unseen FROM marked GROUP BY 1, 2),
c AS (SELECT batch_id, count(*) FILTER (unseen AND known) AS fp, count(*) FILTER (unseen) AS unseen FROM each GROUP BY 1)
SELECT batch_id, fp, unseen, CASE WHEN fp + unseen > 0 THEN round(fp / (fp + unseen), 6) ELSE 0 END AS rate, CASE WHEN unseen > 0 THEN round(fp / unseen, 6) ELSE 0 END AS strict_rate FROM c"""


def _bloom(spark: SparkSession, sf_dir: str, n_hashes: int, size: int, whole_batch: bool) -> DataFrame:
    made = S.bloom_rates(_stream(spark, sf_dir), n_hashes, size, whole_batch)
    return made.withColumn("rate", F.round("rate", 6)).withColumn("strict_rate", F.round("strict_rate", 6))


@BOOK.add(_bloom_sql(16, S.BITS, "seq"))
def bloom_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bloom(spark, sf_dir, 16, S.BITS, False)


@BOOK.add(_bloom_sql(5, 300, "batch_id"))
def bloom_fpr_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hashes, a small filter and insertion after the whole batch."""
    return _bloom(spark, sf_dir, 5, 300, True)


@BOOK.add(_bloom_sql(2, 119267, "seq"))
def bloom_fpr_two_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bloom(spark, sf_dir, 2, 119267, False)


def _fm_sql(n_hashes: int, estimate: str) -> str:
    hashes = [f"((({a} * x + {b}) % {PRIME}) % {1 << 20})" for a, b in hash_parameters(n_hashes)]
    zeros = [f"max(CASE WHEN {h} = 0 THEN 0 ELSE length(bin({h})) - length(rtrim(bin({h}), '0')) END) AS z{i}" for i, h in enumerate(hashes)]
    return f"WITH {_STREAM_SQL}, z AS (SELECT batch_id, count(DISTINCT x) AS truth, {', '.join(zeros)} FROM stream GROUP BY 1) SELECT batch_id, truth, CAST({estimate} AS DOUBLE) AS estimate FROM z"


_POWERS = [f"pow(2, z{i})" for i in range(10)]


@BOOK.add(_fm_sql(10, f"list_sort([{', '.join(_POWERS)}])[6]"))
def fm_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distinct_estimates(_stream(spark, sf_dir))


@BOOK.add(_fm_sql(5, f"({' + '.join(_POWERS[:5])}) / 5"))
def fm_estimate_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distinct_estimates(_stream(spark, sf_dir), 5, how="mean")


@BOOK.add(f"""WITH {_STREAM_SQL}, d AS (SELECT *, ('0x' || substr(md5('553:' || seq), 1, 8))::BIGINT AS draw FROM stream)
SELECT CAST(row_number() OVER (ORDER BY draw, seq) - 1 AS INTEGER) AS place, seq, key FROM d ORDER BY draw, seq LIMIT 100""")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reservoir(_stream(spark, sf_dir))


@BOOK.add(f"""WITH {_STREAM_SQL}, d AS (SELECT *, ('0x' || substr(md5('553:' || seq), 1, 8))::BIGINT AS draw FROM stream),
p AS (SELECT row_number() OVER (ORDER BY draw, seq) - 1 AS place, seq, key FROM d ORDER BY draw, seq LIMIT 100)
SELECT CAST(place AS INTEGER) AS place, key FROM p WHERE place % 20 = 0""")
def reservoir_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of slots 0, 20, 40, 60 and 80."""
    return S.reservoir(_stream(spark, sf_dir)).where("place % 20 = 0").select("place", "key")


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.file_stream(spark, sf_dir, "events.parquet", read(spark, sf_dir, "events").schema)


@BOOK.add(f"""WITH {_STREAM_SQL}, e AS (SELECT x % 8 AS part, x FROM stream) SELECT 0::BIGINT AS batch_id, part, count(*) AS n, 0::BIGINT AS fp, count(DISTINCT x) AS unseen FROM e GROUP BY part""")
def stream_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One micro-batch: the file. With so few keys a part's filter of 69997 bits has no false positive."""
    return T.bloom_stream(_events_stream(spark, sf_dir), "user_id", spark)


@BOOK.add(_fm_sql(10, f"list_sort([{', '.join(_POWERS)}])[6]").replace(f"seq // {_BATCH} AS batch_id", "0::BIGINT AS batch_id"))
def stream_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.distinct_stream(_events_stream(spark, sf_dir), "user_id", spark)


@BOOK.add("""WITH d AS (SELECT event_id AS id, ('0x' || substr(md5('553:' || event_id), 1, 8))::BIGINT AS draw FROM events)
SELECT draw, id FROM d ORDER BY draw, id LIMIT 100""")
def stream_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.reservoir_stream(_events_stream(spark, sf_dir), "event_id", spark)
    return found.orderBy("draw", "id").limit(100).select("draw", "id")


# --- clusters


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").cast("array<double>").alias("features"))


_LONG_SQL = "long AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)"


@BOOK.add(f"WITH {_LONG_SQL} SELECT label, pos - 1 AS pos, count(*) AS n, round(sum(v), 4) AS s, round(sum(v * v), 4) AS ss FROM long GROUP BY 1, 2")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = K.summaries(_points(spark, sf_dir), "label")
    long = made.select("label", "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("pos", "e"))
    return long.select("label", F.col("pos").cast("long").alias("pos"), "n", F.round("e.sum", 4).alias("s"), F.round("e.sumsq", 4).alias("ss"))


@BOOK.add(f"""WITH {_LONG_SQL}, stat AS (SELECT label AS cluster, pos, sum(v) / count(*) AS c, sqrt(greatest(sum(v * v) / count(*) - pow(sum(v) / count(*), 2), 1e-12)) AS s FROM long GROUP BY 1, 2),
d AS (SELECT id, cluster, sqrt(sum(pow((v - c) / s, 2))) AS distance FROM long JOIN stat USING (pos) GROUP BY 1, 2)
SELECT id, arg_min(cluster, (distance, cluster)) AS cluster, round(min(distance), 4) AS distance FROM d GROUP BY 1""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    stats = K.summaries(points, "label").withColumnRenamed("label", "cluster")
    return K.nearest(points.select("id", "features"), stats).select("id", "cluster", F.round("distance", 4).alias("distance"))


@BOOK.add()
def bfr_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = slices(_points(spark, sf_dir), "id", 5)
    return K.out_of_core(points, k=10)[0]


@BOOK.add()
def bfr_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return K.purity(K.out_of_core(slices(points, "id", 5), k=10, over=8, least=4)[0], points.select("id", "label"))


# --- sequences


@BOOK.add("""SELECT * FROM (VALUES (1, 0::BIGINT), (2, 30), (3, 60), (4, 48), (5, 120)) AS t(n, cost)""")
def align_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "ACGT", "ACGT"), (2, "ACGT", "ACG"), (3, "A", "C"), (4, "AAA", "AGA"), (5, "", "ACGT")]
    return spark.createDataFrame(rows, "n int, a string, b string").select("n", Q.alignment_cost("a", "b").alias("cost"))


#: Base strings, the positions that double them, and the cost of aligning the two results.
GOLDEN = [
    (1, "ACTG", [3, 6, 1, 1], "TACG", [1, 2, 9, 2], 1296),
    (2, "ACTG", [3, 6, 1, 1], "TACG", [1, 2, 0], 1128),
    (3, "AGTC", [0, 0, 0, 0, 0], "TACG", [1, 1, 1, 1, 1], 1980),
    (4, "TCGA", [3, 7, 15, 31, 62], "TCGA", [3, 7, 15, 31, 63], 60),
    (5, "ACGT", [3, 6, 1, 1, 5, 6, 7, 8, 9, 20], "TACG", [1, 2, 0, 4, 3, 2, 0, 5, 6, 17], 63996),
]


@BOOK.add("SELECT * FROM (VALUES " + ", ".join(f"({g[0]}, {4 << len(g[2])}, {4 << len(g[4])}, {g[5]}::BIGINT)" for g in GOLDEN) + ") AS t(n, length_a, length_b, cost)")
def align_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings doubled by position, then aligned."""
    rows = spark.createDataFrame([g[:5] for g in GOLDEN], "n int, a string, at_a array<int>, b string, at_b array<int>")
    made = rows.select("n", X.doubled(F.col("a"), F.col("at_a")).alias("a"), X.doubled(F.col("b"), F.col("at_b")).alias("b"))
    return made.select("n", F.length("a").alias("length_a"), F.length("b").alias("length_b"), Q.alignment_cost(F.col("a"), F.col("b")).alias("cost"))


@BOOK.add("SELECT * FROM (VALUES (1, 30::BIGINT, 'ACGT', 'AC_T'), (2, 60, 'A_', '_C')) AS t(n, cost, aligned_a, aligned_b)")
def align_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "ACGT", "ACT"), (2, "A", "C")]
    made = Q.aligned(spark.createDataFrame(rows, "n int, a string, b string"), "a", "b")
    return made.select("n", "cost", "aligned_a", "aligned_b")


# --- features


def _part_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with an attribute map, one value of it a dict literal."""
    literal = F.concat(F.lit("{'big': "), F.when(F.col("p_size") > 25, "True").otherwise("False"), F.lit(", 'small': "), F.when(F.col("p_size") < 5, "True").otherwise("False"), F.lit("}"))
    made = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), literal)
    return read(spark, sf_dir, "part").select("p_partkey", made.alias("attributes"))


@BOOK.add("""SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS brand, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS type,
CAST(p_size > 25 AS INTEGER) AS size_big, CAST(p_size < 5 AS INTEGER) AS size_small FROM part""")
def attr_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = E.flat_attributes(_part_map(spark, sf_dir), "p_partkey", "attributes")
    made = E.encode_attributes(flat, "p_partkey", E.ordinals(flat), ["brand", "type", "size.big", "size.small"])
    return made.select("p_partkey", "brand", "type", F.col("`size.big`").alias("size_big"), F.col("`size.small`").alias("size_small"))


@BOOK.add("SELECT 'brand' AS name, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'type', count(DISTINCT p_type) FROM part UNION ALL SELECT 'size.big', count(DISTINCT p_size > 25) FROM part UNION ALL SELECT 'size.small', count(DISTINCT p_size < 5) FROM part")
def attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = E.flat_attributes(_part_map(spark, sf_dir), "p_partkey", "attributes")
    return E.ordinals(flat).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("""WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part),
f AS (SELECT term, count(*) AS freq, row_number() OVER (ORDER BY term) - 1 AS code FROM t GROUP BY 1),
r AS (SELECT p_partkey, code, row_number() OVER (PARTITION BY p_partkey ORDER BY freq DESC, code DESC) AS r FROM t JOIN f USING (term))
SELECT p_partkey, CAST(coalesce(max(code) FILTER (r = 1), -1) AS INTEGER) AS term_1, CAST(coalesce(max(code) FILTER (r = 2), -1) AS INTEGER) AS term_2,
CAST(coalesce(max(code) FILTER (r = 3), -1) AS INTEGER) AS term_3 FROM r GROUP BY 1""")
def top3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_terms(read(spark, sf_dir, "part"), "p_partkey", F.split("p_name", " ")).na.fill(-1)


@BOOK.add("""WITH f AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, round(date_diff('day', d, DATE '2018-01-01') / 365.0, 6) AS age, CASE WHEN n % 3 = 0 THEN 0 ELSE n END AS n_friends FROM f""")
def user_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d"), F.count(F.lit(1)).alias("n"))
    listed = F.when(F.col("n") % 3 == 0, F.lit("None")).otherwise(F.array_join(F.array_repeat(F.lit("x"), F.col("n").cast("int")), ","))
    return first.select("o_custkey", F.round(E.age_years(F.to_date("d"), "2018-01-01"), 6).alias("age"), E.listed(listed).cast("long").alias("n_friends"))


@BOOK.add(f"""WITH {RATINGS_SQL}, u AS (SELECT "user", avg(stars) AS um, count(*) AS un FROM ratings GROUP BY 1), i AS (SELECT item, avg(stars) AS im, count(*) AS n_item, var_pop(stars) AS iv FROM ratings GROUP BY 1)
SELECT "user", item, round(um + 1e-9, 5) AS user_mean, un AS user_n, round(im + 1e-9, 5) AS item_mean, n_item AS item_n, round(iv + 1e-9, 5) AS item_var, c_acctbal, s_acctbal
FROM ratings JOIN u USING ("user") JOIN i USING (item) JOIN customer ON c_custkey = "user" JOIN supplier ON s_suppkey = item""")
def rating_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _rating_features(spark, sf_dir)
    rounded = [F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("user_mean", "item_mean", "item_var")]
    return made.select("user", "item", "user_n", "item_n", "c_acctbal", "s_acctbal", *rounded)


def _rating_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cut_lineage(ratings(spark, sf_dir))
    users = table.groupBy("user").agg(F.avg("stars").alias("user_mean"), F.count(F.lit(1)).alias("user_n"))
    items = table.groupBy("item").agg(F.avg("stars").alias("item_mean"), F.count(F.lit(1)).alias("item_n"), F.var_pop("stars").alias("item_var"))
    users = users.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), "c_acctbal"), "user")
    items = items.join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), "s_acctbal"), "item")
    return E.rating_features(table, users, items)


# --- models: trees and networks have no SQL form; tests compare their errors with that of a constant

_COLUMNS = ["user_mean", "user_n", "item_mean", "item_n", "c_acctbal", "s_acctbal"]


def _train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    table, columns = L.with_missing_flags(_rating_features(spark, sf_dir), _COLUMNS)
    table = cut_lineage(table.withColumn("fold", hashed("user", 5) % 5))
    return table.where("fold <> 0"), table.where("fold = 0"), columns


@BOOK.add()
def gbt_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, columns = _train_test(spark, sf_dir)
    model = L.boosted_regression(train, columns, "stars", trees=10, subsample=0.8, features="0.8")
    return C.error_report(model.transform(test).select("prediction", "stars"))


@BOOK.add()
def model_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The switching hybrid: a classifier tells which of two predictions is closer."""
    train, test, columns = _train_test(spark, sf_dir)
    both = lambda t: C.closer_model(t.withColumn("model_prediction", F.col("user_mean")).withColumn("item_prediction", F.col("item_mean")))
    model = L.boosted_selector(both(train), columns, "model_wins", trees=5)
    scored = L.probabilities(model.transform(both(test)).withColumnRenamed("prediction", "chosen"))
    return C.error_report(C.switching(scored, F.col("chosen")).select("prediction", "stars"))


#: Items up to here are broadcast with their features, about 40 bytes an item.
_FEW = 500_000


def _narrow_train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """The rows of _train_test, made anew for each use from one written row a user: the wide table is neither written nor shuffled by user."""
    rated = ratings(spark, sf_dir, by_user=True).groupBy("user").agg(F.collect_list(F.struct("item", "stars")).alias("rated"), F.avg("stars").alias("user_mean"), F.count(F.lit(1)).alias("user_n"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), "c_acctbal", F.lit(True).alias("known"))
    known = [F.when(F.col("known"), F.col(c)).alias(c) for c in ("user_mean", "user_n")]  # as in _rating_features
    table = written(rated.join(customers, "user", "left").select("user", "rated", "c_acctbal", *known, (hashed("user", 5) % 5).alias("fold")))
    rows = table.select("user", "fold", "user_mean", "user_n", "c_acctbal", F.explode("rated").alias("r")).select("*", "r.*").drop("r")
    items = table.select(F.explode("rated").alias("r")).select("r.*").groupBy("item").agg(F.avg("stars").alias("item_mean"), F.count(F.lit(1)).alias("item_n"))
    items = written(items.join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), "s_acctbal"), "item"))
    rows = rows.join(F.broadcast(items) if items.count() <= _FEW else items, "item", "left")
    rows, columns = L.with_missing_flags(rows, _COLUMNS)
    return rows.where("fold <> 0"), rows.where("fold = 0"), columns


@BOOK.add()
def network_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, columns = _narrow_train_test(spark, sf_dir)
    labelled = lambda t: t.withColumn("above", (F.col("stars") > F.col("item_mean")).cast("int"))
    model = L.network(labelled(train), columns[:6], "above")
    return L.accuracy(L.classified(model, labelled(test), columns[:6], "above"), "above")


@BOOK.add()
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, columns = _train_test(spark, sf_dir)
    return L.grid_search(train, columns, "stars", {"maxDepth": [2, 4]}, trees=2)


@BOOK.add()
def feature_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, columns = _train_test(spark, sf_dir)
    return L.eliminate_features(train, columns[:6], "stars", least=4, trees=2)


@BOOK.add()
def cf_features_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature augmentation: the item-based prediction, its neighbours and similarities join the other features."""
    from orequarry.plans import mining as P

    made = P._predictions(spark, sf_dir, "cf_padded").withColumnRenamed("prediction", "cf")
    table = made.select("user", "item", "stars", "cf", "n", *[F.col("top")[i].alias(f"sim_{i}") for i in range(5)])
    table, columns = L.with_missing_flags(cut_lineage(table), ["cf", "n", *[f"sim_{i}" for i in range(5)]])
    fold = hashed("user", 5) % 5
    model = L.boosted_regression(table.where(fold != 0), columns, "stars", trees=5)
    return C.error_report(model.transform(table.where(fold == 0)).select("prediction", "stars"))


QUERIES, ORACLE_SQL = BOOK.queries, BOOK.sql
