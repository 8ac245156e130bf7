import json

from pyspark.sql import functions as F

from orequarry.operators.sketches import distinct_estimates
from orequarry.sources import readers, writers
from orequarry.streaming import sketches


def test_json_and_csv_readers(spark, tmp_path):
    (tmp_path / "review.json").write_text("\n".join(json.dumps({"user_id": f"u{i}", "business_id": "b", "stars": i, "date": "2018-01-02"}) for i in range(3)))
    assert readers.read_reviews(spark, f"{tmp_path}/review.json").agg(F.sum("stars")).first()[0] == 3.0
    (tmp_path / "ratings.csv").write_text("user_id,business_id,stars\nu,b,4\n")
    assert readers.read_ratings(spark, f"{tmp_path}/ratings.csv").first().stars == 4.0
    assert readers.read_ratings(spark, f"{tmp_path}/ratings.csv", with_stars=False, business_first=True).columns == ["business_id", "user_id"]
    (tmp_path / "business.json").write_text(json.dumps({"business_id": "b", "city": "X", "attributes": {"Wifi": "no"}, "categories": "a, b"}))
    assert readers.read_businesses(spark, f"{tmp_path}/business.json").first().attributes == {"Wifi": "no"}


def test_transactions_and_points(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"D","C","A","R","S","P"\n"11/1/2000","00123 ","x","y","z","004"\n')
    row = readers.read_transactions(spark, f"{tmp_path}/t.csv").first()
    assert (row.date_customer, row["product"]) == ("11/1/00-123", "4")
    (tmp_path / "p.txt").write_text("1,0,1.5,2\n2,1,3,4\n")
    points = readers.read_points(spark, f"{tmp_path}/p.txt")
    assert [(r.id, r.label, list(r.features)) for r in points.orderBy("id").collect()] == [(1, 0, [1.5, 2.0]), (2, 1, [3.0, 4.0])]
    assert readers.slices(points, "id", 5).where("slice between 0 and 4").count() == 2


def test_text_draws_and_matrix(spark, tmp_path):
    (tmp_path / "users.txt").write_text("\n".join(f"u{i}" for i in range(20)))
    lines = readers.read_text(spark, f"{tmp_path}/users.txt", partitions=3)
    assert lines.rdd.getNumPartitions() == 3
    made = readers.draws(lines, "value", batches=3, size=10)
    assert made.groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 10), (1, 10), (2, 10)]
    assert {tuple(r) for r in made.collect()} == {tuple(r) for r in readers.draws(lines, "value", batches=3, size=10).collect()}
    spark.createDataFrame([(1.0, None), (float("nan"), 2)], "a double, b long").write.parquet(f"{tmp_path}/m")
    assert sorted(map(tuple, readers.read_matrix(spark, f"{tmp_path}/m").collect())) == [(0.0, 2), (1.0, 0)]


def test_text_writers(spark, tmp_path):
    sets = spark.createDataFrame([("frequent", ["b"]), ("frequent", ["a", "b"]), ("frequent", ["a"])], "section string, items array<string>")
    writers.write_itemsets(sets, f"{tmp_path}/items")
    assert [r.value for r in spark.read.text(f"{tmp_path}/items").where("size = 1").orderBy("value").collect()] == ["('a')", "('b')"]
    edges = spark.createDataFrame([("a", "b", 1.123456), ("a", "c", 2.0)], "src string, dst string, value double")
    writers.write_betweenness(edges, f"{tmp_path}/edges")
    assert {r.value for r in spark.read.text(f"{tmp_path}/edges").collect()} == {"('a', 'b'), 1.12346", "('a', 'c'), 2.0"}
    writers.write_communities(spark.createDataFrame([(["b", "a"],)], "members array<string>"), f"{tmp_path}/com")
    assert spark.read.text(f"{tmp_path}/com").first().value == "'a', 'b'"
    writers.write_city_means(spark.createDataFrame([("X", 3.25)], "city string, stars double"), f"{tmp_path}/city")
    assert spark.read.option("header", True).csv(f"{tmp_path}/city").first().stars == "3.2"


def _files(spark, tmp_path, n):
    for i in range(n):
        rows = [(i * 50 + j, (i * 50 + j) * 7 % 90) for j in range(50)]
        spark.createDataFrame(rows, "event_id long, user_id long").coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    return spark.createDataFrame([], "event_id long, user_id long").schema


def test_streams_equal_batch_forms(spark, tmp_path):
    schema = _files(spark, tmp_path, 3)
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    everything = spark.read.option("recursiveFileLookup", True).schema(schema).parquet(f"{tmp_path}/in")
    bloom = sketches.bloom_stream(stream(), "user_id", spark).agg(F.sum("n").alias("n"), F.sum("fp").alias("fp"), F.sum("unseen").alias("unseen")).first()
    assert (bloom.n, bloom.fp, bloom.unseen) == (150, 0, everything.select("user_id").distinct().count())  # no false negatives
    estimates = sketches.distinct_stream(stream(), "user_id", spark)
    assert estimates.count() == 3
    whole = distinct_estimates(sketches.keyed(everything, "user_id").withColumn("batch_id", F.lit(0)))
    assert estimates.agg(F.max("estimate")).first()[0] <= whole.first().estimate
    sample = sketches.reservoir_stream(stream(), "event_id", spark, k=20).select("draw", "id").distinct().orderBy("draw", "id").limit(20)
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("553"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("long")
    want = everything.orderBy(draw, "event_id").limit(20).select("event_id")
    assert {r.id for r in sample.collect()} == {r.event_id for r in want.collect()}


def test_generated_strings_and_measuring(spark, tmp_path):
    from orequarry.operators.measure import measured

    (tmp_path / "in.txt").write_text("ACTG\n3\n1\nTA\n0\n")
    row = readers.read_generated(spark, f"{tmp_path}/in.txt").first()
    assert (row.a, row.b) == ("ACACTGACTGTGACTG", "TTAA")
    out, ms, kb = measured(lambda x: x + 1)(1)
    assert out == 2 and ms >= 0 and kb > 0


def test_models_and_reports_are_kept(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    table = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    writers.save_model(Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(table), f"{tmp_path}/model")
    assert list(readers.load_model(f"{tmp_path}/model").transform(table).first().v) == [1.0, 2.0]
    writers.write_report(table, f"{tmp_path}/report")
    assert json.loads(spark.read.text(f"{tmp_path}/report").first().value) == {"a": 1.0, "b": 2.0}
    append = writers.append_batch(f"{tmp_path}/batches")
    append(table, 0)
    append(table, 1)
    assert spark.read.option("header", True).csv(f"{tmp_path}/batches").count() == 2
