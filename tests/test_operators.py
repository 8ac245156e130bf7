import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orequarry.functions import scalars
from orequarry.operators import clustering, copairs, features, graph, itemsets, learning, perceptron, recommend, relational, sequences, setpairs, similarity, sketches
from orequarry.plans.structures import toy_edges

def plain_cost(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    table[:, 0], table[0] = 30 * np.arange(len(a) + 1), 30 * np.arange(len(b) + 1)
    cost = lambda x, y: 0 if x == y else sequences.MISMATCH["".join(sorted(x + y))]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = min(table[i - 1, j] + 30, table[i, j - 1] + 30, table[i - 1, j - 1] + cost(x, y))
    return int(table[-1, -1])


def rescored(a, b):
    assert len(a) == len(b)
    return sum(30 if "_" in (x, y) else 0 if x == y else sequences.MISMATCH["".join(sorted(x + y))] for x, y in zip(a, b, strict=True))


def test_alignment_cost_and_strings():
    random.seed(1)
    for _ in range(60):
        a, b = ("".join(random.choice("ACGT") for _ in range(random.randrange(0, 150))) for _ in "ab")
        cost, x, y = sequences.align(a, b)
        assert cost == plain_cost(a, b) == sequences.cost(a, b) == rescored(x, y)
        assert x.replace("_", "") == a and y.replace("_", "") == b


def test_alignment_of_long_doubled_strings(spark):
    double = lambda s, at: s if not at else double(s[: at[0] + 1] + s + s[at[0] + 1 :], at[1:])
    a, b = double("ACTG", [3, 6, 1, 1]), double("TACG", [1, 2, 9, 2])
    made = spark.createDataFrame([(a, "ACTG", [3, 6, 1, 1])], "want string, s string, at array<int>")
    assert made.select(scalars.doubled(F.col("s"), F.col("at")).alias("x")).first().x == a
    assert sequences.cost(a, b) == plain_cost(a, b)
    rows = spark.createDataFrame([(a, b), (None, "A"), ("", "AC")], "a string, b string")
    assert [r.c for r in rows.select(sequences.alignment_cost(F.col("a"), F.col("b")).alias("c")).collect()] == [plain_cost(a, b), None, 60]
    assert sequences.aligned(rows, "a", "b").where("a IS NULL").first().cost == 30


def test_toy_betweenness_and_cuts(spark):
    edges = toy_edges(spark)
    got = {(r.src, r.dst): r.value for r in graph.edge_betweenness(edges).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {("a", "b"): 5, ("a", "c"): 1, ("b", "c"): 5, ("b", "d"): 12, ("d", "e"): 4.5, ("d", "f"): 4, ("d", "g"): 4.5, ("e", "f"): 1.5, ("f", "g"): 1.5}
    left = graph.cut_edges(edges, graph.edge_betweenness(edges))
    assert {r.component for r in graph.components(left).collect()} == {"a", "d"}
    one = graph.cut_edges(edges, graph.edge_betweenness(edges), all_ties=False)
    assert edges.count() - one.count() == 2


def test_girvan_newman_scores(spark):
    best, scores = graph.girvan_newman(toy_edges(spark))
    assert {frozenset(r.members) for r in graph.communities(best, "component").collect()} == {frozenset("abc"), frozenset("defg")}
    assert scores[0] == 0 and max(scores) == pytest.approx(0.3642, abs=1e-3) and all(s <= 1 for s in scores)
    half = graph.modularity(toy_edges(spark), best, half_sum=True).first().modularity
    assert 0 < half < max(scores)


def test_girvan_newman_goes_on_until_modularity_falls(spark):
    """Two groups of 5 joined by 4 edges that go one at a time: no split before the last is gone."""
    inside = [(g + x, g + y) for g in (0, 5) for x in range(5) for y in range(x + 1, 5)]
    edges = graph.both_directions(spark.createDataFrame(inside + [(0, 5), (1, 6), (2, 7), (3, 8)], "src long, dst long"))
    best, scores = graph.girvan_newman(edges, all_ties=False)
    assert {frozenset(r.members) for r in graph.communities(best, "component").collect()} == {frozenset(range(5)), frozenset(range(5, 10))}
    assert scores[:4] == [0.0] * 4 and scores[-2] == max(scores) > scores[-1]


def test_girvan_newman_goes_on_past_the_old_rounds(spark, monkeypatch):
    """A graph that takes 60 rounds to split; betweenness is the order of the edges."""
    n = 60
    edges = graph.both_directions(spark.createDataFrame([(k, k + 1) for k in range(3)], "src long, dst long"))
    values = iter([0.0] * n + [0.5, 0.2])
    monkeypatch.setattr(graph, "modularity", lambda *a, **b: edges.limit(1).select(F.lit(next(values)).alias("modularity")))
    monkeypatch.setattr(graph, "edge_betweenness", lambda e: e)
    monkeypatch.setattr(graph, "cut_edges", lambda e, *a: e)
    monkeypatch.setattr(graph, "components", lambda e, ids: ids)
    assert graph.girvan_newman(edges)[1] == [0.0] * n + [0.5, 0.2]


def test_graph_edge_cases(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.components(none).count() == 0 and graph.edge_betweenness(none).count() == 0
    assert graph.girvan_newman(none)[1] == []
    two = graph.both_directions(spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long"))
    assert {(r.id, r.component) for r in graph.components(two).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
    assert {(r.id, r.label) for r in graph.label_propagation(two, 1).collect()} == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_itemsets_agree(spark):
    random.seed(2)
    rows = [sorted(random.sample("abcdefgh", random.randrange(1, 6))) for _ in range(150)]
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "basket long, items array<string>").repartition(3)
    want = {}
    for k in range(1, 6):
        for c in itertools.combinations("abcdefgh", k):
            n = sum(set(c) <= set(r) for r in rows)
            if n >= 15:
                want[c] = n
    as_dict = lambda df: {tuple(r["items"]): r.freq for r in df.collect()}
    assert as_dict(itemsets.level_wise(table, 15, 5)) == want
    assert as_dict(itemsets.fp_growth(table, 15)) == want
    assert as_dict(itemsets.two_pass(table, 15, 5)) == want
    assert itemsets.level_wise(table.limit(0), 2, 3).count() == 0 and itemsets.fp_growth(table.limit(0), 2).count() == 0


def test_lsh_is_within_exact_and_finds_most(spark):
    random.seed(3)
    rows = []
    for i in range(60):
        base = random.sample(range(400), 25)
        for j in range(2):
            rows += [(2 * i + j, m) for m in set(base[: 25 - 3 * j]) | set(random.sample(range(400, 500), 2 * j))]
    sets = spark.createDataFrame(rows, "id long, member long").distinct()
    exact = {(r.a, r.b) for r in similarity.exact_pairs(sets, 0.5).collect()}
    found = {(r.a, r.b) for r in similarity.lsh_pairs(sets, 0.5, 50, 2, 100_003).collect()}
    assert found <= exact and len(found) >= 0.95 * len(exact) and exact


def test_prediction_ladder(spark):
    ratings = spark.createDataFrame([("u", "x", 4.0), ("u", "y", 2.0), ("v", "x", 5.0), ("v", "z", 3.0)], "user string, item string, stars double")
    sims = spark.createDataFrame([("x", "z", 0.8), ("y", "z", 0.4)], "a string, b string, sim double")
    asked = spark.createDataFrame([("u", "z"), ("new", "z"), ("u", "none"), ("v", "y")], "user string, item string")
    got = {(r.user, r.item): r for r in recommend.predict(asked, ratings, sims, recommend.Ladder(least_neighbours=1)).collect()}
    assert got["u", "z"].prediction == pytest.approx((0.8 * 4 + 0.4 * 2) / 1.2) and got["u", "z"].n == 2
    assert got["new", "z"].prediction == 3.75  # no such user
    assert got["u", "none"].prediction == 3.0  # no such item
    assert list(got["u", "z"].top) == [0.8, 0.4, -1, -1, -1]
    gated = recommend.predict(asked, ratings, sims, recommend.Ladder(least_neighbours=1, min_numerator=25.0)).where("user = 'u' AND item = 'z'").first()
    assert gated.prediction == 3.0
    few = recommend.predict(asked, ratings, sims, recommend.Ladder(fallback="item")).where("user = 'u' AND item = 'z'").first()
    assert few.prediction == 3.0


def test_error_report_counts_all(spark):
    scored = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.5), (1.0, 4.0), (0.0, 9.0)], "prediction double, stars double")
    r = recommend.error_report(scored).first()
    assert (r.from_0, r.from_1, r.from_2, r.from_3, r.from_4) == (1, 1, 1, 1, 1)


def test_bloom_window_equals_the_sequential_filter(spark):
    random.seed(4)
    xs = [random.randrange(40) for _ in range(200)]
    stream = spark.createDataFrame([(i, i // 50, x * 7919) for i, x in enumerate(xs)], "seq long, batch_id long, x long")
    got = {r.batch_id: (r.fp, r.unseen) for r in sketches.bloom_rates(stream, 3, 60).collect()}
    bits, seen, want = set(), set(), {}
    for i, x in enumerate(xs):
        at = {(a * x * 7919 + b) % similarity.PRIME % 60 for a, b in similarity.hash_parameters(3)}
        fp, unseen = want.get(i // 50, (0, 0))
        new = x not in seen
        want[i // 50] = (fp + (new and at <= bits), unseen + new)
        bits |= at
        seen.add(x)
    assert got == want


def test_out_of_core_clustering_separates_blobs(spark):
    draw = np.random.default_rng(5)
    centres = np.array([[0, 0], [30, 0], [0, 30]])
    rows = [(i, int(i % 3), i % 4, (centres[i % 3] + draw.normal(size=2)).tolist()) for i in range(600)] + [(999, 9, 1, [500.0, 500.0])]
    points = spark.createDataFrame(rows, "id long, label int, slice int, features array<double>")
    found, report = clustering.out_of_core(points, k=3, rounds=4)
    assert found.count() == 601 and found.select("id").distinct().count() == 601
    assert found.where("id = 999").first().cluster == -1
    assert clustering.purity(found.where("cluster >= 0"), points.select("id", "label")).first().purity > 0.98
    assert [r["round"] for r in report] == [1, 2, 3, 4]
    assert clustering.out_of_core(points.limit(0), k=3)[1] == []


def test_zero_variance_is_guarded(spark):
    points = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "a", [1.0, 2.0])], "id long, cluster string, features array<double>")
    stats = clustering.with_centres(clustering.summaries(points)).first()
    assert list(stats.centre) == [1.0, 2.0] and min(stats.std) > 0


def test_attribute_encoder(spark):
    rows = [(1, {"Wifi": "free", "Ambience": "{'casual': True, 'loud': False}"}), (2, {"Wifi": "no"}), (3, None)]
    table = spark.createDataFrame(rows, "business_id long, attributes map<string,string>")
    flat = features.flat_attributes(table, "business_id", "attributes")
    coded = {r.business_id: r for r in features.encode_attributes(flat, "business_id", features.ordinals(flat), ["Wifi", "Ambience.casual", "Ambience.loud"]).collect()}
    assert coded[1]["Wifi"] == 0 and coded[2]["Wifi"] == 1 and coded[2]["Ambience.casual"] is None and 3 not in coded
    assert features.flat_attributes(table, "business_id", "attributes", keep_nested_bool=False).count() == 2
    other = features.ordinals(flat.where("business_id = 2"))
    assert features.encode_attributes(flat, "business_id", other, ["Wifi"]).where("business_id = 1").first()["Wifi"] == -1


def test_dictionary_is_dense_and_ordered(spark):
    names = [f"n{i:04d}" for i in range(500)]
    random.shuffle(names)
    got = relational.dictionary(spark.createDataFrame([(n,) for n in names + names[:50] + [None]], "k string"), "k", partitions=7).collect()
    assert [r.k for r in sorted(got, key=lambda r: r["index"])] == sorted(names)
    assert sorted(r["index"] for r in got) == list(range(500))


def test_models_learn(spark):
    random.seed(6)
    rows = [(float(i % 10), None if i % 7 == 0 else float(i % 3), float(i % 10) * 2 + (i % 3 == 1)) for i in range(300)]
    table, columns = learning.with_missing_flags(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"])
    model = learning.boosted_regression(table, columns, "y", trees=5)
    report = recommend.error_report(model.transform(table).select("prediction", F.col("y").alias("stars"))).first()
    assert report.rmse < 2
    assert learning.eliminate_features(table, columns, "y", least=3, trees=2).count() == 2
    assert learning.grid_search(table, columns, "y", {"maxDepth": [1, 3]}, folds=2, trees=2).first().params == "maxDepth=3"


def test_alpha_hybrid_counts_strong_neighbours(spark):
    sims = [("a", f"s{i:02}", 0.95 if i < 8 else 0.85) for i in range(12)]
    ratings = [("u", f"s{i:02}", 4.0) for i in range(12)] + [("v", f"s{i:02}", 2.0) for i in range(7, 12)]
    asked = spark.createDataFrame([("u", "a"), ("v", "a"), ("w", "a")], "user string, item string")
    strong = recommend.strong_neighbours(asked, spark.createDataFrame(ratings, "user string, item string, stars double"), spark.createDataFrame(sims, "a string, b string, sim double"))
    assert {r.user: r.strong for r in strong.collect()} == {"u": 8, "v": 1}
    scored = asked.join(strong, ["user", "item"], "left").selectExpr("user", "strong", "4.0D AS item_prediction", "2.0D AS model_prediction")
    made = {r.user: r.prediction for r in recommend.alpha_hybrid(scored).collect()}
    assert made["v"] == made["w"] == 2.0 and abs(made["u"] - (2 + 2 * 3 / 13)) < 1e-12


def test_text_keys(spark):
    row = spark.createDataFrame([("Hello", "é!", "a1b22")], "a string, b string, c string").select(
        scalars.java_hash(F.col("a")), scalars.bytes_modulo(F.col("b"), 69997), scalars.digits_key(F.col("c")), scalars.list_text(F.array("a", "c"))
    ).first()
    assert tuple(row) == (69609650, int("é!".encode().hex(), 16) % 69997, 122, "'Hello', 'a1b22'")


def pair_rows():
    """Ratings with users and items of many kinds: repeated, null, alone, constant."""
    draw = random.Random(8)
    rows = [(f"u{u}", f"i{i:02}", draw.choice([1.0, 2.2, 3.1, 4.7, 5.0])) for u in range(40) for i in draw.sample(range(25), draw.randrange(1, 14))]
    rows += [(u, i, 2.2) for u in ("u1", "u2", "u3", "u4") for i in ("same", "i03", "i04")]
    return rows + [("u1", "i03", 5.0), ("u5", "i05", None), (None, "i05", 3.0), ("u6", None, 3.0), ("lone", "only", 4.0)]


def by_pair(rows):
    """(a, b) -> the users' ratings of both, in plain loops."""
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    out = {}
    for u, a, x in known:
        for v, b, y in known:
            if u == v and a < b:
                out.setdefault((a, b), []).append((x, y))
    return out


@pytest.mark.parametrize("size", [60, 16_000_000])
def test_pearson_by_blocks_equals_plain_loops(spark, monkeypatch, size):
    monkeypatch.setattr(copairs, "BLOCK", size)
    rows = pair_rows()
    table = spark.createDataFrame(rows, "user string, item string, stars double")
    stars = {}
    for u, i, s in rows:
        if u is not None and i is not None and s is not None:
            stars.setdefault(i, []).append(s)
    mean = {i: sum(v) / len(v) for i, v in stars.items()}
    got = {(r.a, r.b): (r.n, r.sim) for r in similarity.pearson(table).collect()}
    want = {}
    for (a, b), both in by_pair(rows).items():
        d = [(None if x is None else x - mean[a], None if y is None else y - mean[b]) for x, y in both]
        down = math.sqrt(sum(x * x for x, _ in d if x is not None)) * math.sqrt(sum(y * y for _, y in d if y is not None))
        up = sum(x * y for x, y in d if x is not None and y is not None)
        want[a, b] = (len(both), 0.0 if len(both) < 3 or down <= 0 else up / down)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


def test_correlation_of_a_constant_side_is_nan(spark):
    rows = pair_rows()
    got = {(r.a, r.b): (r.n, r.sim) for r in similarity.co_rated_correlation(spark.createDataFrame(rows, "user string, item string, stars double")).collect()}
    both = {k: v for k, v in by_pair(rows).items() if len(v) >= 3}
    assert got.keys() == both.keys() and math.isnan(got["i03", "same"][1])
    for k, pairs in both.items():
        x, y = np.array([p for p in pairs if None not in p]).T
        constant = len(set(x)) == 1 or len(set(y)) == 1
        assert got[k][0] == len(pairs) and (math.isnan(got[k][1]) if constant else got[k][1] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9))


@pytest.mark.parametrize("size", [60, 16_000_000])
@pytest.mark.parametrize("ladder", [recommend.Ladder(above=0.1, least_neighbours=2), recommend.Ladder(most_similar=False, top=3, least_neighbours=1, fallback="item")])
def test_predictions_by_blocks_equal_those_by_similarities(spark, monkeypatch, ladder, size):
    monkeypatch.setattr(copairs, "BLOCK", size)
    draw = random.Random(9)
    rows = [(u, i, s, draw.random() < 0.2) for u, i, s in pair_rows() if s is not None and u is not None and i is not None] + [("cold", "i01", 2.0, True), ("u2", "new", 3.0, True)]
    rows = list({r[:2]: r for r in rows}.values())
    rated = spark.createDataFrame(rows, "user string, item string, stars double, asked boolean")
    train, asked = rated.where("NOT asked"), rated.where("asked").select("user", "item")
    sims = similarity.pearson(train, rule="plain")
    want = {(r.user, r.item): r for r in recommend.predict(asked, train, sims, ladder).collect()}
    strong = {(r.user, r.item): r.strong for r in recommend.strong_neighbours(asked, train, sims).collect()}
    got = {(r.user, r.item): r for r in recommend.predict_rated(rated, ladder).collect()}
    assert got.keys() == want.keys() and strong
    for k, r in got.items():
        assert r.n == want[k].n and r.prediction == pytest.approx(want[k].prediction, abs=1e-9) and list(r.top) == pytest.approx(list(want[k].top), abs=1e-9)
        assert r.strong == strong.get(k, 0)
    assert recommend.predict_rated(rated.limit(0), ladder).count() == 0 and similarity.pearson(rated.limit(0)).count() == 0


@pytest.mark.parametrize("size", [300, 100_000_000])
def test_exact_pairs_by_blocks_equal_counts_of_shared_rows(spark, monkeypatch, size):
    monkeypatch.setattr(setpairs, "BLOCK", size)
    draw = random.Random(11)
    rows = {(i, m) for i in range(-20, 60) for m in draw.sample(range(30), draw.randrange(1, 12))} | {(i, 99) for i in (70, 71, 72)} | {(80, 1000)}
    sets = spark.createDataFrame(sorted(rows), "id long, member long")
    want = {(r.a, r.b): r.similarity for r in similarity.jaccard(similarity.overlap(sets), sets).collect()}
    for least in (0.0, 0.3, 0.5, 1.0):
        found = similarity.exact_pairs(sets, least)
        assert {(r.a, r.b): r.similarity for r in found.collect()} == {k: v for k, v in want.items() if v >= least} and (71, 72) in want
    assert "Join" not in found._jdf.queryExecution().toString()  # shared members are never joined into rows
    named = sets.select(F.format_string("n%03d", F.col("id") + 100).alias("id"), F.col("member").cast("string").alias("member"))
    got = {(r.a, r.b): r.similarity for r in similarity.exact_pairs(named, 0.3).collect()}
    assert got == {tuple(f"n{x + 100:03d}" for x in k): v for k, v in want.items() if v >= 0.3}
    assert similarity.exact_pairs(sets.limit(0), 0.3).count() == 0


def test_precision_and_recall_of_no_pairs(spark):
    none = spark.createDataFrame([], "a long, b long")
    row = similarity.precision_recall(none, none, ["a", "b"]).first()
    assert (row.n_found, row.n_true, row.n_hit, row.precision) == (0, 0, 0, 1.0) and math.isnan(row.recall)


def test_gradient_equals_differences():
    rng, layers = np.random.default_rng(0), [3, 5, 4, 2]
    w, x, y = rng.normal(size=20 + 24 + 10), rng.normal(size=(50, 3)), rng.integers(0, 2, 50)
    loss = lambda v: perceptron.Network(v, layers).loss_and_gradient(x, y)[0]
    slope = perceptron.Network(w, layers).loss_and_gradient(x, y)[1]
    assert slope == pytest.approx([(loss(w + e) - loss(w - e)) / 2e-6 for e in np.eye(len(w)) * 1e-6], abs=1e-6)


def test_network_equals_that_of_mllib(spark):
    """The first round goes the same way from the same weights; line searches differ in length, but after more rounds as much is learned."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 1280))  # ten of the blocks whose means MLlib averages
    rows = [(float(p), None if k % 9 == 0 else float(q), 5.0, int(abs(p) > 0.7)) for k, (p, q) in enumerate(zip(a, b, strict=True))]
    table, columns = learning.with_missing_flags(spark.createDataFrame(rows, "a double, b double, c double, y int").coalesce(1), ["a", "b", "c"])
    start = perceptron.first_weights(spark, [3, 8, 8, 2], 7)
    for rounds in (1, 30):
        model = learning.network(table, columns[:3], "y", (8, 8), rounds)
        ready = model.transform(table).drop("prediction", "probability", "rawPrediction").cache()
        other = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="y", layers=[3, 8, 8, 2], maxIter=rounds, seed=7).fit(ready)
        if rounds == 1:
            own, its = (m.weights.toArray() - start for m in (model.stages[-1], other))
            assert own @ its == pytest.approx(np.linalg.norm(own) * np.linalg.norm(its), rel=1e-4)
        got, want = (learning.accuracy(m.transform(t), "y").first().accuracy for m, t in ((model, table), (other, ready)))
        assert rounds == 1 or got == pytest.approx(want, abs=0.05) and got > 0.9
        assert learning.accuracy(learning.classified(model, table, columns[:3], "y"), "y").first().accuracy == pytest.approx(got, abs=0.002)
    with pytest.raises(ValueError, match="no rows"):
        learning.perceptron.fit(table.limit(0), columns[:3], "y", learning._scale(model, columns[:3]), [3, 8, 2], 1, 7)
