"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from orequarry.operators import perceptron
from orequarry.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(frame):
    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return str(v)

    names = sorted(frame.columns)
    return names, sorted(tuple(one(v) for v in row) for row in frame[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert canonical(got) == canonical(duck.execute(registry.ORACLE_SQL[name]).df())


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_filters_and_columns_reach_the_scan(spark):
    plan = formatted(registry.QUERIES["pushed_filter"](spark, SF))
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan
    scan = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "l_tax" not in scan and "l_partkey" not in scan


def test_top_k_is_a_bounded_heap(spark):
    plan = registry.QUERIES["topk_customers"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


#: Queries on pairs of items that users rated together.
PAIRED = ["cf_features_rating", "alpha_hybrid", "cf_least_similar", "blend_sweep", "cf_padded", "cf_top_three", "item_pearson_plain", "blend_sweep_wide", "cf_amplified_item_mean", "cf_strict", "cf_top_two", "error_report", "item_pearson_amplified", "item_pearson_strict", "blend_fixed", "cf_least_similar_gated", "switching_hybrid"]


@pytest.mark.parametrize("name", PAIRED)
def test_pairs_of_ratings_are_never_rows(spark, monkeypatch, name):
    """Ratings go to blocks of items as one row for each user; no plan joins them with themselves."""
    from orequarry.operators import scratch

    plans, write = [], scratch.written
    keep = lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df)
    monkeypatch.setattr("orequarry.operators.copairs.written", keep)
    cut = scratch.cut_lineage
    for module in ("plans.mining", "plans.structures"):
        monkeypatch.setattr(f"orequarry.{module}.cut_lineage", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    plans.append(registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString())
    joins = sum(plan.split("== Physical Plan ==")[-1].count("Join") for plan in plans)
    assert joins == 1  # of line items and orders


@pytest.mark.parametrize("name", ["cf_least_similar", "cf_least_similar_gated", "cf_padded", "cf_strict", "item_pearson_plain"])
def test_pairs_of_ratings_with_null_keys_and_nan_equal_sql(spark, tmp_path, name):
    """Ratings without a user count in the means of items, those without an item in the means of users; both are predicted; NaN isn't null."""
    con = duckdb.connect()
    changes = {"lineitem": ("l_suppkey = CASE WHEN i % 50 = 0 THEN NULL ELSE l_suppkey END", "l_quantity = CASE WHEN i % 500 = 0 THEN 'nan'::DOUBLE WHEN i % 7 = 0 OR l_orderkey % 40 = 0 THEN NULL ELSE l_quantity END"), "orders": ("o_custkey = CASE WHEN i % 9 = 0 THEN NULL ELSE o_custkey END",)}
    for t, columns in changes.items():
        replaced = ", ".join(f"{after} AS {c}" for c, after in (x.split(" = ", 1) for x in columns))
        con.execute(f"COPY (SELECT * REPLACE ({replaced}) FROM (SELECT *, row_number() OVER () AS i FROM '{SF}/{t}.parquet')) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    rows = lambda found: sorted([tuple(repr(v) for v in row) for row in found])
    want = rows(con.execute(registry.ORACLE_SQL[name]).fetchall())
    assert any("None" in row for row in want) == name.startswith("cf")
    assert rows(registry.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_lsh_recall_joins_no_sets_to_candidates(spark, monkeypatch):
    """The exact test looks candidates up; rows with both sets filled the disk."""
    from orequarry.plans import mining

    plans, write = [], mining.written
    monkeypatch.setattr(mining, "written", lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df))
    plans.append(registry.QUERIES["lsh_recall"](spark, SF)._jdf.queryExecution().toString())
    assert len(plans) == 4 and not any("array_intersect" in plan for plan in plans)


def test_a_users_mean_is_the_same_number_on_both_sides(spark):
    """Where the item-based prediction falls back to the user's mean, both errors are equal to the last bit, so neither model wins."""
    from orequarry.plans import mining

    scored = mining._scored(spark, SF)
    assert "Join" not in scored._jdf.queryExecution().toString()  # two sums of the same stars differ in their order
    fallback = scored.where("n < 5").collect()
    assert fallback and all(r.item_prediction == r.model_prediction for r in fallback)


def test_network_reads_narrow_rows(spark, monkeypatch):
    """One row a user and blocks of numbers are written, never the wide table or the features of MLlib; the rows are those of the other models."""
    from orequarry.plans import structures

    wide = structures._train_test(spark, SF)
    narrow = structures._narrow_train_test(spark, SF)
    rounded = lambda df, columns: canonical(df.select("user", "item", "stars", "fold", *columns).toPandas())
    assert wide[2] == narrow[2] and all(rounded(a, wide[2]) == rounded(b, wide[2]) for a, b in zip(wide[:2], narrow[:2], strict=True))
    monkeypatch.setattr(structures, "cut_lineage", lambda df: pytest.fail("a checkpoint of the whole table"))
    plan = registry.QUERIES["network_classifier"](spark, SF)
    assert 0 <= plan.first().accuracy <= 1 and "MapInArrow" in plan._jdf.queryExecution().toString()


def test_network_learns_for_all_rounds(spark, monkeypatch):
    """As many rounds as the reference has epochs."""
    asked, search = [], perceptron.lbfgs
    monkeypatch.setattr(perceptron, "lbfgs", lambda f, x, rounds: asked.append((len(x), rounds)) or search(f, x, 1))
    assert 0 <= registry.QUERIES["network_classifier"](spark, SF).first().accuracy <= 1
    assert asked == [(7 * 128 + 129 * 128 + 129 * 2, 100)]
