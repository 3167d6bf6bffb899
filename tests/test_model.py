import pytest
from pyspark.sql import functions as F

from staylens.plans import model as M
from staylens.plans import reports as R
from staylens.sources import standins

from .conftest import SF_SMALL


def test_split_rows_layout_invariant(spark):
    ids = spark.range(0, 1000).select(F.col("id"))
    a = {r["id"]: r["fold"] for r in M.split_rows(ids, "id").collect()}
    b = {r["id"]: r["fold"] for r in M.split_rows(ids.repartition(7), "id").collect()}
    c = {r["id"]: r["fold"] for r in M.split_rows(ids.repartition(3, "id").orderBy(F.rand(1)), "id").collect()}
    assert a == b == c
    share = sum(1 for v in a.values() if v == "test") / len(a)
    assert 0.25 < share < 0.35
    other = {r["id"]: r["fold"] for r in M.split_rows(ids, "id", seed=7).collect()}
    assert other != a


def test_r2_score_matches_hand_computation(spark):
    data = [("a", 3.0, 2.5), ("a", -0.5, 0.0), ("a", 2.0, 2.0), ("a", 7.0, 8.0),
            ("b", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0)]
    df = spark.createDataFrame(data, "g string, y double, p double")
    got = {r["g"]: r["r2"] for r in M.r2_score(df, "y", "p", by=["g"]).collect()}
    ys, ps = [3.0, -0.5, 2.0, 7.0], [2.5, 0.0, 2.0, 8.0]
    mean = sum(ys) / len(ys)
    want = 1 - sum((y - p) ** 2 for y, p in zip(ys, ps)) / sum((y - mean) ** 2 for y in ys)
    assert got["a"] == pytest.approx(want, abs=1e-12)
    assert got["b"] == 1.0 and got["c"] == 0.0  # constant label: perfect -> 1, else 0
    overall = M.r2_score(df.where("g = 'a'"), "y", "p").first()[0]
    assert overall == pytest.approx(want, abs=1e-12)


@pytest.fixture()
def toy(spark):
    # price is set by x alone; z is noise
    df = spark.range(0, 600).select(
        F.col("id"),
        (F.col("id") % 5).cast("double").alias("x"),
        ((F.col("id") * 7919) % 13).cast("double").alias("z"),
    ).withColumn("price", F.col("x") * 100 + 50)
    return M.assemble(df, ["x", "z"])


def test_forest_classifier_on_price_classes(spark, toy):
    forest = M.fit_forest(toy, "features", "price", trees=20, depth=4, seed=42)
    imp = forest.model.featureImportances.toArray()
    assert imp.sum() == pytest.approx(1.0)
    assert imp[0] > imp[1]
    pred = forest.predict(toy)
    labels = {r["value"] for r in forest.labels.collect()}
    assert labels == {50.0, 150.0, 250.0, 350.0, 450.0}
    assert {r["predicted"] for r in pred.select("predicted").distinct().collect()} <= labels
    assert M.r2_score(pred, "price", "predicted").first()[0] > 0.99
    table = M.importance_table(forest, ["x", "z"], spark)
    assert [r["feature"] for r in table.collect()] == ["x", "z"]
    assert M.top_importance(table, 1).first()["feature"] == "x"


def test_forest_regressor(spark, toy):
    reg = M.fit_forest(toy, "features", "price", trees=10, depth=4, task="regress")
    assert M.r2_score(reg.predict(toy), "price", "predicted").first()[0] > 0.95


def test_price_drivers_on_standin(spark):
    res = R.price_drivers(standins.listings(spark, SF_SMALL), trees=20)
    imp = res.importance.collect()
    features = [r["feature"] for r in res.features.collect()]
    assert len(imp) == len(features)
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)
    folds = {r["fold"] for r in res.scores.collect()}
    assert folds == {"train", "test"}
    assert "id" not in features and "price" not in features
    # sparse square_feet (90% missing) is dropped, text columns are encoded
    assert "square_feet" not in features
    assert any(f.startswith("amenities-") for f in features)
    assert any(f.startswith("room_type_") for f in features)


def test_many_price_classes_and_unseen_test_price(spark):
    # 150 distinct prices; a price that only occurs among test rows must not fail
    df = spark.range(0, 1500).select(
        F.col("id"), (F.col("id") % 150).cast("double").alias("x"),
        ((F.col("id") % 150) * 10 + 40).cast("double").alias("price"))
    df = M.split_rows(df, "id")
    test_only = df.where("fold = 'test'").select(F.col("id") + 100_000, F.lit(999.0), F.lit(99_999.0),
                                                F.lit("test")).toDF("id", "x", "price", "fold")
    data = M.assemble(df.unionByName(test_only), ["x"])
    forest = M.fit_forest(data.where("fold = 'train'"), "features", "price", trees=10, depth=6)
    labels = {r["value"] for r in forest.labels.collect()}
    assert len(labels) == 150 and 99_999.0 not in labels
    pred = forest.predict(data)
    scores = {r["fold"]: r["r2"] for r in M.r2_score(pred, "price", "predicted", by=["fold"]).collect()}
    assert set(scores) == {"train", "test"}
    assert {r[0] for r in pred.select("predicted").distinct().collect()} <= labels


def test_empty_input_through_split_and_score(spark):
    df = spark.createDataFrame([], "id long, y double, p double")
    assert M.split_rows(df, "id").count() == 0
    assert M.r2_score(df, "y", "p", by=["id"]).count() == 0


def test_price_drivers_regression_forest(spark):
    res = R.price_drivers(standins.listings(spark, SF_SMALL), trees=5, task="regress")
    assert {r["fold"] for r in res.scores.collect()} == {"train", "test"}
    assert abs(sum(r["importance"] for r in res.importance.collect()) - 1.0) < 1e-9
    assert res.forest.labels is None


def test_wide_drivers_and_unparsable_prices(spark):
    """1,500 prices and 3,000 phrases: no class or vocabulary limit."""
    df = spark.range(0, 3000).selectExpr(
        "id", "CASE WHEN id % 100 = 0 THEN 'ask' ELSE concat('$', id % 1500, '.50') END AS price",
        "concat('{p', id, '}') AS amenities", "CAST(id % 9 AS DOUBLE) AS bedrooms")
    res = R.price_drivers(df, trees=2, depth=3)
    assert res.features.count() > 2900 and res.forest.labels.count() > 1000 and res.unparsable == 30
    assert res.predictions.count() == 2970


def test_importances_equal_the_nodes_and_mllib(spark, scratch):
    """Importances against MLlib's vector and a plain computation over the saved nodes."""
    res = R.price_drivers(standins.listings(spark, SF_SMALL), trees=7, depth=4)
    names = {r["index"]: r["feature"] for r in res.features.collect()}
    got = {r["feature"]: r["importance"] for r in res.importance.collect()}
    vector = res.forest.model.featureImportances.toArray()
    assert set(names) == set(range(len(vector)))
    assert all(abs(got[names[i]] - v) < 1e-12 for i, v in enumerate(vector))
    path = f"{scratch}/forest"
    res.forest.model.save(path)
    trees = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        n = r["nodeData"]
        if n["leftChild"] >= 0:
            of = trees.setdefault(r["treeID"], {})
            at = n["split"]["featureIndex"]
            of[at] = of.get(at, 0.0) + n["gain"] * sum(n["impurityStats"])
    want = {}
    for of in trees.values():
        for at, gain in of.items():
            want[at] = want.get(at, 0.0) + gain / sum(of.values())
    total = sum(want.values())
    assert all(abs(got[f] - want.get(i, 0.0) / total) < 1e-12 for i, f in names.items())
    nodes = M.node_table(res.forest)
    leaves = {(r["tree"], r["leaf"]): r["rows"] for r in nodes.where("leaf is not null").collect()}
    by_leaf = res.forest.model.copy().setLeafCol("leaf").transform(res.vectors.where("fold = 'train'"))
    assert all((t, int(x)) in leaves for r in by_leaf.select("leaf").collect() for t, x in enumerate(r["leaf"]))


def test_predictions_are_stored_in_parallel(spark):
    res = R.price_drivers(standins.listings(spark, SF_SMALL), trees=3, depth=3)
    again = res.forest.predict(res.vectors).select("id", "predicted").collect()
    stored = res.predictions.select("id", "predicted").collect()
    assert sorted(again) == sorted(stored)
    assert "RandomForest" not in res.scores._jdf.queryExecution().toString()  # read, not voted again
    assert res.vectors.rdd.getNumPartitions() > 1 or len(res.vectors.inputFiles()) > 1


def test_node_importances_of_trees_without_splits(spark):
    df = M.assemble(spark.range(40).selectExpr("id", "1.0 AS x", "CAST(id % 3 AS DOUBLE) AS price"), ["x"])
    forest = M.fit_forest(df, "features", "price", trees=3, depth=2)
    assert [tuple(r) for r in M.importance_table(forest, ["x"], spark).collect()] == [("x", 0.0)]


def test_forest_depends_on_the_data_alone(spark):
    """Equal importances whatever the input's partitions and the session's parallelism."""
    listings = standins.listings(spark, SF_SMALL)
    seen = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, shuffle in ((1, "8"), (13, "3")):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            res = R.price_drivers(listings.repartition(n), trees=5, rows_per_partition=50)
            seen.append([(r["feature"], round(r["importance"], 12)) for r in res.importance.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1]


def test_key_with_a_dot(spark):
    df = spark.createDataFrame([(1,)], "`a.b` long")
    assert M.split_rows(df, "a.b").first()["fold"] in ("train", "test")
