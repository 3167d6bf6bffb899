"""Forests whose class counts the driver cannot hold at once are fitted and voted in groups."""

import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from staylens.plans import model as M


@pytest.fixture()
def data(spark):
    df = spark.range(0, 700).selectExpr(
        "id", "CAST(id % 11 AS DOUBLE) AS x", "CAST((id * 7919) % 13 AS DOUBLE) AS z",
        "CAST((id % 11) * 10 + id % 3 AS DOUBLE) AS price").repartition(3)
    return M.assemble(df, ["x", "z"])


def test_sizes_follow_the_class_counts():
    assert M.tree_groups(400, 6, 8, 64) == [400]
    sizes = M.tree_groups(400, 6, 1000, 64)  # 1.5 MB a tree
    assert len(sizes) > 1 and sum(sizes) == 400 and max(sizes) * 3 * 64 * 8 * 1000 <= 64 << 20
    assert M.tree_groups(3, 6, 10**6, 64) == [1, 1, 1]


def test_grouped_forest_votes_as_mllib(spark, data, monkeypatch):
    """Seven trees in three groups, 33 classes voted in blocks, against the sum of MLlib's raw votes."""
    monkeypatch.setattr(M, "VOTES_MB", 0)  # a class a block
    monkeypatch.setattr(M, "VOTING_ROWS", 300)
    forest = M.fit_forest(data, "features", "price", trees=7, depth=4, key="id", forest_mb=3 * 16 * 33 * 8 * 3 / (1 << 20))
    assert forest.model.sizes == [3, 2, 2] and forest.labels.count() == 33
    models = [RandomForestClassificationModel.load(p) for p in (f"{forest.model.path}/group={g}" for g in range(3))]
    assert sum(m.getNumTrees for m in models) == 7
    assert len({t.toDebugString.split("\n", 1)[1] for m in models for t in m.trees}) == 7  # no tree twice
    rows = data.select("id", "features").collect()
    labels = [r["value"] for r in forest.labels.orderBy("index").collect()]
    want = {r["id"]: labels[int(sum(m.predictRaw(r["features"]).toArray() for m in models).argmax())] for r in rows}
    got = {r["id"]: r["predicted"] for r in forest.predict(data).select("id", "predicted").collect()}
    assert got == want
    nodes = M.node_table(forest)
    assert sorted(r[0] for r in nodes.select("tree").distinct().collect()) == list(range(7))
    table = {r["feature"]: r["importance"] for r in M.importance_table(forest, ["x", "z"], spark).collect()}
    each = sum(m.featureImportances.toArray() * m.getNumTrees for m in models) / 7
    assert table["x"] == pytest.approx(each[0], abs=1e-9) and table["z"] == pytest.approx(each[1], abs=1e-9)


def test_one_group_is_the_plain_fit(spark, data):
    a = M.fit_forest(data, "features", "price", trees=4, depth=3, key="id")
    assert a.model.getNumTrees == 4 and a.predict(data).where(F.col("predicted").isNull()).count() == 0


def test_partitions_of_a_large_fit(spark):
    """Statistics are sent by each partition: twelve of them until each has 100,000 rows."""
    df = spark.range(10)
    n = [M.laid_out(df, "id", rows).rdd.getNumPartitions() for rows in (0, 14_000, 840_000, 2_000_000)]
    assert n == [1, 7, 12, 20]
