"""Grouped forests vote over streamed rows: neither leaves nor votes by class are stored or dealt out."""

import re

import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.plans import model as M

GROUPS = 3 * 16 * 33 * 8 * 3 / (1 << 20)  # three trees of depth 4 and 33 classes


def _forest(spark, data, **kw):
    return M.fit_forest(data, "features", "price", trees=7, depth=4, key="id", forest_mb=GROUPS, **kw)


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(0, 700).selectExpr(
        "id", "CAST(id % 11 AS DOUBLE) AS x", "CAST((id * 7919) % 13 AS DOUBLE) AS z",
        "CAST((id % 11) * 10 + id % 3 AS DOUBLE) AS price").repartition(3)


def _by_mllib(forest, rows):
    models = [RandomForestClassificationModel.load(f"{forest.model.path}/group={g}") for g in range(len(forest.model.sizes))]
    labels = [r["value"] for r in forest.labels.orderBy("index").collect()]
    return {r["id"]: labels[int(sum(m.predictRaw(r["features"]).toArray() for m in models).argmax())] for r in rows}


def test_leaves_are_neither_stored_nor_dealt_out(spark, numbers, monkeypatch):
    """Executors held 100,000 rows' leaves of all trees, once for each block of classes (the disk too)."""
    forest, written, plans = _forest(spark, M.assemble(numbers, ["x", "z"])), [], []
    monkeypatch.setattr(M, "VOTES_MB", 0)  # a class a block
    store, path, votes = M.cut_lineage, M.scratch_path, M.class_votes
    monkeypatch.setattr(M, "cut_lineage", lambda df, name: plans.append(str(df._jdf.queryExecution())) or store(df, name))
    monkeypatch.setattr(M, "scratch_path", lambda s, name: written.append(name) or path(s, name))

    def kept(*a):
        out = votes(*a)
        plans.append(str(out._jdf.queryExecution()))
        return out

    monkeypatch.setattr(M, "class_votes", kept)
    assert forest.predict(M.assemble(numbers, ["x", "z"])).where("predicted is not null").count() == 700
    assert len(forest.model.sizes) == 3 and "leaves" not in written
    assert not any(re.search("(?i)cogroup|explode", p) for p in plans)


def test_vectors_are_dealt_out_once(spark, numbers, monkeypatch):
    """Disk: the voting dealt out every leaf of a row for each block of classes, 33 times here."""
    forest, plans, store = _forest(spark, M.assemble(numbers, ["x", "z"])), {}, M.cut_lineage
    monkeypatch.setattr(M, "VOTES_MB", 0)
    monkeypatch.setattr(M, "VOTING_ROWS", 300)
    monkeypatch.setattr(M, "cut_lineage", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or store(df, name))
    votes = M.class_votes(forest.model, M.assemble(numbers, ["x", "z"]).withColumnRenamed("id", "__row"))
    assert votes.count() == votes.select("__row").distinct().count() == 700
    dealt = [line for line in plans["votes"].splitlines() if "Exchange" in line and "__row" in line]
    assert len(dealt) == 1 and "Explode" not in plans["votes"] and "generate" not in plans["votes"].lower()


def test_a_voting_task_holds_few_rows(spark, numbers, monkeypatch):
    """A task votes on VOTING_ROWS rows at once, however many it reads."""
    forest = _forest(spark, M.assemble(numbers, ["x", "z"]))
    rows = M.assemble(numbers, ["x", "z"]).withColumnRenamed("id", "__row")
    batches = rows.select("__row", F.col("features").alias("__vector")).coalesce(1).toArrow().combine_chunks().to_batches() * 3

    class Block:
        def __init__(self, value):
            self.value = value

    trees = M._tree_arrays(forest.model.nodes)
    blocks = [Block(b) for b in M._class_blocks(forest.model, 7, int(trees["leaf"].max()) + 1)]
    small = [b.num_rows for b in M._voter(trees, blocks, 2, 500)(x.slice(a, 100) for x in batches for a in range(0, 700, 100))]
    assert small == [500, 500, 500, 500, 100]


def test_votes_of_sparse_dense_and_nominal_features(spark, numbers):
    """MLlib's own votes, for vectors of both kinds, a categorical split, and values the fit has not seen."""
    rows = [(r["id"], Vectors.sparse(2, [(i, v) for i, v in enumerate((r["x"], r["z"])) if v]) if r["id"] % 2
             else Vectors.dense([r["x"], r["z"]]), r["price"]) for r in numbers.collect()]
    meta = {"ml_attr": {"attrs": {"nominal": [{"idx": 0, "name": "x", "vals": [str(i) for i in range(11)]}],
                                  "numeric": [{"idx": 1, "name": "z"}]}, "num_attrs": 2}}
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT(), metadata=meta),
                           T.StructField("price", T.DoubleType())])
    data = spark.createDataFrame(rows, schema)
    forest = _forest(spark, data)
    assert forest.model.sizes == [3, 2, 2]
    assert forest.model.nodes.where("categories is not null").count() > 0 and forest.model.nodes.where("threshold > 0 and categories is null").count() > 0
    want = _by_mllib(forest, data.select("id", "features").collect())
    assert {r["id"]: r["predicted"] for r in forest.predict(data).select("id", "predicted").collect()} == want
    odd = spark.createDataFrame([(1, Vectors.dense([3.0, float("nan")]), 0.0), (2, Vectors.dense([10.0, -5.0]), 0.0),
                                 (3, Vectors.sparse(2, [], []), 0.0)], schema)
    want = _by_mllib(forest, odd.select("id", "features").collect())
    assert {r["id"]: r["predicted"] for r in forest.predict(odd).select("id", "predicted").collect()} == want
    assert forest.predict(odd.limit(0)).count() == 0


def test_node_table_has_its_columns(spark, numbers):
    forest = _forest(spark, M.assemble(numbers, ["x", "z"]))
    assert M.node_table(forest).columns == ["tree", "node", "feature", "threshold", "gain", "rows", "leaf"]
