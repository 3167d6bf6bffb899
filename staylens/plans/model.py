"""Model operators (M1-M7) and the R2 score.

The forest runs on MLlib, so the fit is distributed (per-node statistics are
aggregated across partitions); the driver holds the trees and the label list,
as the model itself does. Before the fit the feature table is written to the
checkpoint folder, so the many passes of the fit neither recompute the
encoding nor depend on executors that may be lost. The rows' layout depends
on the data alone (a hash of the key, partitions by row count), so the same
data gives the same forest on any cluster.

MLlib keeps class counts in every node, so a forest of many trees and classes outgrows the
driver. Such a forest is fitted in groups of trees, each saved before the next begins; its
nodes are a table, and its trees vote in tasks over blocks of classes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._util import as_list, qcol, require_columns
from ..operators.dictionary import dense_index
from ..operators.groups import top_k
from ..session import cut_lineage, scratch_path


# --------------------------------------------------------------------------- M1, M2

def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    """M1: numeric feature columns to one vector column (missing values must be imputed)."""
    features = as_list(features)
    require_columns(df, features)
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


def split_hash(key, seed: int) -> Column:
    """Unsigned 32-bit hash of ``'<seed>:<key>'`` (first 8 hex digits of its MD5)."""
    text = F.concat(F.lit(f"{seed}:"), (qcol(key) if isinstance(key, str) else key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def split_rows(df: DataFrame, key: str, test: float = 0.3, seed: int = 42,
               name: str = "fold") -> DataFrame:
    """M2: add ``fold`` = 'test' for a ``test`` share of the keys, else 'train'.

    The fold depends only on the key and the seed, so it is the same under any
    partitioning, on any engine, and for every row of a key.
    """
    cut = int(round(test * 10_000))
    return df.withColumn(
        name, F.when(split_hash(key, seed) % 10_000 < cut, F.lit("test")).otherwise(F.lit("train")))


# --------------------------------------------------------------------------- A12, M5

def r2_score(df: DataFrame, label: str, prediction: str, by=None, name: str = "r2") -> DataFrame:
    """``1 - SSE / SST`` per group of ``by`` (or overall), in one aggregation.

    SST is ``var_pop * n`` (a numerically stable merge of partial moments), so
    no group mean has to be joined back. A constant label scores 1 for a perfect
    prediction and 0 otherwise.
    """
    y, p = qcol(label).cast("double"), qcol(prediction).cast("double")
    rows = df.where(y.isNotNull() & p.isNotNull())
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * F.count(F.lit(1))
    score = F.when(sst > 0, F.lit(1.0) - sse / sst).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    keys = [qcol(k) for k in as_list(by)]
    return (rows.groupBy(*keys) if keys else rows.groupBy()).agg(score.alias(name))


# --------------------------------------------------------------------------- M3, M4

@dataclass
class SavedTrees:
    """A forest whose trees were fitted and saved in groups."""

    path: str                 # a saved MLlib model for each group, under group=<number>
    sizes: list               # its trees
    nodes: DataFrame          # the nodes of all trees; see :func:`node_table`
    classes: int
    features: str             # the vector column
    numFeatures: int


@dataclass
class PriceForest:
    model: object             # MLlib's model, or SavedTrees
    task: str
    labels: DataFrame | None  # (index, value) of the classes (classification)

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """M4: predicted label value per row (class index joined with its value).

        Only the prediction column is produced: the per-class vote and probability vectors
        (one value per class) are not columns of the table.
        """
        if isinstance(self.model, SavedTrees):
            return self._predict_saved(df, out)
        model = self.model.copy()
        if self.task != "classify":
            return model.transform(df).withColumn(out, F.col("prediction")).drop("prediction")
        model.setRawPredictionCol("").setProbabilityCol("").setPredictionCol("__class")
        values = self.labels.select(F.col("index").cast("double").alias("__class"), F.col("value").alias(out))
        return model.transform(df).join(values, "__class", "left").drop("__class")

    def _predict_saved(self, df: DataFrame, out: str) -> DataFrame:
        rows = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
        votes = class_votes(self.model, rows.select("__row", qcol(self.model.features)))
        values = self.labels.select(F.col("index").alias("__class"), F.col("value").alias(out))
        return rows.join(votes.select("__row", "__class"), "__row", "left").join(
            values, "__class", "left").drop("__row", "__class")


def label_values(train: DataFrame, label: str) -> DataFrame:
    """(index, value): the distinct labels in order, numbered as a table."""
    values = train.select(qcol(label).cast("double").alias("value")).where(F.col("value").isNotNull()).distinct()
    return dense_index(values, ["value"])


#: Rows of a partition of the fit, and its per-task budget for split statistics. Both are
#: part of the model's definition: they change the forest, so neither follows the machine.
ROWS_PER_PARTITION = 2_000
STATISTICS_MB = 256
#: Every partition sends its statistics of every node, whatever its rows: beyond 12 partitions
#: their rows grow first, 50-fold. Also part of the definition.
FEW_PARTITIONS, MORE_ROWS = 12, 50
#: Class counts of the trees that the driver holds at once (a larger forest is fitted in groups),
#: and of the leaves that a voting task holds; rows that a voting task reads and votes on at once.
FOREST_MB, VOTES_MB, VOTING_ROWS = 16, 64, 10_000


def laid_out(df: DataFrame, key: str, rows: int | None = None,
             rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Hash-partitioned by ``key`` and sorted; as many partitions as the row count asks for."""
    rows = df.count() if rows is None else rows
    partitions = min(-(-rows // rows_per_partition),
                     max(FEW_PARTITIONS, -(-rows // (MORE_ROWS * rows_per_partition))))
    return df.repartition(max(1, partitions), qcol(key)).sortWithinPartitions(qcol(key))


def tree_groups(trees: int, depth: int, classes: int, memory_mb: float, rows: int | None = None) -> list[int]:
    """Sizes of the groups in which ``trees`` are fitted, so that a group's class counts (those
    of a node, and of both sides of an inner node) stay below ``memory_mb``."""
    leaves = 1 << depth if rows is None else min(1 << depth, max(1, rows))
    each = max(1, 3 * leaves * classes * 8)
    groups = -(-trees // max(1, int(memory_mb * (1 << 20)) // each))
    return [trees // groups + (g < trees % groups) for g in range(groups)]


def _group_seed(seed: int, group: int) -> int:
    # far apart: MLlib adds the partition's number to the seed
    return seed if group == 0 else int(hashlib.md5(f"{seed}:{group}".encode()).hexdigest()[:15], 16)


def _fit_groups(est, data: DataFrame, sizes: list[int], classes: int) -> SavedTrees:
    path, seed = scratch_path(data.sparkSession, "forest"), est.getSeed()
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    for g, size in enumerate(sizes):
        # 'auto' means all features in a group of one tree; a forest takes the square root
        model = est.copy().setNumTrees(size).setSeed(_group_seed(seed, g)).setFeatureSubsetStrategy("sqrt").fit(data)
        model.save(f"{path}/group={g}")
        width = model.numFeatures
    data.unpersist()
    first = F.element_at(F.array(*[F.lit(sum(sizes[:g])) for g in range(len(sizes))]), F.col("group") + 1)
    saved = data.sparkSession.read.option("basePath", path).parquet(f"{path}/group=*/data")
    nodes = cut_lineage(_nodes(saved.withColumn("treeID", F.col("treeID") + first), True), "nodes")
    return SavedTrees(path, sizes, nodes, classes, est.getFeaturesCol(), width)


def _tree_arrays(nodes: DataFrame) -> dict:
    """The trees without class counts, as flat arrays over (tree, node): a leaf is its own child."""
    t = nodes.select("tree", "node", "feature", "threshold", "categories", "values", "left", "right", "leaf").toArrow()
    tree, node = t["tree"].to_numpy(), t["node"].to_numpy()
    trees, size = int(tree.max()) + 1, int(node.max()) + 1
    at = tree.astype(np.int64) * size + node

    def flat(name: str, none, kind, base=0):
        out = np.full(trees * size, none, kind)
        out[at] = t[name].combine_chunks().fill_null(none).to_numpy(zero_copy_only=False) + base
        return out

    feature, leaf = flat("feature", -1, np.int64), flat("leaf", -1, np.int64)
    left, right = (flat(c, -1, np.int64, tree.astype(np.int64) * size) for c in ("left", "right"))
    inner, own = feature >= 0, np.arange(trees * size)
    left, right = np.where(inner, left, own), np.where(inner, right, own)
    depth = np.zeros(trees * size, np.int64)
    for n in range(size):  # in a tree, a node comes before its children
        mine = np.arange(trees) * size + n
        mine = mine[inner[mine]]
        depth[left[mine]] = depth[right[mine]] = depth[mine] + 1
    used, slot = np.unique(feature[inner], return_inverse=True)
    feature[inner] = slot
    # a categorical split: its row of the table says which values go left; the last column is for all others
    kinds, widest = np.full(trees * size, -1), max(t["values"].fill_null(0).to_pylist(), default=0)
    table = []
    for i, values, cats in zip(at.tolist(), t["values"].to_pylist(), t["categories"].to_pylist()):
        if cats is not None:
            kinds[i], rest = len(table), len(cats) > values / 2
            table.append([v in cats if v < values else rest for v in range(widest)] + [rest])
    return {"root": np.arange(trees) * size, "slot": np.where(inner, feature, 0), "threshold": flat("threshold", 0.0, np.float64),
            "left": left, "right": right, "leaf": leaf.astype(np.min_scalar_type(int(leaf.max()))), "used": used,
            "levels": int(depth.max()), "kinds": kinds, "table": np.array(table, bool)}


def _class_blocks(forest: SavedTrees, trees: int, leaves: int):
    """(first class, leaves of each tree, rows of a leaf, class counts of a leaf) of one block of classes
    after the other, at most VOTES_MB as doubles; leaves in the order of trees."""
    spark, path = forest.nodes.sparkSession, scratch_path(forest.nodes.sparkSession, "blocks")
    block = min(forest.classes, max(1, (VOTES_MB << 20) // (trees * leaves * 8)))
    blocks = -(-forest.classes // block)
    forest.nodes.where("leaf is not null").select(
        "tree", "leaf", "rows", "counts", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select(
        "tree", "leaf", "rows", F.slice("counts", F.col("block") * block + 1, F.lit(block)).alias("counts"), "block",
    ).write.partitionBy("block").parquet(path)

    def read(b: int) -> tuple:
        t = spark.read.parquet(f"{path}/block={b}").toArrow()
        tree, order = t["tree"].to_numpy(), np.lexsort((t["leaf"].to_numpy(), t["tree"].to_numpy()))
        counts = [c.flatten().to_numpy().reshape(len(c), -1) for c in t["counts"].chunks if len(c)]
        small = np.min_scalar_type(int(max(c.max() for c in counts)))  # rows are counted: small integers
        if not all(np.array_equal(c.astype(small), c) for c in counts):
            small = np.float64
        counts = np.concatenate([c.astype(small) for c in counts])[order]
        return b * block, np.bincount(tree, minlength=trees), t["rows"].to_numpy()[order], counts

    return (read(b) for b in range(blocks))


def _voter(trees: dict, blocks: list, width: int, most_rows: int):
    """(__row, __class, __votes) of (__row, __vector) rows: a tree gives each class its share of the
    row's leaf; trees are added in order, of equal classes the first wins (as in MLlib)."""
    slots = np.full(width, -1, np.int64)
    slots[trees["used"]] = np.arange(len(trees["used"]))

    def dense(vectors: pa.StructArray) -> np.ndarray:
        # type 0: indices and values; type 1: all values
        if vectors.null_count:
            raise ValueError("a row has no feature vector")
        _, _, indices, values = vectors.flatten()
        held = values.value_lengths().to_numpy()
        at = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        at[np.repeat(indices.is_valid().to_numpy(zero_copy_only=False), held)] = indices.flatten().to_numpy()
        slot, row = slots[at], np.repeat(np.arange(len(held)), held)
        out = np.zeros((len(held), max(1, len(trees["used"]))))
        out[row[slot >= 0], slot[slot >= 0]] = values.flatten().to_numpy()[slot >= 0]
        return out

    def leaves(vectors: pa.StructArray) -> np.ndarray:
        x, widest = dense(vectors), trees["table"].shape[-1] - 1
        row, at = np.arange(len(x))[:, None], np.tile(trees["root"], (len(x), 1))
        for _ in range(trees["levels"]):
            value = x[row, trees["slot"][at]]
            go = value <= trees["threshold"][at]
            if len(trees["table"]):
                known = (value >= 0) & (value < widest) & (value == np.floor(value))
                go = np.where(trees["kinds"][at] >= 0, trees["table"][
                    trees["kinds"][at], np.where(known, value, widest).astype(np.int64)], go)
            at = np.where(go, trees["left"][at], trees["right"][at])
        return trees["leaf"][at].T

    def voted(ids: list, places: list) -> pa.RecordBatch:
        ids, places = np.concatenate(ids), np.ascontiguousarray(np.concatenate(places, axis=1))
        best, most = np.zeros(len(ids), np.int64), np.full(len(ids), -1.0)
        for block in blocks:
            first, of, rows, counts = block.value
            vars(block).pop("_value", None)  # a worker holds one block at a time
            start, step = np.cumsum(of) - of, max(1, min(2048, (16 << 20) // (8 * counts.shape[1])))
            for a in range(0, len(ids), step):
                own = places[:, a:a + step]
                votes = np.zeros((own.shape[1], counts.shape[1]))
                for t, (i, n) in enumerate(zip(start, of)):
                    total = rows[i:i + n, None]
                    votes += np.take(np.divide(counts[i:i + n], total, out=np.zeros((n, counts.shape[1])), where=total != 0),
                                     own[t], axis=0)
                top, high = votes.argmax(axis=1), votes.max(axis=1)
                more = high > most[a:a + step]
                best[a:a + step][more], most[a:a + step][more] = first + top[more], high[more]
        return pa.RecordBatch.from_pydict({"__row": ids, "__class": best, "__votes": most})

    def vote(batches):
        step = max(1, min(2048, (16 << 20) // (8 * max(len(trees["root"]), len(trees["used"])))))
        ids, places = [], []
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                ids.append(batch["__row"][a:a + step].to_numpy())
                places.append(leaves(batch["__vector"][a:a + step]))
                if sum(map(len, ids)) >= most_rows:
                    yield voted(ids, places)
                    ids, places = [], []
        if ids:
            yield voted(ids, places)
    return vote


def class_votes(forest: SavedTrees, rows: DataFrame) -> DataFrame:
    """(__row, __class, __votes) of ``rows`` (__row, vector), stored.

    Trees and blocks of class counts are broadcast: a task finds the leaves of its rows and
    meets the blocks one after the other, so neither leaves nor votes by class are dealt out.
    """
    sc = rows.sparkSession.sparkContext
    trees = _tree_arrays(forest.nodes)
    blocks = [sc.broadcast(b) for b in _class_blocks(forest, len(trees["root"]), int(trees["leaf"].max()) + 1)]
    dealt = rows.select("__row", qcol(forest.features).alias("__vector")).repartition(
        max(1, -(-rows.count() // VOTING_ROWS)), "__row")
    votes = cut_lineage(dealt.mapInArrow(_voter(trees, blocks, forest.numFeatures, VOTING_ROWS),
                                         "__row bigint, __class bigint, __votes double"), "votes")
    for b in blocks:
        b.destroy()
    return votes


def fit_forest(train: DataFrame, features: str, label: str, trees: int = 400, depth: int = 6,
               seed: int = 42, task: str = "classify", max_bins: int = 32,
               max_memory_mb: int = STATISTICS_MB, key: str | None = None,
               rows_per_partition: int = ROWS_PER_PARTITION, forest_mb: float = FOREST_MB) -> PriceForest:
    """M3: random forest on ``label`` values as classes (or a regressor with ``task='regress'``).

    Class indices follow the sorted label values and carry nominal metadata, so any number
    of classes is accepted. With a ``key`` the rows are laid out by it first
    (:func:`laid_out`); without, the caller's partitions are used. A classifier whose class
    counts pass ``forest_mb`` is fitted in groups of trees (:func:`tree_groups`), each with
    its own seed.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    more = [qcol(key)] if key else []
    if task == "classify":
        labels = label_values(train, label)
        index = labels.select(F.col("value").alias("__lv"), F.col("index").cast("double").alias("__li"))
        classes = labels.count()
        meta = {"ml_attr": {"type": "nominal", "num_vals": classes, "name": "__label"}}
        data = (train.join(index, qcol(label).cast("double") == F.col("__lv"))
                .select(*more, qcol(features), F.col("__li").alias("__label", metadata=meta)))
        est = RandomForestClassifier(featuresCol=features, labelCol="__label", numTrees=trees,
                                     maxDepth=depth, seed=seed, maxBins=max_bins,
                                     maxMemoryInMB=max_memory_mb)
    elif task == "regress":
        labels = None
        data = train.select(*more, qcol(features), qcol(label).cast("double").alias("__label")) \
            .where(F.col("__label").isNotNull())
        est = RandomForestRegressor(featuresCol=features, labelCol="__label", numTrees=trees,
                                    maxDepth=depth, seed=seed, maxBins=max_bins,
                                    maxMemoryInMB=max_memory_mb)
    else:
        raise ValueError("task must be 'classify' or 'regress'")
    if key:
        data = laid_out(data, key, rows_per_partition=rows_per_partition).drop(key)
    sizes = tree_groups(trees, depth, classes, forest_mb, train.count()) if task == "classify" else [trees]
    if len(sizes) > 1:
        return PriceForest(_fit_groups(est, data, sizes, classes), task, labels)
    return PriceForest(est.fit(data), task, labels)


def fit_price_forest(train: DataFrame, trees: int = 400, depth: int = 6, seed: int = 42,
                     features: str = "features", label: str = "price", **kw) -> PriceForest:
    """M3 with the catalogue signature: price values as classes by default."""
    return fit_forest(train, features, label, trees, depth, seed, **kw)


# --------------------------------------------------------------------------- M6, M7

r2 = r2_score  # A12 under its catalogue name


def node_table(model) -> DataFrame:
    """The nodes of a fitted forest as a table, read back from the saved model.

    (tree, node, feature, threshold, gain, rows, leaf): ``feature`` and ``threshold`` are
    NULL in a leaf, ``leaf`` is its number within the tree (as in MLlib's leaf column) and
    NULL elsewhere; ``rows`` is the node's weight.
    """
    model = model.model if isinstance(model, PriceForest) else model
    if isinstance(model, SavedTrees):
        return model.nodes.drop(*_VOTING)
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "forest")
    model.save(path)
    return _nodes(spark.read.parquet(f"{path}/data"), hasattr(model, "numClasses")).drop(*_VOTING)


#: What :func:`_nodes` has besides the columns of :func:`node_table`.
_VOTING = ("counts", "left", "right", "values", "categories")


def _nodes(saved: DataFrame, classifier: bool) -> DataFrame:
    """:func:`node_table` of the saved nodes, with what voting needs: the leaves' class counts, the
    children, and of a categorical split the number of values and those that go left."""
    n = F.col("nodeData")
    stats = n["impurityStats"]
    # class counts of a classifier; count, sum and sum of squares of a regressor
    rows = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x) if classifier else stats[0]
    is_leaf = n["leftChild"] < 0
    inner = F.when(~is_leaf, n["split"])
    nominal = inner["numCategories"] >= 0
    order = Window.partitionBy("treeID").orderBy(n["id"]).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(is_leaf.cast("int")).over(order), F.lit(0))  # a tree has few nodes
    return saved.select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), inner["featureIndex"].alias("feature"),
        F.get(inner["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), n["gain"].alias("gain"),
        rows.alias("rows"), F.when(is_leaf, before).alias("leaf"), F.when(is_leaf, stats).alias("counts"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), F.when(nominal, inner["numCategories"]).alias("values"),
        F.when(nominal, inner["leftCategoriesOrThreshold"]).alias("categories"))


def node_importances(nodes: DataFrame) -> DataFrame:
    """(index, importance) of the features that split a node of ``nodes``.

    A split is worth its gain times the rows of its node; a tree's splits sum to 1, the
    trees' sums are averaged over the trees that split at all.
    """
    gains = (nodes.where(F.col("feature").isNotNull()).groupBy("tree", "feature")
             .agg(F.sum(F.col("gain") * F.col("rows")).alias("gain")))
    of_tree = F.sum("gain").over(Window.partitionBy("tree"))
    shares = gains.select("feature", (F.col("gain") / of_tree).alias("share"), of_tree.alias("all")).where("all > 0")
    summed = shares.groupBy("feature").agg(F.sum("share").alias("share"))
    total = summed.agg(F.sum("share").alias("total"))
    return summed.join(F.broadcast(total)).select(  # one row
        F.col("feature").alias("index"), (F.col("share") / F.col("total")).alias("importance"))


def importance_table(model, names, spark=None) -> DataFrame:
    """M6: (feature, importance) sorted by importance; size = number of features.

    ``names`` is a list, or a table (index, feature). ``model`` is a :class:`PriceForest` or a fitted MLlib forest, whose importances are
    aggregated over its nodes (:func:`node_importances`), or the importance vector itself.
    """
    spark = spark or SparkSession.getActiveSession()
    model = model.model if isinstance(model, PriceForest) else model
    if isinstance(model, SavedTrees) or hasattr(model, "getNumTrees"):
        count = names.count() if isinstance(names, DataFrame) else len(names)
        if model.numFeatures != count:
            raise ValueError(f"{model.numFeatures} features, {count} names")
        named = names if isinstance(names, DataFrame) else spark.createDataFrame(
            list(enumerate(names)), "index int, feature string")
        df = named.join(node_importances(node_table(model)), "index", "left").select(
            "feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
        return df.orderBy(F.desc("importance"), F.asc("feature"))
    importances = getattr(model, "featureImportances", model)
    values = importances.toArray().tolist() if hasattr(importances, "toArray") else list(importances)
    if len(values) != len(names):
        raise ValueError(f"{len(values)} importances for {len(names)} features")
    df = spark.createDataFrame(list(zip(names, [float(v) for v in values])),
                               "feature string, importance double")
    return df.orderBy(F.desc("importance"), F.asc("feature"))


def top_importance(table: DataFrame, k: int = 10) -> DataFrame:
    """M7: the ``k`` most important features."""
    return top_k(table, "importance", k, keys=["feature"])
