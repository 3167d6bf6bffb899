"""The dictionary table of F4, F5 and class labels."""

import pytest
from pyspark.sql import functions as F

from staylens.operators import dictionary as D
from staylens.operators import encode

ROWS = [(1, "{TV,Internet}", "House", "a", 2.0), (2, None, "Flat", None, 0.5), (3, "{tv}", None, "b", -1.0),
        (4, "", "", "b", 7.0), (4, "{Hair dryer,hair_dryer}", "house", "a", 7.0)]
SCHEMA = "id long, amenities string, pt string, rt string, x double"


def test_dense_index_over_ranges(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("index_")).repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = D.dense_index(df, ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sorted((r["v"], r["index"]) for r in got) == [(i, i) for i in range(5000)]
    assert D.dense_index(df.where("false"), ["v"]).count() == 0


def test_entries_equal_the_fitted_lists(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    vocab, levels = encode.fit_encoders(df, ["amenities"], ["pt", "rt"])
    want = [("p", "amenities", p, n) for p, n in zip(vocab.phrases["amenities"], vocab.names("amenities"))]
    for c in ("pt", "rt"):
        want += [("n" if v is None else "l", c, v, n) for v, n in zip(levels.encoded(c), levels.names(c))]
    of = D.fit_dictionary(df, ["amenities"], ["pt", "rt"], taken=["id", "x"])
    got = of.entries.orderBy("index").select("kind", "column", "value", "name").collect()
    assert [tuple(r) for r in got] == want and of.size == len(want)
    assert [r[0] for r in of.entries.select("index").orderBy("index").collect()] == list(range(of.size))


def test_vectors_equal_the_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("row", F.monotonically_increasing_id())
    vocab, levels = encode.fit_encoders(df, ["amenities"], ["pt", "rt"])
    wide = encode.apply_one_hot(encode.apply_phrase_indicators(df, vocab), levels)
    of = D.fit_dictionary(df, ["amenities"], ["pt", "rt"], taken=["id", "x", "row"])
    names = [r["feature"] for r in D.names_table(of, ["x"]).orderBy("index").collect()]
    want = {r["row"]: [float(r[n]) for n in names] for r in wide.collect()}
    got = D.sparse_vectors(df, of, ["x"], ["row"])
    assert {r["row"]: r["features"].toArray().tolist() for r in got.collect()} == want


def test_no_level_columns_and_empty_table(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    of = D.fit_dictionary(df)
    assert of.size == 0
    got = D.sparse_vectors(df, of, ["x"], ["id"], "v").collect()
    assert sorted((r["id"], *r["v"].toArray()) for r in got) == sorted((r[0], r[4]) for r in ROWS)
    none = D.fit_dictionary(df.where("false"), ["amenities"], ["pt"])
    assert none.size == 0 and D.sparse_vectors(df.where("false"), none, ["x"]).count() == 0


def test_many_phrases_without_a_driver_list(spark, monkeypatch):
    """60,000 phrases and levels: nothing but counts is collected."""
    df = spark.range(0, 30_000).selectExpr("id", "concat('{p', id, ',q', id % 10, '}') AS s", "concat('L', id) AS t")

    def refuse(self, *args, **kw):
        raise AssertionError("collected")

    with monkeypatch.context() as m:
        for name in ("collect", "toLocalIterator", "toPandas", "toArrow"):
            m.setattr(type(df), name, refuse)
        of = D.fit_dictionary(df, ["s"], ["t"])
        vectors = D.sparse_vectors(df, of, [], ["id"])
    assert of.size == 30_010 + 30_000  # a level goes, the missing one comes
    some = vectors.where("id IN (0, 777)").orderBy("id").collect()
    assert [r["features"].numNonzeros() for r in some] == [2, 3]


def test_duplicate_of_a_taken_name(spark):
    df = spark.createDataFrame([("a", "x"), ("A", "y")], "pt string, other string")
    names = [r[0] for r in D.fit_dictionary(df, [], ["pt"], drop_first=False, taken=["PT_a"]).entries.orderBy("index").select("name").collect()]
    assert len({n.lower() for n in names} | {"pt_a"}) == len(names) + 1 and names[-1] == "pt_nan"


def test_unknown_column(spark):
    with pytest.raises(ValueError):
        D.fit_dictionary(spark.createDataFrame(ROWS, SCHEMA), ["nothing"])
