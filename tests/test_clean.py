import math

import pytest
from pyspark.sql import functions as F

from staylens.operators import clean

from .conftest import rows


@pytest.fixture()
def listings(spark):
    data = [
        (1, "A", "t", "t", 10.0),
        (2, None, "t", "t", 20.0),
        (3, "B", "f", "t", float("nan")),
        (4, "B", "t", None, 40.0),
        (5, "C", "t", "t", None),
    ]
    return spark.createDataFrame(
        data, "id long, nb string, exact string, avail string, v double")


def test_drop_missing_and_keep_equal(listings):
    out = clean.keep_equal(clean.drop_missing(listings, ["nb"]), {"exact": "t", "avail": "t"})
    assert sorted(r["id"] for r in out.collect()) == [1, 5]
    # NaN counts as missing for a floating column
    assert sorted(r["id"] for r in clean.drop_missing(listings, ["v"]).collect()) == [1, 2, 4]
    with pytest.raises(ValueError):
        clean.drop_missing(listings, ["nope"])


def test_filter_report_single_pass(listings):
    pred = F.col("nb").isNotNull() & (F.col("exact") == "t") & (F.col("avail") == "t")
    r = clean.filter_report(listings, pred).first()
    assert (r["total"], r["kept"], r["dropped"]) == (5, 2, 3)


def test_below(spark):
    df = spark.createDataFrame([("d1", 0.5), ("d2", 0.7), ("d3", None)], "date string, vacant_ratio double")
    assert rows(clean.below(df, "vacant_ratio < 0.6", ["date"])) == [("d1",)]


def test_missing_report(listings):
    got = {r["column"]: (r["missing"], r["total"])
           for r in clean.missing_report(listings, ["nb", "avail", "v"]).collect()}
    assert got == {"nb": (1, 5), "avail": (1, 5), "v": (2, 5)}


def test_fill_sentinel(spark):
    df = spark.createDataFrame([(1, None), (2, 9.0), (3, float("nan"))], "id long, s double")
    got = rows(clean.fill_sentinel(df, {"s": -1}).orderBy("id"))
    assert got == [(1, -1.0), (2, 9.0), (3, -1.0)]


def test_drop_sparse_threshold_is_floor(spark):
    # n = 5, limit floor(0.5 * 5) = 2: keep columns with >= 2 values
    data = [(1.0, 1.0, 1.0, None), (None, 2.0, 2.0, None), (None, None, 3.0, None),
            (None, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(data, "c1 double, c2 double, c3 double, c4 double")
    assert clean.drop_sparse(df, 0.5).columns == ["c2", "c3"]


def test_impute_mean(spark):
    data = [(1, 2.0, None), (2, float("nan"), None), (None, 4.0, None), (4, None, None)]
    df = spark.createDataFrame(data, "i int, d double, e double")
    out = clean.impute_mean(df, ["i", "d", "e"])
    got = rows(out)
    # int column becomes double and keeps the fractional mean; NaN is missing
    assert [r[0] for r in got] == [1.0, 2.0, 7 / 3, 4.0]
    assert [r[1] for r in got] == [2.0, 3.0, 4.0, 3.0]
    assert all(r[2] is None for r in got)  # all-missing column stays missing
    assert dict(out.dtypes)["i"] == "double"


def test_impute_mean_fit_on_subset(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 9.0)], "id long, v double")
    out = clean.impute_mean(df, ["v"], fit_on=df.where("id < 3"))
    assert [r["v"] for r in out.orderBy("id").collect()] == [1.0, 1.0, 9.0]


def test_drop_columns_and_names(listings):
    assert clean.drop_columns(listings, ["nb", "v"]).columns == ["id", "exact", "avail"]
    with pytest.raises(ValueError):
        clean.drop_columns(listings, ["nb", "zipcode"])
    assert clean.drop_columns(listings, ["nb", "zipcode"], strict=False).columns == \
        ["id", "exact", "avail", "v"]
    assert clean.with_names(listings, ["a", "b", "c", "d", "e"]).columns == ["a", "b", "c", "d", "e"]
    assert clean.columns_of_type(listings, "string") == ["nb", "exact", "avail"]
    assert clean.columns_of_type(listings, "numeric") == ["id", "v"]


def test_split_target(listings):
    y, x = clean.split_target(listings, "v", key="id")
    assert y.columns == ["id", "v"] and "v" not in x.columns


def test_column_stats_one_row(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (3.0, "b")], "x double, s string")
    st = clean.fit_column_stats(df)
    assert st.rows == 3 and st.present == {"x": 2, "s": 2}
    assert st.means == {"x": 2.0}
    assert not math.isnan(st.means["x"])


def test_empty_table_through_cleaning(spark):
    df = spark.createDataFrame([], "id long, v double, s string")
    assert clean.drop_missing(df, ["v"]).count() == 0
    r = clean.filter_report(df, F.col("v") > 0).first()
    assert (r["total"], r["kept"], r["dropped"]) == (0, 0, 0)
    assert clean.impute_mean(df, ["v"]).count() == 0
    assert clean.drop_sparse(df, 0.5).columns == ["id", "v", "s"]


def test_impute_mean_fit_on_train_fold(spark):
    df = spark.createDataFrame([(1, 1.0, "train"), (2, None, "test"), (3, 9.0, "test"),
                                (4, 3.0, "train")], "id long, v double, fold string")
    out = clean.impute_mean(df, ["v"], fit_on="train")
    assert [r["v"] for r in out.orderBy("id").collect()] == [1.0, 2.0, 9.0, 3.0]
    with pytest.raises(ValueError):
        clean.impute_mean(df, ["v"], fit_on="test")


def test_filter_report_with_equalities(listings):
    r = clean.filter_report(listings, {"exact": "t", "avail": "t"}).first()
    assert (r["total"], r["kept"], r["dropped"]) == (5, 3, 2)


def test_drop_counts(listings):
    assert clean.drop_counts(listings, ["nb", "v", "zipcode"]) == \
        {"requested": 3, "dropped": 2, "remaining": 3}


def test_missing_report_keeps_odd_column_names(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("it's", T.DoubleType()),
                           T.StructField("back\\\\slash", T.DoubleType())])
    df = spark.createDataFrame([(None, 2.0)], schema)
    got = {r["column"]: r["missing"] for r in clean.missing_report(df).collect()}
    assert got == {"it's": 1, "back\\\\slash": 0}
