import math
import time
import statistics

import pytest
from pyspark.sql import functions as F

from staylens.operators import groups

from .conftest import rows


@pytest.fixture()
def null_keys(spark):
    data = [("a", 1.0), ("a", 3.0), ("a", None), ("a", float("nan")), ("b", 2.0),
            (None, 5.0), (None, 7.0), ("c", None), ("c", None)]
    return spark.createDataFrame(data, "k string, v double")


def test_median_count_null_rules(null_keys):
    got = {r["k"]: (r["median"], r["count"])
           for r in groups.median_count(null_keys, ["k"], "v").collect()}
    # No null group; D2: count(*) includes missing values; D3: NaN and NULL skipped
    assert set(got) == {"a", "b", "c"}
    assert got["a"] == (2.0, 4)
    assert got["b"] == (2.0, 1)
    assert got["c"][0] is None and got["c"][1] == 2


def test_median_exact_midpoint(spark):
    cases = {"odd": [5.0, 1.0, 3.0], "even": [4.0, 1.0, 3.0, 2.0], "one": [7.5],
             "equal": [2.0, 2.0, 2.0, 2.0], "dups": [1.0, 1.0, 1.0, 10.0, 10.0, 12.0]}
    data = [(k, v) for k, vs in cases.items() for v in vs]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r[0]: r[1] for r in groups.group_median(df, "k", "v").collect()}
    assert got == {k: statistics.median(vs) for k, vs in cases.items()}


def test_median_approx_close(spark):
    df = spark.range(0, 10001).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    exact = dict(rows(groups.group_median(df, "k", "v")))
    approx = dict(rows(groups.group_median(df, "k", "v", exact=False)))
    for k in exact:
        assert abs(exact[k] - approx[k]) <= 10


def test_median_hot_key_invariant_to_layout(spark):
    # one key holds a third of the rows; result must not depend on partitioning
    hot = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("k"),
        (F.col("id") % 1000).cast("double").alias("v"))
    a = rows(groups.median_count(hot, ["k"], "v"), "sorted")
    b = rows(groups.median_count(hot.repartition(7), ["k"], "v"), "sorted")
    c = rows(groups.median_count(hot.repartition(1), ["k"], "v"), "sorted")
    assert a == b == c
    pdf = hot.toPandas()
    want = pdf.groupby("k")["v"].median()
    for k, m, n in a:
        assert m == want[k]


def test_total_median_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "v double")
    assert groups.total_median(df, "v").first()[0] == 2.0
    empty = df.where("v > 100")
    assert groups.total_median(empty, "v").first()[0] is None
    assert groups.median_count(empty, ["v"], "v").count() == 0


def test_value_counts_and_top_k_ties(spark):
    data = [(k,) for k in ["b", "a", "c", "c", "a", "b", "d", None, None, None]]
    df = spark.createDataFrame(data, "k string")
    assert rows(groups.value_counts(df, "k")) == [("a", 2), ("b", 2), ("c", 2), ("d", 1)]
    assert rows(groups.top_k_values(df, "k", 2)) == [("a", 2), ("b", 2)]


def test_group_share_flags(spark):
    data = [("d1", "t"), ("d1", "f"), ("d1", None), ("d1", "T"), ("d1", ""),
            ("d2", "f"), ("d3", "t")]
    df = spark.createDataFrame(data, "date string, available string")
    got = dict(rows(groups.group_share(df, "date", F.col("available") == "t")))
    # missing / other spellings count as not available; all rows in the denominator
    assert got == {"d1": 0.2, "d2": 0.0, "d3": 1.0}


def test_bottom_k_nulls_last_and_ties(spark):
    data = [("a", None), ("b", 1.0), ("c", 1.0), ("d", 0.5), ("e", 3.0)]
    df = spark.createDataFrame(data, "k string, m double")
    assert [r[0] for r in groups.bottom_k(df, "m", 3, keys=["k"]).collect()] == ["d", "b", "c"]
    assert [r[0] for r in groups.top_k(df, "m", 2, keys=["k"]).collect()] == ["e", "b"]


def test_top_k_then_sort(spark):
    data = [("a", 10, 5.0), ("b", 20, 1.0), ("c", 30, 3.0), ("d", 5, 9.0)]
    df = spark.createDataFrame(data, "k string, count long, price double")
    got = [r[0] for r in groups.top_k_then_sort(df, "count", 3, "price", keys=["k"]).collect()]
    assert got == ["a", "c", "b"]


def test_profile_by_features_matches_loop(spark):
    data = [(1.0, 2.0, 10.0), (1.0, 3.0, 20.0), (2.0, 2.0, 30.0), (None, 3.0, 40.0), (2.0, None, 50.0)]
    df = spark.createDataFrame(data, "f1 double, f2 double, price double")
    got = rows(groups.profile_by_features(df, ["f1", "f2"], "price"), "sorted")
    want = []
    pdf = df.toPandas()
    for f in ["f1", "f2"]:
        g = pdf.groupby(f)["price"]
        for level, med in g.median().items():
            want.append((f, float(level), float(med), int(g.size()[level])))
    assert got == sorted(want, key=repr)


def test_group_by_bucket(spark):
    data = [(v, float(v)) for v in [0, 9, 10, 49, 50, -7]] + [(None, 1.0)]
    df = spark.createDataFrame(data, "n long, price double")
    got = rows(groups.group_by_bucket(df, "n", 10, "price").orderBy("n"))
    assert got == [(5.0, 0.0, 3), (15.0, 10.0, 1), (45.0, 49.0, 1), (55.0, 50.0, 1)]


def test_column_means_and_date_range(spark):
    df = spark.createDataFrame([(1, 2.0, "2016-01-04"), (2, float("nan"), "2017-01-02"),
                                (None, None, "2016-05-01")], "i int, d double, s string")
    m = groups.column_means(df, ["i", "d"]).first()
    assert m["i"] == 1.5 and m["d"] == 2.0
    r = groups.date_range(df, "s").first()
    assert (r["first"], r["last"]) == ("2016-01-04", "2017-01-02")
    assert not math.isnan(m["d"])


@pytest.mark.parametrize("doubling, cells", [(1 << 10, 1 << 16), (1, 40), (2, 1)])
def test_median_with_ties_and_missing_values(spark, monkeypatch, doubling, cells):
    monkeypatch.setattr(groups, "CELLS_PER_DOUBLING", doubling)
    monkeypatch.setattr(groups, "CELLS", cells)
    rnd = spark.range(0, 20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
         .otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        F.when(F.col("id") % 97 == 0, F.lit(None).cast("double"))
         .when(F.col("id") % 89 == 0, F.lit(float("nan")))
         .when(F.col("id") % 5 == 0, F.lit(42.0))          # heavy ties
         .otherwise(F.randn(3) * 1000).alias("v"))
    extra = spark.createDataFrame(
        [("one", 5.0), ("pair", 1.0), ("pair", 4.0), ("nulls", None), ("nulls", None),
         ("neg", -3.0), ("neg", -1.0), ("neg", -2.0)], "k string, v double")
    df = rnd.unionByName(extra)
    pdf = df.toPandas()
    want = pdf.groupby("k")["v"].agg(["median", "size"])
    got = {r["k"]: (r["median"], r["count"]) for r in groups.median_count(df, ["k"], "v").collect()}
    assert set(got) == set(want.index) and got["nulls"] == (None, 2)
    for k, (m, n) in got.items():
        assert n == want.loc[k, "size"] and (m is None or math.isclose(m, want.loc[k, "median"], rel_tol=1e-12))
    assert math.isclose(groups.total_median(df, "v").first()[0], pdf["v"].median(), rel_tol=1e-12)
    assert groups.total_median(df.where("false"), "v").first()[0] is None


def test_median_of_extreme_values(spark):
    """Signs, zeros, infinities, the smallest and largest doubles, neighbours that share digits."""
    inf, tiny, huge = float("inf"), 5e-324, 1.7976931348623157e308
    near = [1e18 + 128 * i for i in range(40)]
    cases = {"signs": [-2.0, -0.0, 0.0, 3.0, -1.5], "inf": [inf, inf, 1.0], "low": [-inf, -inf, -inf, 2.0],
             "tiny": [tiny, 2 * tiny, 3 * tiny, 9 * tiny], "huge": [huge, huge / 2, -huge, 1.0, huge / 3],
             "near": near, "even": [1.0, math.nextafter(1.0, 2.0)], "steps": [1.0 + i * 2.0 ** -52 for i in range(33)],
             "powers": [2.0 ** e for e in range(-1074, 1024)], "minus": [-x for x in near]}
    df = spark.createDataFrame([(k, x) for k, xs in cases.items() for x in xs], "k string, v double").repartition(3)
    got = {r["k"]: r["median"] for r in groups.median_count(df, ["k"], "v").collect()}
    for k, xs in cases.items():
        xs = sorted(xs)
        assert got[k] == 0.5 * xs[(len(xs) - 1) // 2] + 0.5 * xs[len(xs) // 2], k


def test_median_work_does_not_grow_with_cells(spark, monkeypatch):
    """No list of cells is scanned for a value: finer digits do not make a run slower."""
    df = spark.range(0, 400_000, numPartitions=4).select(F.rand(7).alias("v"))
    groups.total_median(df, "v").first()  # compiled

    def seconds(doubling, cells):
        monkeypatch.setattr(groups, "CELLS_PER_DOUBLING", doubling)
        monkeypatch.setattr(groups, "CELLS", cells)
        start = time.monotonic()
        out = groups.total_median(df, "v")
        assert "filter(" not in out._jdf.queryExecution().optimizedPlan().toString().lower().replace(" filter (", "")
        return out.first()[0], time.monotonic() - start

    (a, few), (b, many) = seconds(8, 16), seconds(1 << 16, 1 << 16)
    assert a == b and many < 4 * few + 2


def test_weighted_median_equals_repeated_rows(spark):
    data = [("a", 1.0, 3), ("a", 5.0, 2), ("a", 9.0, 1), ("b", None, 4), ("b", 2.0, 1), ("c", 1.0, 1), ("c", 2.0, 1)]
    df = spark.createDataFrame(data, "k string, v double, w long")
    want = rows(groups.median_count(df.withColumn("x", F.explode(F.sequence(F.lit(1), "w"))), "k", "v"), "sorted")
    assert rows(groups.median_count(df, "k", "v", weight="w"), "sorted") == want
    with pytest.raises(ValueError):
        groups.median_count(df, "k", "v", weight="w", exact=False)


def test_nan_keys_are_no_groups(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (nan, 3.0), (None, 4.0), (1.0, 6.0)], "k double, v double")
    assert rows(groups.value_counts(df, "k")) == [(1.0, 2)]
    assert rows(groups.median_count(df, ["k"], "v")) == [(1.0, 4.0, 2)]
    assert rows(groups.group_by_bucket(df, "k", 10, "v")) == [(5.0, 4.0, 2)]
    assert groups.group_share(df, ["k"], F.col("v") > 3).count() == 1


def test_total_median_plan_has_no_cross_join(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "k string, v double")
    out = groups.median_count(df, [], "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert out.first()["median"] == 2.0


def test_paired_counts_two_keys(spark):
    data = [("House", "Entire", 100.0), ("House", "Entire", None), ("House", "Private", 50.0),
            (None, "Entire", 70.0), ("Flat", None, 20.0), ("Flat", "Entire", 80.0)]
    df = spark.createDataFrame(data, "pt string, rt string, price double")
    got = rows(groups.median_count(df, ["pt", "rt"], "price", "price", "count"), "sorted")
    # rows with a missing key are left out; a missing price still counts as a row
    assert got == sorted([("Flat", "Entire", 80.0, 1), ("House", "Entire", 100.0, 2),
                          ("House", "Private", 50.0, 1)], key=repr)


def test_empty_input_through_groups(spark):
    df = spark.createDataFrame([], "k string, v double, n long")
    assert groups.value_counts(df, "k").count() == 0
    assert groups.top_k_values(df, "k", 3).count() == 0
    assert groups.group_share(df, "k", F.col("v") > 0).count() == 0
    assert groups.profile_by_features(df, ["n"], "v").count() == 0
    assert groups.group_by_bucket(df, "n", 10, "v").count() == 0
    assert groups.column_means(df, ["v"]).first()[0] is None
