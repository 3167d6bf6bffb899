"""Hot keys: one key holding a third of the rows must give whole, exact results."""

from pyspark.sql import functions as F

from staylens.operators import encode, groups
from staylens.plans import reports as R

from .conftest import rows


def _hot_calendar(spark, n=60_000):
    # listing 0 holds a third of the rows; dates cycle over 50 days
    return spark.range(0, n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997).alias("listing_id"),
        F.date_add(F.lit("2016-01-04").cast("date"), (F.col("id") % 50).cast("int")).alias("date"),
        F.when(F.col("id") % 7 < 3, F.lit("t")).otherwise(F.lit("f")).alias("available"),
    )


def test_hot_listing_in_shuffle_semi_join(spark):
    cal = _hot_calendar(spark)
    ids = spark.range(0, 40).select(F.col("id"))  # includes the hot listing 0
    shuffled = rows(R.vacancy_series(cal, ids), "sorted")
    assert rows(R.vacancy_side_by_side(cal, ids), "sorted") == shuffled
    pdf = cal.toPandas()
    pdf["t"] = (pdf["available"] == "t").astype(float)
    sub = pdf[pdf["listing_id"] < 40]
    want_all = pdf.groupby("date")["t"].mean()
    want_sub = sub.groupby("date")["t"].mean()
    for d, all_ratio, sub_ratio in shuffled:
        assert abs(all_ratio - want_all[d]) < 1e-12
        assert abs(sub_ratio - want_sub[d]) < 1e-12


def test_hot_group_median_and_counts(spark):
    df = spark.range(0, 90_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("nb"),
        ((F.col("id") * 7919) % 365).cast("double").alias("availability_365"))
    got = {r[0]: (r[1], r[2]) for r in groups.median_count(df, ["nb"], "availability_365").collect()}
    pdf = df.toPandas()
    want = pdf.groupby("nb")["availability_365"].agg(["median", "size"])
    assert len(got) == len(want)
    assert got["hot"] == (want.loc["hot", "median"], 30_000)
    for k, (m, n) in got.items():
        assert m == want.loc[k, "median"] and n == want.loc[k, "size"]


def test_hot_phrase_vocabulary(spark):
    # one phrase in every row, the rest spread
    df = spark.range(0, 20_000).select(
        F.concat(F.lit("{TV,p"), (F.col("id") % 101).cast("string"), F.lit("}")).alias("s"))
    got = dict(rows(encode.phrase_vocabulary(df, "s")))
    assert got["tv"] == 20_000
    assert sum(v for k, v in got.items() if k != "tv") == 20_000


def test_hot_continuous_group_is_split(spark, monkeypatch):
    """A key with as many values as rows: its values are sorted in ranges, not in one task."""
    monkeypatch.setattr(groups, "CELLS_PER_DOUBLING", 16)
    df = spark.range(0, 60_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit("cold")).alias("k"), F.randn(5).alias("v"))
    got = {r["k"]: r["median"] for r in groups.median_count(df, ["k"], "v").collect()}
    want = df.toPandas().groupby("k")["v"].median()
    assert {k: abs(got[k] - want[k]) < 1e-12 for k in got} == {"hot": True, "cold": True}
    plan = groups.median_count(df, ["k"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "__cell" in plan
