from pyspark.sql import functions as F

from staylens.operators import groups, members
from staylens.plans import reports as R
from .conftest import SF_SMALL, rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_common_keys(spark):
    a = spark.createDataFrame([("x",), ("y",), ("z",), ("z",)], "k string")
    b = spark.createDataFrame([("z",), ("y",), ("w",)], "k2 string")
    assert rows(members.common_keys(a, b, "k", "k2"), "sorted") == [("y",), ("z",)]
    assert rows(members.common_keys(a, b), "sorted") == [("y",), ("z",)]


def test_keep_members_semi_join(spark):
    cal = spark.createDataFrame([(1, "d1"), (2, "d1"), (3, "d2"), (None, "d2")], "listing_id long, date string")
    ids = spark.createDataFrame([(1,), (3,), (3,), (None,)], "id long")
    out = members.keep_members(cal, "listing_id", ids, "id")
    assert rows(out, "sorted") == [(1, "d1"), (3, "d2")]
    plan = _plan(out)
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan


def test_flag_members(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v long")
    m = spark.createDataFrame([("a",), ("a",)], "k string")
    got = rows(members.flag_members(df, "k", m, "hit").orderBy("v"))
    assert got == [("a", 1, True), ("b", 2, False), (None, 3, False)]


def test_align_on_is_by_key_not_position(spark):
    all_days = spark.createDataFrame([("d1", 0.5), ("d2", 0.6), ("d3", 0.7)], "date string, r double")
    subset = spark.createDataFrame([("d1", 0.1), ("d3", 0.3)], "date string, r2 double")
    got = rows(members.align_on("date", all_days, subset).orderBy("date"))
    assert got == [("d1", 0.5, 0.1), ("d2", 0.6, None), ("d3", 0.7, 0.3)]


def test_lookup_attaches_counts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, v double")
    med = groups.group_median(df, "k", "v", "m")
    counts = groups.value_counts(df, "k", "n")
    got = rows(members.lookup(med, counts, "k").orderBy("k"))
    assert got == [("a", 2.0, 2), ("b", 2.0, 1)]


def test_reports_invariant_to_input_layout(spark):
    from staylens.sources import standins

    listings = standins.listings(spark, SF_SMALL)
    calendar = standins.calendar(spark, SF_SMALL)
    base = (rows(R.popular_neighbourhoods(listings), "sorted"),
            rows(R.busy_dates(calendar, listings), "sorted"))
    for n in (1, 7):
        lay_l = listings.repartition(n).orderBy(F.rand(n))
        lay_c = calendar.repartition(n).orderBy(F.rand(n + 1))
        assert rows(R.popular_neighbourhoods(lay_l), "sorted") == base[0]
        assert rows(R.busy_dates(lay_c, lay_l), "sorted") == base[1]


def test_vacancy_with_repeated_null_and_bounded_ids(spark):
    cal = spark.createDataFrame(
        [(1, "2016-01-04", "t"), (2, "2016-01-04", "f"), (3, "2016-01-04", "f"), (1, "2016-01-05", "f"),
         (3, "2016-01-05", "t"), (3, "2016-01-06", "t"), (2, "2016-01-06", None), (None, "2016-01-06", "t")],
        "listing_id long, date string, available string")
    repeated = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    bounded = spark.sql("SELECT * FROM VALUES (1L), (1L), (2L), (CAST(NULL AS BIGINT)) AS t(id)")
    limited = repeated.orderBy("id").limit(10)
    want = {"2016-01-04": (1 / 3, 0.5), "2016-01-05": (0.5, 0.0), "2016-01-06": (2 / 3, 0.0)}
    for ids in (repeated, bounded, limited):
        for fn in (R.vacancy_side_by_side, R.vacancy_series):
            got = {str(r["date"]): (r["vacant_ratio"], r["vacant_ratio_popular"]) for r in fn(cal, ids).collect()}
            assert got == want, fn
