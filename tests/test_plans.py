"""Plan shape checks: the physical plans we want at scale, not only the right rows."""

import re

import pytest

import __spark_entry__ as E
from staylens.operators import groups
from staylens.plans import constants as C
from staylens.plans import reports as R
from staylens.sources import standins

from .conftest import SF_SMALL

OPTIONAL = E.training_data.queries() if E.training_data else {}
RELATIONAL = [k for k in E.queries() if not k.startswith("price_driver") and k not in OPTIONAL]
# these take a first pass (vocabulary, levels, means or a fit) before their plan is known
FIRST_PASS = {"phrase_indicators", "one_hot", "drop_sparse", "impute_mean", "price_features", "assembled_features",
              "top_means", "forest_recovers", "csv_listings"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_python_in_plans(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_feature_profile_shuffles_do_not_grow_with_features(spark):
    listings = standins.listings(spark, SF_SMALL)
    two = C.REVIEW_FEATURES[:2]
    one = _plan(R.price_by_review(listings, two))
    seven = _plan(R.price_by_review(listings))
    count = lambda p: len(re.findall(r"Exchange hashpartitioning", p))
    assert count(one) == count(seven)
    assert "Expand" in seven


def test_top_k_is_take_ordered(spark):
    plan = _plan(E.queries()["top_listed"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan


def test_semi_join_and_broadcast_in_busy_dates(spark):
    ids = R.popular_ids(standins.listings(spark, SF_SMALL))
    assert re.search(r"BroadcastHashJoin .*LeftSemi", _plan(ids))  # ids of the popular neighbourhoods
    plan = _plan(E.queries()["vacancy_side_by_side"](spark, SF_SMALL))
    assert plan.count("l_shipdate") and len(re.findall(r"FileScan parquet .*l_shipdate", plan)) == 1  # read once


def test_scan_pruning_and_pushdown(spark):
    df = R.daily_vacancy(standins.calendar(spark, SF_SMALL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_linestatus:string,l_shipdate:timestamp_ntz>" in plan
    assert "PushedFilters: [IsNotNull(l_shipdate)]" in plan
    # exact median: counts by key and value first, then cells of a key's values
    med = _plan(R.least_available(R.filtered_listings(standins.listings(spark, SF_SMALL))))
    assert re.search(r"hashpartitioning\(__k0#\d+, __value#\d+", med)
    assert re.search(r"hashpartitioning\(__k0#\d+, __cell#\d+", med) and "percentile" not in med


def test_listing_filters_reach_parquet_scan(spark, scratch):
    import contextlib
    import io
    import os

    from pyspark.sql import functions as F

    path = os.path.join(scratch, "listings.parquet")
    spark.createDataFrame(
        [(1, "A", "t", "t", 10.0, "$50.00"), (2, "B", "f", "t", 20.0, "$60.00"),
         (3, None, "t", "f", 30.0, "$70.00")],
        "id long, neighbourhood_cleansed string, is_location_exact string, "
        "has_availability string, availability_365 double, price string").write.parquet(path)
    listings = spark.read.parquet(path).withColumn("unused", F.lit(1))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        R.least_available(R.filtered_listings(listings)).explain("formatted")
    plan = buf.getvalue()
    assert "EqualTo(is_location_exact,t)" in plan and "EqualTo(has_availability,t)" in plan
    assert "IsNotNull(neighbourhood_cleansed)" in plan
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "price" not in read and "id" not in read  # only the used columns are read


def test_busy_dates_without_broadcast(spark):
    listings = standins.listings(spark, SF_SMALL)
    calendar = standins.calendar(spark, SF_SMALL)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = R.vacancy_series(calendar, R.popular_ids(listings))
        plan = _plan(df)
        assert re.search(r"LeftSemi", plan) and "BroadcastHashJoin" not in plan
        assert re.search(r"SortMergeJoin .*LeftOuter", plan)  # the two daily series, on the date
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = sorted(tuple(r) for r in R.vacancy_side_by_side(calendar, R.popular_ids(listings)).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(RELATIONAL) - FIRST_PASS))
def test_building_a_plan_runs_no_work(spark, name):
    """Only the schema reads of the tables run before an action."""
    sc = spark.sparkContext
    sc.setJobGroup(f"build-{name}", name)
    try:
        E.queries()[name](spark, SF_SMALL)
    finally:
        jobs = sc.statusTracker().getJobIdsForGroup(f"build-{name}")
        sc.setJobGroup("", "")
    assert len(jobs) <= 4  # one job a table read, some queries read one table twice


@pytest.mark.parametrize("cores", [4, 8])
def test_regex_rows_are_dealt_out(spark, cores):
    docs = standins.documents(spark, SF_SMALL)
    from staylens.operators import encode

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", cores)
    try:
        plan = _plan(encode.phrases_long(docs, "doc_id", "text"))
        assert "hashpartitioning(doc_id" in plan and f", {cores}), REPARTITION_BY_NUM" in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_bucketed_calendar_is_not_shuffled(spark, scratch):
    """J1 on a calendar written in buckets by listing: only the id side is dealt."""
    from staylens.operators import members
    from staylens.sources import write_table

    calendar = standins.calendar(spark, SF_SMALL)
    write_table(calendar, f"{scratch}/calendar", bucket_by="listing_id", buckets=8, table="calendar_by_listing")
    ids = standins.listings(spark, SF_SMALL).where("accommodates > 2").select("id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = members.keep_members(spark.table("calendar_by_listing"), "listing_id", ids, "id")
        plan = _plan(kept)
        assert len(re.findall(r"Exchange hashpartitioning", plan)) >= 1
        assert "Exchange hashpartitioning(listing_id" not in plan
        want = members.keep_members(calendar, "listing_id", ids, "id")
        assert kept.count() == want.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE calendar_by_listing")
