"""The feature tables are made by many tasks, whatever the partitions of the listings."""

from staylens.plans import reports as R
from staylens.sources import standins

from .conftest import SF_SMALL


def test_parsed_listings_are_dealt_out_and_stored(spark):
    plan = R.plan_features(standins.listings(spark, SF_SMALL).coalesce(1))
    assert len(plan.rows.inputFiles()) > 1  # parsed once: every later pass reads these files
    assert plan.rows.count() == 200
    table, _ = R.price_features(standins.listings(spark, SF_SMALL).coalesce(1))
    assert len(table.inputFiles()) > 1


def test_slots_are_joined_without_dealing_out_the_values(spark):
    """The table of names has a known size: 87 slots, 1.7 million values at sf0.1."""
    _, names = R.price_vectors(standins.listings(spark, SF_SMALL))
    size = names._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 1 << 20
    got = [r["feature"] for r in names.orderBy("index").collect()]
    assert [r["index"] for r in names.orderBy("index").collect()] == list(range(len(got)))
    assert got[:2] == ["availability_365", "bedrooms"]
