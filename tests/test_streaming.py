import os

from staylens.plans import reports as R
from staylens.sources import standins
from staylens.streaming import start_daily_vacancy

from .conftest import SF_SMALL


def test_stream_equals_batch(spark, scratch):
    cal = standins.calendar(spark, SF_SMALL)
    folder = os.path.join(scratch, "calendar")
    # two arrivals of calendar files
    cal.where("listing_id % 2 = 0").write.parquet(os.path.join(folder, "a"))
    cal.where("listing_id % 2 = 1").write.parquet(os.path.join(folder, "b"))
    q = start_daily_vacancy(spark, folder + "/*", "memory", os.path.join(scratch, "ckpt"),
                            query_name="vacancy_stream_test")
    try:
        q.processAllAvailable()
        got = {r["date"]: r["vacant_ratio"] for r in spark.table("vacancy_stream_test").collect()}
    finally:
        q.stop()
    want = {r["date"]: r["vacant_ratio"] for r in R.daily_vacancy(cal).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert abs(got[k] - want[k]) < 1e-12
