import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="staylens-test-")
    s = (
        SparkSession.builder.master("local[4]")
        .appName("staylens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.path.join(scratch, "ckpt"))
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s._scratch = scratch
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    return tempfile.mkdtemp(prefix="case-", dir=spark._scratch)


def rows(df, order=None):
    """Collected rows as plain tuples (optionally sorted)."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=repr) if order == "sorted" else out
