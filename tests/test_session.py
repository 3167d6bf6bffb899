import os

from staylens.session import checkpoint_dir, cut_lineage, remove_scratch


def test_checkpoint_dir_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert configured in checkpoint_dir(spark)  # Spark adds one folder per application


def test_cut_lineage_reads_the_written_copy(spark):
    df = spark.range(0, 100).selectExpr("id", "id * 2 AS twice")
    cut = cut_lineage(df.where("id % 2 = 0"))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "Range" not in plan  # no lineage back to the source
    assert cut.count() == 50 and cut.dtypes == df.dtypes
    files = cut.inputFiles()
    assert all(checkpoint_dir(spark).split(":")[-1] in f for f in files)
    remove_scratch()
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files)
