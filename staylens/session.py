"""Session helpers: a local session for tests and benches, and lineage cuts.

Library code never creates a session of its own and never picks a folder on
a cluster: the checkpoint folder comes from ``spark.checkpoint.dir``. Only a
``local[...]`` master without that setting gets a scratch folder, which is
what tests and the bench run on.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "staylens", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench: AQE on, UI off, UTC, small shuffles."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STAYLENS_DRIVER_MEMORY", "8g"))
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints, taken from ``spark.checkpoint.dir``.

    When the setting is absent, a local master (tests, bench) gets a fresh
    scratch folder; any other master must name a shared folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; name a folder every executor "
                "can reach (for example on the cluster's shared file system)")
        configured = tempfile.mkdtemp(prefix="staylens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return configured


_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder; removed by :func:`remove_scratch`."""
    path = f"{checkpoint_dir(spark)}/staylens-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the checkpoint folder and read it back.

    Survives executor loss (unlike a local checkpoint), keeps later plans short,
    and later reads prune columns and use the file statistics.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_scratch() -> None:
    """Remove the tables that :func:`cut_lineage` wrote (also done when the driver ends)."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone: the folder is the cluster's to clean
            return


atexit.register(remove_scratch)
