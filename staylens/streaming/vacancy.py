"""Daily vacancy ratio as a Structured Streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.reports import daily_vacancy

CALENDAR_SCHEMA = T.StructType([
    T.StructField("listing_id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("available", T.StringType()),
])


def daily_vacancy_stream(spark: SparkSession, folder: str, schema: T.StructType = CALENDAR_SCHEMA,
                         fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (date, vacant_ratio) over the files arriving in ``folder``.

    The same operator as the batch report, applied to a file stream; use the
    ``update`` or ``complete`` output mode.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return daily_vacancy(reader.load(folder))


def start_daily_vacancy(spark: SparkSession, folder: str, sink: str, checkpoint: str,
                        fmt: str = "parquet", query_name: str | None = None):
    """Start the stream into ``sink`` (a sink format that accepts complete output,
    such as ``memory`` or ``console``) and return the running query.

    ``checkpoint`` must be a folder every executor and the driver can reach;
    it holds the offsets and the per-date state, so a restarted query resumes
    where it stopped.
    """
    w = (daily_vacancy_stream(spark, folder, fmt=fmt).writeStream
         .outputMode("complete").format(sink).option("checkpointLocation", checkpoint))
    if query_name:
        w = w.queryName(query_name)
    return w.start()
