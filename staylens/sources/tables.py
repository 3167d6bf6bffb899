"""Typed table sources and the Parquet sink used to convert CSV once.

CSV is read with every column as text, then each column is cleaned (missing
tokens to NULL) and cast with ``try_cast`` to the declared type, all in one
projection. Floating NaN becomes NULL here, so aggregates downstream skip it.
Multi-line quoted cells make a CSV file unsplittable: convert it once with
:func:`write_table` and query the Parquet copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import qcol

# Fixed value: text read as missing (the pandas ``read_csv`` default list).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def clean_text(c, tokens=MISSING_TOKENS):
    """NULL where the text is one of the missing tokens."""
    return F.when(~c.isin(list(tokens)), c)


def typed(df: DataFrame, schema: T.StructType, tokens=MISSING_TOKENS) -> DataFrame:
    """Cast columns to ``schema`` in one projection (NULL on bad values).

    Text is cleaned of missing tokens first; floating NaN becomes NULL.
    """
    out = []
    for f in schema.fields:
        c = qcol(f.name)
        if isinstance(df.schema[f.name].dataType, T.StringType):
            c = clean_text(c, tokens)
        if not isinstance(f.dataType, T.StringType):
            c = c.try_cast(f.dataType)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def numeric_text_columns(df: DataFrame, cols, tokens=MISSING_TOKENS) -> list[str]:
    """Text columns whose every present value parses as a number (one aggregation).

    A column without any present value counts as numeric too, as an all-empty
    column of a CSV file is a numeric column of missing values.
    """
    cols = list(cols)
    if not cols:
        return []
    aggs = []
    for i, c in enumerate(cols):
        v = clean_text(qcol(c), tokens)
        aggs += [F.count(v).alias(f"__n{i}"), F.count(v.try_cast("double")).alias(f"__k{i}")]
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(cols) if row[f"__n{i}"] == row[f"__k{i}"]]


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "csv", tokens=MISSING_TOKENS, infer_rest: bool = True,
               multi_line: bool = True) -> DataFrame:
    """Read a header CSV (or Parquet) file into a typed table.

    CSV needs an explicit schema for the columns the analysis relies on:
    inference would turn an all-empty column into text and ``N/A`` into a
    level. Columns are matched by header name. Columns the schema does not
    declare come after the declared ones: as doubles when every present value
    is a number (``infer_rest``, one aggregation over the file), else as text.
    Quoted cells may span lines and use doubled quotes (``multi_line``, which
    reads each file in one task; a file known to keep every record on one line
    can pass ``multi_line=False`` and be split across tasks; a folder of files is read
    by as many tasks as it has files either way).
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
        if schema is None:
            return df
        missing = [f.name for f in schema.fields if f.name not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} are not in {path}")
        declared = {f.name for f in schema.fields}
        rest = [df.schema[c] for c in df.columns if c not in declared]
        return typed(df, T.StructType([*schema.fields, *rest]), tokens)
    if fmt != "csv":
        raise ValueError(f"unsupported format {fmt!r}")
    if schema is None:
        raise ValueError("read_table(fmt='csv') needs an explicit schema")
    # columns are matched by header name (no inference: every column is read as text)
    raw = (
        spark.read
        .option("header", "true")
        .option("inferSchema", "false")
        .option("multiLine", "true" if multi_line else "false")
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("nullValue", "\u0000")  # keep empty text; clean_text decides
        .option("emptyValue", "")
        .csv(path)
    )
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in the header of {path}")
    declared = {f.name for f in schema.fields}
    others = [c for c in raw.columns if c not in declared]
    numeric = set(numeric_text_columns(raw, others, tokens)) if infer_rest else set()
    rest = [T.StructField(c, T.DoubleType() if c in numeric else T.StringType(), True)
            for c in others]
    return typed(raw, T.StructType([*schema.fields, *rest]), tokens)


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite",
                bucket_by=None, buckets: int | None = None, table: str | None = None) -> None:
    """Parquet sink (optionally partitioned, e.g. a calendar by month).

    With ``bucket_by`` the rows are written in ``buckets`` hash buckets (by default the
    session's shuffle partitions), sorted within, and registered as ``table`` in the session's
    catalog: read it with ``spark.table(table)``, and joins and groupings on those columns
    need no shuffle of it (a calendar by listing, say). The rows are dealt by the bucket
    first, so each bucket is one file.
    """
    def as_names(cols):
        return [cols] if isinstance(cols, str) else list(cols or [])

    by = as_names(bucket_by)
    if by:
        if not table:
            raise ValueError("bucket_by needs the name of a table")
        buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(buckets, *[qcol(c) for c in by])
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*as_names(partition_by))
    if by:
        w.bucketBy(buckets, *by).sortBy(*by).format("parquet").option("path", path).saveAsTable(table)
    else:
        w.parquet(path)
